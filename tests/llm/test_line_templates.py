import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from loamgrid.llm import line_templates as T


def brute_force(rows):
    """(doc_id, lines, dropped, digest) of rows (doc_id, text, hash of the text)."""
    kept = []
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    for doc in docs:
        for pos, line in enumerate((doc[1] or "").split("\n")):
            plain = re.findall(r"[^\x20\x09-\x0D]+", line)
            t = ["<*>" if re.search("[0-9]", w) else w for w in plain]
            t = plain if len(t) < 3 and set(t) == {"<*>"} else t
            if t:
                kept.append((doc, pos, tuple(t)))
    by_line = defaultdict(set)
    for doc, _, t in kept:
        by_line[t].add(doc)
    count = defaultdict(int)
    for t, who in by_line.items():
        for i, w in enumerate(t):
            count[len(t), t[:3], i, w] += len(who)

    def template(t):
        stands = [i < 3 or count[len(t), t[:3], i, w] >= T.MIN_DOCS for i, w in enumerate(t)]
        return (len(t), t[:3], tuple(w if s else "<*>" for w, s in zip(t, stands, strict=True)) if sum(stands) >= T.LIKE * len(t) else t)

    who = defaultdict(list)
    for doc, _, t in kept:
        if doc not in who[template(t)]:
            who[template(t)].append(doc)
    gone = defaultdict(set)
    for doc, pos, t in kept:
        if len(who[template(t)]) >= T.MIN_DOCS and who[template(t)][0] != doc:
            gone[doc].add(pos)
    out = []
    for r in rows:
        ls = (r[1] or "").split("\n")
        left = "\n".join(x for i, x in enumerate(ls) if i not in gone[r])
        out.append((r[0], len(ls), len(gone[r]), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()]
    got = sorted(map(tuple, T.digest(docs).collect()), key=repr)
    assert got == brute_force(rows)
    return {d: n for d, _, n, _ in got}


def test_families_of_one_leaf_do_not_hide_each_other(spark):
    names = "anna bert carl dora emil fred gina hans ines jan kurt lena".split()
    first = [(k, f"user admin logged {w} out of her own desk") for k, w in enumerate(names)]
    second = [(100 + k, "user admin logged in from the main office today") for k in range(14)]
    for rows in (first, second, first + second):
        got = check(spark.createDataFrame(rows, "doc_id long, text string"))
        assert all(got[d] == int(d not in (0, 100)) for d in got)


def test_random_lines_match_brute_force(spark):
    rnd = random.Random(3)
    words = ["a", "b", "c"] + [f"v{chr(97 + k)}" for k in range(9)] + ["7", "n5"]
    line = lambda: " ".join(rnd.choice(words[:4] if i < 3 else words) for i in range(rnd.choice([0, 1, 2, 3, 4, 5, 8])))
    rows = [(rnd.randint(0, 150) if rnd.random() < 0.9 else None, None if rnd.random() < 0.03 else "\n".join(line() for _ in range(rnd.randint(1, 25)))) for _ in range(160)]
    got = check(spark.createDataFrame(rows + rows[:30], "doc_id long, text string"))
    assert sum(got.values()) > 100


def test_many_lines_of_one_document_and_one_leaf(spark):
    names = ["".join(chr(97 + int(c)) for c in str(k)) for k in range(3000)]
    big = "\n".join(f"user admin logged {w} out of her own desk" for w in names)
    got = {r["doc_id"]: r["n_dropped"] for r in T.digest(spark.createDataFrame([(5, big), *((10 + k, f"x\n{big}") for k in range(9))], "doc_id long, text string")).collect()}
    assert got[5] == 0 and set(got.values()) == {0, 3000}


def test_variable_fields_share_a_template_and_the_first_document_keeps_its_line(spark):
    docs = [(k, f"request {k} took {k * 3} ms\nown line {'x' * k} {'y' * k} {'z' * k} end") for k in range(12)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in T.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == (2, 0)
    assert all(got[k] == (2, 1) for k in range(1, 12))


def test_a_leaf_generalises_around_its_commonest_line(spark):
    docs = [(k, "user admin logged in from the main office today") for k in range(9)] + [(20 + k, f"user admin logged in from the {w} office today") for k, w in enumerate(("north", "south"))]
    got = {r["doc_id"]: r["n_dropped"] for r in T.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[20] == got[21] == 1 and got[0] == 0


def test_lines_of_few_documents_stay(spark):
    docs = [(k, "the very same line in all of them") for k in range(T.MIN_DOCS - 1)]
    assert all(r["n_dropped"] == 0 for r in T.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_awkward_rows(awkward):
    check(awkward)
    out = T.digest(awkward).collect()
    assert len(out) == awkward.count()
    kept = T.without_lines(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    served = [r for r in rows if r["text"] and r["text"].startswith("Served")]
    assert len(served) == 1
    assert sum(r["text"] is None for r in rows) == 1
    assert sum(r["doc_id"] == 0 for r in rows) == 3
    changed = next(r for r in rows if r["doc_id"] == 24)
    assert changed["n_chars"] == len(changed["text"])


def test_a_long_token_without_digits_is_parsed_in_linear_time(spark):
    docs = spark.createDataFrame([(1, "x" * 200_000 + " b c d"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_lines"] for r in T.digest(docs).collect()} == {1: 1, 2: 1}


def test_empty_table(nothing):
    assert T.digest(nothing).count() == 0 and T.without_lines(nothing).count() == 0


def test_short_lines_recur_too_and_bare_numbers_stand_for_themselves(spark):
    docs = spark.createDataFrame([(k, f"Read more\nHome\nPage {k}\n{100 + k}\n\n7\nown line {'x' * (k + 1)} {'y' * (k + 1)}") for k in range(12)], "doc_id long, text string")
    assert all(r["n_dropped"] == (4 if r["doc_id"] else 0) for r in T.digest(docs).collect())
    kept = {r["doc_id"]: r["text"] for r in T.without_lines(docs).collect()}
    assert kept[3] == "103\n\nown line xxxx yyyy" and kept[0].startswith("Read more\nHome\nPage 0\n100\n\n7\n")


def test_a_hot_line_does_not_hide_another_template_of_its_leaf(spark):
    hot = [(k, "user admin logged in from the main office") for k in range(30)]
    names = [(100 + k, f"user admin logged out by {w} at noon") for k, w in enumerate("abcdefghijkl")]
    docs = spark.createDataFrame(hot + names, "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in T.digest(docs).collect()}
    assert all(got[d] == int(d not in (0, 100)) for d in got)
