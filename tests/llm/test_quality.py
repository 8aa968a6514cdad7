import random
import re
from collections import Counter

import duckdb
import pytest

from loamgrid.llm import quality as Q


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    gone = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(gone) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(gone), failed


COMMON = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with"]


def english(rnd, n):
    """n words, near a fifth of them common ones."""
    made = lambda: "".join(rnd.choice("bdfglmnrst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4)))
    return " ".join(rnd.choice(COMMON) if rnd.random() < 0.3 else made() for _ in range(n)) + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(1000 + k, english(rnd, 200), "en") for k in range(30)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1000 + k, 1, 0) for k in range(30)] + [(1000, 1, 0), (None, 1, 0), (77_777, 1, 0), (1001, None, None)], "doc_id long, quality int, toxic int")
    return docs.persist(), labels.persist()


def of(spark, labelled, rows):
    docs = labelled[0].unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    return {r["doc_id"]: r for r in Q.judge(docs, labelled[1]).collect()}


def test_counts_match_brute_force(awkward, spark, labelled):
    more = [(900, "a b c a b c\na b c a b c\n\n \n", None), (901, "x y " * 300, None), (902, "# * <> && | $%", None), (903, "a\n" * 5, None)]
    df = awkward.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in Q.judge(df, labelled[1]).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *plain(r["text"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", [61, Q.POSITION_BITS])
def test_repeats_are_exact_whatever_the_hashes_have_in_common(spark, labelled, monkeypatch, bits):
    """With three bits of hash nearly all windows collide."""
    monkeypatch.setattr(Q, "POSITION_BITS", bits)
    rnd = random.Random(bits)
    own = [f"w{k}" for k in range(60)]
    between = ["w2121350 in town", " ".join(own[:30]), "w2454512 in town", " ".join(own[30:]), "w2121350 in town"]
    texts = [" ".join(between), *(" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 200))) for _ in range(40)), *(" ".join(rnd.choice(own) for _ in range(800)) for _ in range(10))]
    if bits == Q.POSITION_BITS:  # a long text, with natural collisions
        texts.append(" ".join(f"w{k}" for k in range(300_000)) + " w5 w6 w7 w8")
    got = of(spark, labelled, [(k, t, None) for k, t in enumerate(texts)])
    assert got[0]["n_repeat_words"] == 6
    assert [got[k]["n_repeat_words"] for k in range(len(texts))] == [plain(t)[4] for t in texts]


def test_prose_is_kept_and_junk_is_not(spark, labelled):
    rnd = random.Random(9)
    good = english(rnd, 160)
    shout = " ".join(f"{w.upper()}!!!###" + "abcdefghijklm"[i % 13] for i, w in enumerate(good.split()))
    numbers = " ".join(str(i * 7919) for i in range(150))
    bare = " ".join(w for w in english(rnd, 400).split() if w not in COMMON)
    short = [" ".join([w for w in english(rnd, 200).split() if w not in COMMON][:n]) for n in (80, 120)]
    rows = [(1, good, "en"), (2, shout, "en"), (3, numbers, "en"), (4, bare, "en"), (5, bare, "xx"), (6, bare, None), (7, good, "xx"), (8, short[0], "en"), (9, short[1], "en"), (10, english(rnd, 60), "en")]
    got = of(spark, labelled, rows)
    assert [got[k]["kept"] for k in range(1, 8)] == [True, False, False, False, True, True, True]  # without a reference: base rules alone
    assert [got[k]["kept"] for k in range(8, 11)] == [False, False, True]


def test_references_are_of_the_good_documents_alone(spark, labelled):
    docs, labels = labelled
    junk = spark.createDataFrame([(k, "§ 1 2 3 zzz " * 500, "en") for k in range(20)], docs.schema)
    bad = spark.createDataFrame([(k, 0, 0) for k in range(10)], labels.schema)
    alone = Q.references(docs, labels).collect()
    assert alone == Q.references(docs.unionByName(junk), labels.unionByName(bad)).collect()
    assert set(alone[0]["voc"]) == set(COMMON) and abs(sum(alone[0]["word_shares"]) - 1) < 1e-9 and abs(sum(alone[0]["class_shares"]) - 1) < 1e-9


def test_keep_good_keeps_columns_and_agrees(awkward, labelled):
    kept = Q.keep_good(awkward, labelled[1])
    assert kept.columns == awkward.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(r["doc_id"]) for r in Q.judge(awkward, labelled[1]).where("kept").collect())


def test_the_sql_agrees_on_awkward_rows(awkward, spark, labelled):
    docs = awkward.select("doc_id", "text", "lang").unionByName(labelled[0])
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("labels", labelled[1].toArrow())
    want = sorted(con.execute(Q.oracle()).fetchall(), key=repr)
    assert want == sorted((tuple(r) for r in Q.judge(docs, labelled[1]).collect()), key=repr)


def test_the_plan_has_no_python(awkward, labelled):
    plan = Q.keep_good(awkward, labelled[1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(nothing, awkward, labelled):
    assert Q.judge(nothing, labelled[1]).count() == 0 and Q.keep_good(nothing, labelled[1].limit(0)).count() == 0
    assert Q.judge(awkward, labelled[1].limit(0)).where("kept = base_failed").count() == 0
