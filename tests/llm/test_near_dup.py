import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from loamgrid.llm import near_dup as N


def bag(words):
    return np.unique(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), return_counts=True)


def plain_bag(text):
    """Counts of 5-word shingles, of the words themselves."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_links(bags):
    """All pairs at 0.8 or more: overlaps are added up along inverted lists."""
    lists = defaultdict(list)
    for i, b in enumerate(bags):
        for g, n in b.items():
            lists[g].append((i, n))
    total = [sum(b.values()) for b in bags]
    for i, b in enumerate(bags):
        common = Counter()
        for g, n in b.items():
            for j, m in lists[g]:
                if j > i:
                    common[j] += min(n, m)
        for j, c in common.items():
            if 10 * c >= 8 * (total[i] + total[j] - c):
                yield i, j


def brute_force(rows):
    bags = [plain_bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in plain_links(bags):
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if bags[i] and d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, least.get(top(i)) if bags[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def test_the_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, N.near_duplicates(docs).collect()), key=repr)
    assert got == brute_force([tuple(r) for r in docs.collect()])


def test_signatures_are_unbiased_for_multisets():
    rnd, off = random.Random(3), []
    for _ in range(200):
        own = str(rnd.random())  # trials share no element, so that they are independent
        a = [own + rnd.choice("abcdefgh") + str(rnd.randint(0, 2)) for _ in range(50)]
        b = [f"{own}x{rnd.randint(0, 9)}" if rnd.random() < 0.15 else w for w in a]
        x, y = bag(a), bag(b)
        s = N.signatures([x, y])
        off.append((s[0] == s[1]).mean() - N.similarity(x, y))
    assert abs(np.mean(off)) < 4 * np.std(off) / len(off) ** 0.5 + 0.002


def test_a_signature_does_not_depend_on_its_company_or_limit():
    x, y = bag(["a", "b", "b", "c"] * 9), bag([f"w{i}" for i in range(500)])
    assert (N.signatures([x])[0] == N.signatures([y, x, y])[1]).all()
    assert np.isfinite(N.signatures([bag(["one"])])).all() and np.isinf(N.signatures([bag([])])).all()


def test_awkward_rows_match_brute_force(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert sorted(map(tuple, N.near_duplicates(awkward).collect()), key=repr) == brute_force(rows)


@pytest.mark.parametrize("part", [5, 16, 4000])
def test_chains_and_large_groups_match_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(N, "MAX_PART", part)
    rnd = random.Random(8)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 3, 5, 8])):
            w[rnd.randrange(150)] = f"x{rnd.randint(0, 99999)}"
        rows.append((k, " ".join(w)))
    got = sorted(map(tuple, N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert got == brute_force(rows)


def test_tasks_of_a_bucket_meet_all_pairs_of_different_roots(spark, monkeypatch):
    monkeypatch.setattr(N, "MAX_PART", 3)
    roots = {v: 0 if v < 11 else v - v % 2 for v in range(18)}
    placed = spark.createDataFrame([(0, 5, v, r, 10) for v, r in roots.items()], "pos int, band long, v long, root long, chars long")
    tasks = defaultdict(set)
    for r in N.parts_of(placed).collect():
        tasks[r["s"], r["t"]].add(r["v"])
    met = {(a, b) for vs in tasks.values() for a in vs for b in vs if a < b}
    assert {(a, b) for b in range(18) for a in range(b) if roots[a] != roots[b]} <= met
    assert max(map(len, tasks.values())) < 18 and sum(len([v for v in vs if v < 11]) for vs in tasks.values()) <= 11 * 3


def test_keep_one_row_of_each_class(awkward):
    kept = N.keep_one(awkward)
    assert kept.columns == awkward.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = brute_force([(r["doc_id"], r["text"]) for r in awkward.collect()])
    empty = sum(not (r["text"] or "").split() for r in awkward.collect())
    assert len(rows) == len({c for _, c in want if c is not None} - {14, 15, 16}) + 1 + empty  # two texts of doc_id 3 name two classes
    assert sum(t is None for _, t in rows) == 1 and sum(d == 0 for d, _ in rows) == 1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["v"]: r["root"] for r in N.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def test_empty_table(nothing):
    assert N.near_duplicates(nothing).count() == 0 and N.keep_one(nothing).count() == 0


def test_few_links_are_joined_in_one_task(spark, monkeypatch):
    """The same components as by steps over the cluster, in a few jobs."""
    rnd = random.Random(5)
    links = spark.createDataFrame([(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(7, 7)] + [(k, k + 1) for k in range(1000, 1200)], "a long, b long")
    spark.sparkContext.setJobGroup("few", "few")
    few = sorted(map(tuple, N.components(links).collect()))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 8
    spark.sparkContext.setJobGroup("", "")
    monkeypatch.setattr(N, "FEW", -1)
    assert few == sorted(map(tuple, N.components(links).collect()))
    assert N.components(links.limit(0)).count() == 0
