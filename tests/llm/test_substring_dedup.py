import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np

from loamgrid.llm import blocks as B
from loamgrid.llm import shared
from loamgrid.llm import substring_dedup as S
from loamgrid.llm.wordhash import normalise

SPAN = 35


def brute_force(rows):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + SPAN]) for _, w in words for i in range(len(w) - SPAN + 1))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - SPAN + 1):
            if seen[tuple(w[i : i + SPAN])] > 1:
                gone.update(range(i, i + SPAN))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_awkward_rows_match_brute_force(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for batches in (1, S.BATCHES):
        got = sorted(map(tuple, S.dedup(awkward, batches).collect()), key=repr)
        assert got == brute_force(rows)


def test_levels_change_no_result(awkward, monkeypatch):
    monkeypatch.setattr(B, "PARTITION_BYTES", 15_000)
    monkeypatch.setattr(B, "FAN", 3)
    docs = awkward.repartition(12)
    ladder = B.Ladder(B.in_blocks(docs, normalise, "b"))
    assert ladder.parts == [3, 9, 18] and ladder.blocks == 12
    assert sorted(map(tuple, S.dedup(docs, 2).collect()), key=repr) == brute_force([(r["doc_id"], r["text"]) for r in awkward.collect()])


def test_the_query_probes_compacted_runs(awkward, monkeypatch):
    runs, compactions, probe, compact = [], [], S.FingerprintIndex.probe, S.FingerprintIndex.compact
    monkeypatch.setattr(S.FingerprintIndex, "probe", lambda self, *a, **k: (runs.append(len(self.runs)), probe(self, *a, **k))[1])
    monkeypatch.setattr(S.FingerprintIndex, "compact", lambda self: (compactions.append(len(self.runs)), compact(self))[1])
    S.dedup(awkward).count()
    assert compactions == [S.FAN_IN + 1] and runs == [S.BATCHES - S.FAN_IN]


def test_few_files_are_written_on_the_way(awkward):
    """Each file and folder on a file: path costs the executor a process of its own, so that batches have no files apart."""
    first = len(shared._MADE)
    S.dedup(awkward).count()
    files = {Path(p).name: len([*Path(p.removeprefix("file://")).rglob("*.parquet")]) for p in shared._MADE[first:]}
    assert set(files) == {"blocks", "flushed", "run", "flags"}
    assert 0 < files["flushed"] <= files["blocks"] <= 3


def test_runs_of_one_table_are_read_in_one_pass(spark):
    rows = [(b, b % 3, bytes([b]), b % 5) for b in range(20)]
    table = shared.store(spark.createDataFrame(rows, B.ASK + ", grp int"), "flushed")
    index = S.FingerprintIndex(spark)
    index.append(spark.createDataFrame([(99, 0, b"z")], B.ASK))
    for g in (0, 2, 3):
        index.append(table, g)
    found = index.history()
    assert sorted(tuple(r) for r in found.collect()) == sorted([r[:3] for r in rows if r[3] in (0, 2, 3)] + [(99, 0, b"z")])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_empty_table(nothing):
    assert S.dedup(nothing).count() == 0


def test_texts_are_returned_on_request(spark):
    w = " ".join(f"w{i}" for i in range(40))
    got = {r["doc_id"]: r["text"] for r in S.dedup(spark.createDataFrame([(1, f"x {w} y"), (2, w), (3, "z")], "doc_id long, text string"), texts=True).collect()}
    assert got == {1: "x y", 2: "", 3: "z"}


def test_equal_windows_have_equal_anchors_wherever_they_stand():
    rnd = np.random.default_rng(4)
    words = [f"w{i}" for i in rnd.integers(0, 9, 200)]
    a = S.entries(" ".join(words).encode())
    b = S.entries(" ".join(["pre", "fix", *words]).encode())
    by_window = lambda e: {p: int(v) for v, f, last in zip(e[0], e[2], e[3], strict=True) for p in range(f, last + 1)}
    x, y = by_window(a), by_window(b)
    assert all(x[p] == y[p + 2] for p in x)


def test_compaction_keeps_what_the_runs_say(spark):
    rnd = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{k}" for k in rnd.integers(0, 12, 120))) for i in range(12)] + [(99, " ".join(f"w{k}" for k in range(50)))] * 2
    frames = [B.in_blocks(spark.createDataFrame([d], "doc_id long, text string"), normalise, "b") for d in docs]
    flushed = [B.ask(f, S.entries_of, 8, "flushed") for f in frames]
    index = S.FingerprintIndex(spark)
    for f in flushed[:-1]:
        index.append(f)
    assert len(index.runs) <= S.FAN_IN
    plain = S.FingerprintIndex(spark)
    plain.runs = flushed[:-1]
    flags = lambda ix: sorted((r["p"], bytes(r["data"])) for r in ix.probe(flushed[-1]).collect())
    assert flags(index) == flags(plain)
    assert any(B.expand(d, np.uint8).any() for _, d in flags(index))


def test_arrays_survive_the_wire():
    rnd = np.random.default_rng(6)
    for n in (0, 1, 1000):
        x = np.zeros(n, S.ENTRY)
        x["v"], x["s"], x["n"] = np.sort(rnd.integers(0, 1 << 63, n).astype(np.uint64)), rnd.integers(0, 1 << 63, n), rnd.integers(0, 255, n)
        assert (B.expand(B.squeeze(x, True), S.ENTRY, True) == x).all()
        assert (B.expand(B.squeeze(x["n"]), np.uint8) == x["n"]).all()
        parts = B.deal(x, 1, 7)
        assert (B.gather([p["n"] for p in parts], x, 1, 7) == x["n"]).all()
        some = parts[3]
        assert (B.gather([p["n"] for p in B.deal(some, 7, 35)], some, 7, 35) == some["n"]).all()
