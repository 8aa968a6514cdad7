import numpy as np

from loamgrid.llm import neighbours as N


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(x, qid, k=10):
    d = np.sqrt(((x - x[qid]) ** 2).sum(axis=1))
    d[qid] = np.inf
    return np.lexsort((np.arange(len(d)), d))[:k], d


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def recall(got, x, every=100):
    found = []
    for qid in range(0, len(x), every):
        best, d = brute(x, qid)
        own = got[got.query_id == qid].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own.score, d[own.vec_id], atol=0, rtol=1e-15)
        assert sorted(zip(own.score, own.vec_id, strict=True)) == list(zip(own.score, own.vec_id, strict=True))
        found.append(len(set(best) & set(own.vec_id)) / 10)
    return np.mean(found)


def test_recall_and_scores_against_brute_force_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.stack(table.orderBy("vec_id").toPandas().embedding).astype(float)
    assert x.shape[1] == 64 and recall(N.digest(table).toPandas(), x) >= 0.9


def test_recall_in_64_dimensions_with_structure_and_another_scale(spark):
    rnd = np.random.default_rng(7)
    x = unit(rnd.standard_normal((40, 64))[rnd.integers(0, 40, 2500)] + 0.25 * rnd.standard_normal((2500, 64))) * np.float32(37)
    got = N.digest(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).toPandas()
    assert recall(got, x.astype(float)) >= 0.9


def reached(x, queries):
    """Share of rows compared, and recall, of the two rounds: by this test's own loop over the buckets."""
    h = N.Hashes(x.shape[1], N.TABLES, N.HASHES, N.WIDTH, N.SEED)
    cells = np.floor(h.places(x)).astype(np.int64)
    codes = [h.codes(t, cells[:, t]) for t in range(N.TABLES)]
    share, found = [], []
    for q in queries:
        best, d = brute(x, q)
        hit = np.isin(codes[0], h.visits(x[q], N.QUICK, N.FIRST_SIGMA)[0][0])
        near = np.sort(d[hit])[:10]
        far = near[9] if len(near) == 10 and np.isfinite(near[9]) else None
        if far is None or h.visits(x[q], N.QUICK, far / N.WIDTH)[1] < N.AIM:
            for t, wanted in enumerate(h.visits(x[q], N.FULL, far / N.WIDTH if far else 1.0)[0]):
                hit |= np.isin(codes[t], wanted)
        share.append(hit.mean())
        found.append(hit[best].mean())
    return np.mean(share), np.mean(found)


def test_vectors_with_structure_are_found_without_a_scan():
    rnd = np.random.default_rng(3)
    x = unit(rnd.standard_normal((200, 64))[rnd.integers(0, 200, 20_000)] + 0.25 * rnd.standard_normal((20_000, 64))).astype(float)
    share, found = reached(x, range(0, 20_000, 500))
    assert share < 0.2 and found >= 0.9


def test_awkward_vectors(spark):
    same = [0.5, 0.5]
    rows = [(0, same, 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 1), (5, [], 1), (6, [float("inf"), 1.0], 1), (None, same, 1), (100, [0.0, 0.0], None), (200, [1.0, 2.0, 3.0], 1), (201, [1.0, 2.0, 4.0], 1)]
    rows += [(1000 + k, same, 2) for k in range(30)] + [(1000, same, 2)] * 3
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in N.digest(frame(spark, rows)).collect()}
    assert [got[0, k] for k in range(1, 11)] == [(1000 + k, 0.0) for k in range(10)]
    assert got[200, 1] == (201, 1.0) and (200, 2) not in got
    assert not any(q == 100 for q, _ in got)
    assert got[1000, 1] == (0, 0.0) and got[1000, 2] == (1001, 0.0)


def test_probes_come_in_the_order_of_their_estimated_success():
    h = N.Hashes(16, 2, 4, 2.0, 1)
    x = np.random.default_rng(2).standard_normal(16)
    place = h.places(x[None])[0]
    p = h.success(place[0], 0.3)
    assert len(p) == 81 and 0.9 < p.sum() <= 1 + 1e-9
    moved = place[0] + 0.3 * np.random.default_rng(4).standard_normal((40_000, 4))
    step = np.floor(moved).astype(int) - np.floor(place[0]).astype(int) + 1
    seen = np.array([(step == s).all(axis=1).mean() for s in h.steps])
    assert np.abs(seen - p).max() < 0.01
    first = h.visits(x, N.QUICK, 0.3)[0][0]
    assert first[0] == h.probed(0, place[0], np.array([p.argmax()]))[0]
    cells = np.floor(place[0]).astype(np.int64) + h.steps[7] - 1
    assert h.probed(0, place[0], np.array([7]))[0] == h.codes(0, cells[None])[0]


def test_a_very_common_vector_and_parts_that_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(N, "PART_BYTES", 1)
    rnd = np.random.default_rng(11)
    x = unit(rnd.standard_normal((4500, 8)))
    x[1500:3000] = x[7]
    x[3000:] = unit(x[9] + 0.001 * rnd.standard_normal((1500, 8)))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = N.digest(frame(spark, rows + rows[7:8] * 100)).toPandas()
    assert recall(got, x.astype(float)) >= 0.9
    assert got[got.query_id == 1500].vec_id.tolist() == [7, *range(1501, 1510)]


def test_empty_table(spark):
    assert N.digest(frame(spark, [])).count() == 0
