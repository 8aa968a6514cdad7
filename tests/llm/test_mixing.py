import duckdb
import numpy as np
import pytest

from loamgrid.llm import mixing as M


def test_targets_are_reshared_until_none_is_above():
    got = M.targets([100, 1000, 10], [5, 2, 1])
    assert got[0] == 300 and got[2] == 30 and got[1] == pytest.approx(780)
    assert sum(M.targets([5, 5, 5], [5, 2, 1])) == pytest.approx(15)
    assert M.targets([0, 10], [5, 2]) == [0, 10] and M.targets([], []) == []


def test_the_tree_keeps_quotas_exactly():
    quotas = np.array([13, 0, 101, 7])
    shards = M.split(quotas, 16, 5)
    assert (shards.sum(axis=0) == quotas).all() and (shards >= 0).all()
    sizes = shards.sum(axis=1)
    assert sizes.max() - sizes.min() <= 2
    assert (shards == M.split(quotas, 16, 5)).all()


def test_shards_draw_disjoint_copies():
    plan = M.Plan([("a", b, 50) for b in range(20)] + [(None, 0, 9)] + [("b", b, 5) for b in range(9)])
    keys = [(i, b, c) for i, b, c, _ in plan.rows]
    assert len(set(keys)) == len(keys)
    assert plan.sources == ["a", "b", None]


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rnd.integers(1, 90))), f"s{i % 4}" if i % 9 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    a, b = (M.digest(df).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    a["shards"], b["shards"] = (x.shards.map(list) for x in (a, b))
    assert a.equals(b) and len(a) == 1500
    assert (a.taken <= 3 * a["size"]).all()
    a["source"] = [s or "~" for _, _, s in rows]
    for _, g in a.groupby("source"):
        assert abs(g.taken.sum() / g.target.iloc[0] - 1) < 0.02


SIZES = """
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s GROUP BY source),
c AS (SELECT *, 3.0 * n / w AS level FROM t),
l AS (SELECT coalesce(max(x), 'inf'::DOUBLE) AS level FROM (  -- what a unit of weight gets when all sources up to a level are full
 SELECT ((SELECT sum(n) FROM c) - sum(CASE WHEN b.level < a.level THEN 3 * b.n ELSE 0 END)) / sum(CASE WHEN b.level < a.level THEN 0 ELSE b.w END) AS x FROM c a, c b GROUP BY a.level HAVING x <= a.level))
SELECT doc_id, size, n, least(3.0 * n, w * (SELECT level FROM l)) FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source"""


def test_sizes_and_targets_against_sql(spark, awkward):
    tables = [spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), awkward.select("doc_id", "text", "source")]
    tables.append(spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(5, "a"), (2, "b"), (900, "c"), (1, None), (70, "d")])], "doc_id long, text string, source string"))
    for docs in tables:
        con = duckdb.connect()
        con.register("documents", docs.select("doc_id", "text", "source").toArrow())
        want = sorted(((d, s, n, round(t, 6)) for d, s, n, t in con.execute(SIZES).fetchall()), key=repr)
        assert want == sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in M.digest(docs).collect()), key=repr)


def test_shards_come_from_the_tree(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    df = spark.createDataFrame([(i, " ".join(["w"] * int(rnd.integers(1, 90))), f"s{i % 4}") for i in range(900)], "doc_id long, text string, source string")
    shards = lambda: {r["doc_id"]: r["shards"] for r in M.digest(df).collect()}
    own, order = shards(), [r["doc_id"] for r in M.mix(df).collect()]
    flat = [s for v in own.values() for s in v]
    assert set(flat) == set(range(M.SHARDS)) and max(np.bincount(flat)) < 4 * len(flat) / M.SHARDS
    first = [k for k, v in own.items() if 0 in v]
    assert set(order[: len(first)]) == set(first)  # the mix is laid out by shards

    def all_left(quotas, shards, seed):
        return np.concatenate([quotas[None], np.zeros((shards - 1, len(quotas)), np.int64)])

    monkeypatch.setattr(M, "split", all_left)
    assert shards() != own and set(s for v in shards().values() for s in v) == {0}


def test_blocks_and_shards_grow_with_the_words(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 500)
    monkeypatch.setattr(M, "SHARD_WORDS", 400)
    df = spark.createDataFrame([(i, "w " * 40, f"s{i % 2}") for i in range(2000)], "doc_id long, text string, source string")
    rows = M.sized(df, 1, ["doc_id"])
    counts = M.block_counts(rows)
    assert [n for _, n in sorted(counts)] == [82, 82]
    plan = M.plan_of(M.blocked(rows, counts, 1))
    assert plan.shards == 200 and plan.per_shard.sum() == len(plan.rows)
    assert max(b for _, b, _, _ in plan.rows) > 64
    monkeypatch.setattr(M, "MAX_BROADCAST_ROWS", 0)
    got = M.digest(df).toPandas()
    assert abs(got.taken.sum() / 80_000 - 1) < 0.02 and (got.taken == got["copies"] * got["size"]).all()


def test_awkward_rows(awkward):
    rows = M.digest(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3 for r in rows)
    out = M.mix(awkward)
    assert out.columns == awkward.columns and out.count() == sum(r["copies"] for r in rows)


def test_empty_table(nothing):
    assert M.digest(nothing).count() == 0 and M.mix(nothing).count() == 0
