"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table cuts space by ``HASHES`` random Gaussian projections, shifted and divided into cells of
``width`` times the median norm; a vector's bucket is the tuple of its cells. A query probes its own bucket
and then perturbed ones. Projections of a neighbour at distance d differ from the query's by a Gaussian of
standard deviation d, which gives the probability that the neighbour lies one cell down, in the same cell,
or one cell up, for each hash; a perturbed bucket's estimated success is the product over its hashes, and
buckets are visited in the order of it.

A first round visits the ``FIRST`` best buckets of one table. The distance of the k-th row found bounds the
distances looked for, and with them the estimated recall so far. Queries below ``AIM`` go on to a second
round over all ``TABLES`` tables, each with as many probes as the estimate asks for. Rows of all probed
buckets are ranked by their exact distance in double precision. A query that still has fewer rows than it
should return is compared with every row of the index.

Every vector is in the index. Rows and probes meet by parts, which hold many buckets each; a row is
shuffled once for each table, beside nothing but its id and bucket, and a query goes once to each part that
holds one of its buckets, where its probes are made again. A part of more than twice its due is dealt by
id to several tasks, all of which its queries reach. Of vectors that occur more than ``HOT`` times the
smallest ids alone are in the index, as many as a query can return.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
neither as rows nor as queries; only vectors of the query's own dimension are candidates; rows that
repeat id and vector are one, an id with two vectors is two rows; an empty table gives an empty result.
"""

from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from math import erf, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.shared import store

TABLES, HASHES, WIDTH, SEED = 3, 8, 2.0, 911
FIRST, FIRST_SIGMA, AIM = 64, 0.2, 0.95
HOT, PART_BYTES = 64, 16 << 20
MAX_BROADCAST_ROWS = 200_000  #: of some 20 bytes each
QUICK, FULL, ALL = 0, 1, 2  #: what a query visits: the first round's buckets, the second's, every row


class Hashes:
    """The projections of all tables for one dimension."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int):
        draw = np.random.Generator(np.random.PCG64([seed, dim]))
        self.a = draw.standard_normal((tables, hashes, dim))
        self.b = draw.random((tables, hashes)) * width
        self.salt = draw.integers(0, 1 << 63, (tables, hashes), np.uint64)
        self.width, self.dim, self.tables = width, dim, tables
        #: every way to step one cell down or up, or not, in each hash
        self.steps = np.array(list(product((0, 1, 2), repeat=hashes)), np.int8)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections in units of the width: (rows, tables, hashes)."""
        return (np.einsum("nd,tmd->ntm", x, self.a) + self.b) / self.width

    def parts_of_code(self, table: int, cells: np.ndarray) -> np.ndarray:
        """For each cell of each hash its share of the bucket's number."""
        with np.errstate(over="ignore"):
            x = (cells.astype(np.int64).view(np.uint64) + self.salt[table]) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def codes(self, table: int, cells: np.ndarray) -> np.ndarray:
        """The number of each bucket (rows of cells): a sum, so that perturbed buckets are sums, too."""
        return self.parts_of_code(table, cells).sum(axis=-1, dtype=np.uint64)

    def success(self, place: np.ndarray, sigma: float) -> np.ndarray:
        """Estimated success of every step of ``steps`` for a neighbour whose projections differ by sigma widths."""
        inside = place - np.floor(place)
        edges = [[0.5 * (1 + erf((k - u) / (sigma * sqrt(2)))) for k in (-1, 0, 1, 2)] for u in inside.tolist()]
        p = np.diff(np.array(edges), axis=1)
        return p[np.arange(len(p)), self.steps].prod(axis=1)

    def probed(self, table: int, place: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        base = np.floor(place).astype(np.int64)
        each = np.stack([self.parts_of_code(table, base + s) for s in (-1, 0, 1)], axis=1)
        return each[np.arange(len(base)), self.steps[chosen]].sum(axis=1, dtype=np.uint64)

    def visits(self, x: np.ndarray, mode: int, sigma: float) -> tuple[list[np.ndarray], float]:
        """The buckets of each table that a query visits, best first, and the estimated recall at sigma."""
        place = self.places(x[None])[0]
        if mode == QUICK:
            order = np.argsort(-self.success(place[0], FIRST_SIGMA), kind="stable")[:FIRST]
            return [self.probed(0, place[0], order)], float(self.success(place[0], sigma)[order].sum())
        by = [self.success(place[t], sigma) for t in range(self.tables)]
        orders = [np.argsort(-s, kind="stable") for s in by]
        missed = np.prod([1 - np.cumsum(s[o]) for s, o in zip(by, orders, strict=True)], axis=0)
        count = min(int(np.searchsorted(-missed, AIM - 1)) + 1, len(missed))
        return [self.probed(t, place[t], orders[t][:count]) for t in range(self.tables)], float(1 - missed[count - 1])


@lru_cache(8)
def hashes_of(dim: int, tables: int, hashes: int, width: float, seed: int) -> Hashes:
    return Hashes(dim, tables, hashes, width, seed)


def usable(v: str) -> str:
    return f"{v} is not null and size({v}) > 0 and forall({v}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({v}, x -> x <> 0)"


def by_dim(lists: pa.Array) -> dict[int, np.ndarray]:
    """Positions of the vectors of each dimension."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    return {int(d): np.flatnonzero(n == d) for d in np.unique(n)}


def matrix(lists: pa.Array, at: np.ndarray, dim: int) -> np.ndarray:
    return lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def few(large: DataFrame) -> DataFrame:
    """``large`` to be broadcast if its rows are few."""
    return F.broadcast(large) if large.count() <= MAX_BROADCAST_ROWS else large


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, v) of the usable vectors; of those that occur very often only the ``k`` smallest ids."""
    raw = vectors.select("vec_id", F.col("embedding").alias("v")).where(usable("v") + " and vec_id is not null").withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    hot = store(raw.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where(f"c > {HOT}").select("h1", "h2"), "hot")
    hot = few(hot)
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    thin = raw.join(hot, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "vec_id").agg(F.first("v").alias("v")).withColumn("r", first).where(f"r <= {k}")
    return raw.join(hot, ["h1", "h2"], "left_anti").select("vec_id", "v").unionByName(thin.select("vec_id", "v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score for ``queries`` (vec_id, embedding) against ``vectors`` (vec_id, embedding)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = entries(vectors, k + 1)
    asked = store(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).where(usable("q") + " and query_id is not null").distinct(), "asked")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(norm, 0.5).alias("norm"), F.max(F.size("v")).alias("dim")).first()
    width = width * (seen["norm"] or 1.0)
    part_rows = max(1000, PART_BYTES // (8 * (seen["dim"] or 1)))

    def own(dim: int) -> Hashes:
        return hashes_of(dim, tables, hashes, width, seed)

    def indexed(used: int, parts: int) -> DataFrame:
        """(part, t, code, vec_id, v): each row once for each of so many tables."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, at in by_dim(batch.column(1)).items():
                    for few_at in np.array_split(at, len(at) // 2048 + 1):
                        some = batch.take(pa.array(few_at))
                        place = np.floor(own(dim).places(matrix(batch.column(1), few_at, dim))).astype(np.int64)
                        for t in range(used):
                            code = own(dim).codes(t, place[:, t])
                            part = pa.array((code % np.uint64(parts)).astype(np.int32))
                            yield pa.RecordBatch.from_arrays([part, pa.array([t] * len(code), pa.int32()), pa.array(code.view(np.int64)), some.column(0), some.column(1)], ["part", "t", "code", "vec_id", "v"])

        return rows.mapInArrow(run, f"part int, t int, code long, vec_id long, v {kind}")

    def rank(held: pa.Table, asking: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = [], [], []
        lists, ids, t = held.column("v").combine_chunks(), held.column("vec_id").to_numpy(), held.column("t").to_numpy()
        code = held.column("code").to_numpy().view(np.uint64)
        for dim, at in by_dim(lists).items():
            order = at[np.argsort(code[at], kind="stable")]
            x, sorted_code, own_ids, first = matrix(lists, order, dim), code[order], ids[order], t[order] == 0
            for q, vector, mode, sigma in zip(*(asking.column(c).to_pylist() for c in ("query_id", "q", "mode", "sigma")), strict=True):
                if len(vector) != dim:
                    continue
                vector = np.array(vector, np.float64)
                if mode == ALL:
                    hit = np.flatnonzero(first)
                else:
                    wanted = np.unique(np.concatenate(own(dim).visits(vector, mode, sigma)[0]))
                    low, high = np.searchsorted(sorted_code, wanted), np.searchsorted(sorted_code, wanted, "right")
                    width_ = high - low
                    hit = np.arange(int(width_.sum())) - np.repeat(np.cumsum(width_) - width_, width_) + np.repeat(low, width_)
                hit = hit[own_ids[hit] != q]
                d = np.sqrt(((x[hit] - vector) ** 2).sum(axis=1))
                many = (k + 1) * tables  # a row is found by as many tables as there are at most
                if len(d) > many:
                    near = d <= np.partition(d, many)[many]
                    hit, d = hit[near], d[near]
                best = sorted({(score, vec) for score, vec in zip(d.tolist(), own_ids[hit].tolist(), strict=True)})[:k]
                out[0].extend([q] * len(best))
                out[1].extend([v for _, v in best])
                out[2].extend([s for s, _ in best])
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    def found_by(asking: DataFrame, used: int, name: str) -> DataFrame:
        """(query_id, vec_id, score): the best of each part that a query (query_id, q, mode, sigma) visits."""
        parts = max(1, -(-seen["n"] * used // part_rows))

        def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    vector, mode = np.array(batch.column(1)[i].as_py(), np.float64), batch.column(2)[i].as_py()
                    if mode == ALL:
                        part = np.arange(parts)
                    else:
                        codes = np.concatenate(own(len(vector)).visits(vector, mode, batch.column(3)[i].as_py())[0])
                        part = np.unique(codes % np.uint64(parts))
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.take(pa.array([i] * len(part))).columns], ["part", "query_id", "q", "mode", "sigma"])

        index = indexed(used, parts)
        large = store(index.groupBy("part").agg(F.count(F.lit(1)).alias("c")).where(f"c > {2 * part_rows}").select("part", F.ceil(F.col("c") / part_rows).cast("int").alias("split")), "large")
        split = F.coalesce("split", F.lit(1))
        large = few(large)
        dealt = index.join(large, "part", "left").withColumn("sub", F.pmod(F.xxhash64("vec_id"), split).cast("int")).drop("split")
        aim = asking.mapInArrow(aimed, f"part int, query_id long, q {kind}, mode int, sigma double")
        aim = aim.join(large, "part", "left").withColumn("sub", F.explode(F.sequence(F.lit(0), split - 1))).drop("split")
        met = dealt.groupBy("part", "sub").cogroup(aim.groupBy("part", "sub")).applyInArrow(rank, "query_id long, vec_id long, score double")
        return store(met, name)

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries whose estimated recall is too low, with the distance to look for in widths."""
        for batch in batches:
            keep, sigmas = [], []
            for i, (vector, d) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                sigma = max(d / width, 1e-6) if d is not None else 1.0
                if d is None or own(len(vector)).visits(np.array(vector, np.float64), QUICK, sigma)[1] < AIM:
                    keep.append(i)
                    sigmas.append(sigma)
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([FULL] * len(keep), pa.int32()), pa.array(sigmas, pa.float64())], ["query_id", "q", "mode", "sigma"])

    quick = asked.select("query_id", "q", F.lit(QUICK).alias("mode"), F.lit(FIRST_SIGMA).alias("sigma"))
    found = found_by(quick, 1, "quick")
    farthest = best_of(found, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.max("score").alias("d"))
    known = asked.join(farthest, "query_id", "left").select("query_id", "q", F.when(F.col("c") >= k, F.col("d")).alias("d"))
    unsure = store(known.mapInArrow(sure, f"query_id long, q {kind}, mode int, sigma double"), "unsure")
    if not unsure.isEmpty():
        found = found.unionByName(found_by(unsure, tables, "full"))
    counts = best_of(found, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("c"))
    short = store(asked.join(counts, "query_id", "left").where(f"coalesce(c, 0) < {k}").select("query_id", "q", F.lit(ALL).alias("mode"), F.lit(1.0).alias("sigma")), "short")
    if not short.isEmpty():
        found = found.unionByName(found_by(short, 1, "every"))
    return best_of(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best_of(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", place).where(F.col("rank") <= k)


def digest(vectors: DataFrame, every: int = 100) -> DataFrame:
    """The nearest ten of each row whose vec_id is divisible by ``every``."""
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0))
