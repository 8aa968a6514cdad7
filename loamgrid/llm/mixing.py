"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source's documents fall into blocks by a hash of the document, as many as its words and documents
   ask for (``BLOCK_WORDS``). A source's quota is counted in whole passes over its blocks and a last, partial
   pass: permuted blocks as they fit, and a part of one more, cut at the document nearest to the target.
2. A binary tree splits the quotas among the output shards, as many as the mix's words ask for
   (``SHARD_WORDS``). At each node the number of a source's block copies that go left is a multivariate
   hypergeometric draw, seeded by the node, so that the counts below a node always add up to its own.
3. A leaf takes the next copies of each source's permuted blocks, in the order of the leaves: what
   the shards draw is disjoint. Documents are shuffled inside their shard by a keyed hash; a document's
   shards are part of the result.

The driver sees one row for each source and one for each block, a corpus of 100 TB having some million
blocks. They are broadcast up to ``MAX_BROADCAST_ROWS`` and joined by a shuffle beyond. Only blocks that are
cut, at most one for each source, are ordered by a window, and a block is bounded. Everything is a function
of the documents and the seed, so that reruns agree.

Defined cases: a null text has no words, and a document without words is in the mix as often as its
block; a null source is a source of its own, the last; repeated rows, and rows that share a doc_id, fall
into one block and are taken alike; an empty table gives an empty mix; a source without words has the
target 0.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.shared import WORD, store

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = 20240613
BLOCK_WORDS = SHARD_WORDS = 16 << 20  #: some 100 MB of text
SHARDS = 16  #: at least
SOURCE_BLOCKS, ALL_BLOCKS = 64, 1 << 16  #: at least so many blocks of a source, while all sources have so many together
MAX_BROADCAST_ROWS = 200_000  #: of some 100 bytes each


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], limit: float = MAX_REPEATS) -> list[float]:
    """Shares of the sum of the sizes by weight; what is above ``limit`` times a size is shared again among the rest."""
    out, rest, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: rest * weights[i] / total for i in open_}
        over = [i for i in open_ if share[i] > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(limit * sizes[i])
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Block copies of each source in each shard: rows are shards, columns sources; columns add up to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(low: int, high: int, have: np.ndarray) -> None:
        if high - low == 1:
            out[low] = have
            return
        middle = (low + high) // 2
        left = int(have.sum()) * (middle - low) // (high - low)
        draw = np.random.Generator(np.random.PCG64([seed, low, high]))
        taken = draw.multivariate_hypergeometric(have, left, method="marginals") if have.sum() else have
        node(low, middle, taken)
        node(middle, high, have - taken)

    node(0, shards, quotas.astype(np.int64))
    return out


class Plan:
    """Which copies of which blocks go to which shard. ``blocks``: (source, block, words) with words > 0 or documents."""

    def __init__(self, blocks: list[tuple], weights=WEIGHTS, shards: int | None = None, seed: int = SEED):
        self.sources = sorted({s for s, *_ in blocks}, key=lambda s: (s is None, s or ""))
        at = {s: i for i, s in enumerate(self.sources)}
        own: list[list[tuple[int, int]]] = [[] for _ in self.sources]
        for s, b, words in sorted(blocks, key=lambda x: (at[x[0]], x[1])):
            own[at[s]].append((b, words))
        self.sizes = [sum(w for _, w in x) for x in own]
        self.targets = targets(self.sizes, [weights[i % len(weights)] for i in range(len(own))])
        self.shards = shards or max(SHARDS, -(-int(sum(self.targets)) // SHARD_WORDS))
        copies: list[list[tuple[int, int]]] = []  # of each source: (block, copy) in permuted order
        self.cuts: dict[tuple[int, int], tuple[int, int]] = {}  # (source, block): the partial copy and its words
        for i, x in enumerate(own):
            whole = int(self.targets[i] // self.sizes[i]) if self.sizes[i] else 0
            rest = self.targets[i] - whole * self.sizes[i]
            order = np.random.Generator(np.random.PCG64([seed, i])).permutation(len(x))
            mine = [(x[k][0], c) for c in range(whole) for k in order]
            left = []
            for k in order:  # whole blocks as they fit, then a part of the first that did not
                b, words = x[k]
                if not words:
                    continue
                if words <= rest:
                    mine.append((b, whole))
                    rest -= words
                else:
                    left.append(b)
            if left and rest >= 1:
                mine.append((left[0], whole))
                self.cuts[i, left[0]] = whole, int(round(rest))
            shuffled = np.random.Generator(np.random.PCG64([seed, i, 1])).permutation(len(mine))
            copies.append([mine[k] for k in shuffled])
        self.per_shard = split(np.array([len(c) for c in copies], np.int64), self.shards, seed)
        ends = self.per_shard.cumsum(axis=0)
        self.rows = [  # (source, block, copy, shard)
            (i, b, c, int(shard)) for i, mine in enumerate(copies) for (b, c), shard in zip(mine, np.searchsorted(ends[:, i], np.arange(len(mine)), side="right"), strict=True)
        ]


def small(frame: DataFrame, rows: int) -> DataFrame:
    """The frame, to be broadcast if its rows are few."""
    return F.broadcast(frame) if rows <= MAX_BROADCAST_ROWS else frame


def sized(docs: DataFrame, seed: int, keep: list) -> DataFrame:
    """The columns ``keep`` with _source, _size and _key beside them."""
    return docs.select(*keep, F.col("source").alias("_source"), n_words(F.col("text")).alias("_size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.lit(0)).alias("_key"))


def block_counts(rows: DataFrame) -> list[tuple]:
    """(source, number of blocks) of each source."""
    found = rows.groupBy("_source").agg((F.sum("_size") + F.count(F.lit(1))).alias("weight")).collect()
    least = max(1, min(SOURCE_BLOCKS, ALL_BLOCKS // max(1, len(found))))
    return [(r["_source"], max(least, -(-r["weight"] // BLOCK_WORDS))) for r in found]


def blocked(rows: DataFrame, counts: list[tuple], seed: int) -> DataFrame:
    """``rows`` (of ``sized``) with their _block."""
    table = rows.sparkSession.createDataFrame(counts, "_s string, _n long")
    joined = rows.join(small(table, len(counts)), F.col("_s").eqNullSafe(F.col("_source")))
    return joined.withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(1)), F.col("_n"))).select(*rows.columns, "_block")


def plan_of(rows: DataFrame, **options) -> Plan:
    found = rows.groupBy("_source", "_block").agg(F.sum("_size").alias("words")).collect()
    return Plan([(r["_source"], r["_block"], r["words"]) for r in found], **options)


def drawn(rows: DataFrame, plan: Plan) -> DataFrame:
    """``rows`` (of ``blocked``), one for each copy that the mix takes, with _copy and _shard."""
    by_block: dict[tuple[int, int], list] = {}
    for i, b, c, shard in plan.rows:
        by_block.setdefault((i, b), []).append((c, shard))
    table = [(plan.sources[i], b, v, *plan.cuts.get((i, b), (None, None))) for (i, b), v in by_block.items()]
    shares = rows.sparkSession.createDataFrame(table, "_s string, _b long, _copies array<struct<_copy:int,_shard:int>>, _last int, _cut long")
    joined = rows.join(small(shares, len(table)), F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_b") == F.col("_block")))
    whole = joined.where("_cut is null").withColumn("_before", F.lit(None).cast("long"))
    order = Window.partitionBy("_source", "_block").orderBy("_key")  # documents of equal keys come in together
    partial = joined.where("_cut is not null").withColumn("_before", F.sum("_size").over(order) - F.col("_size"))
    each = whole.unionByName(partial).withColumn("_each", F.explode("_copies")).where("_cut is null or _each._copy < _last or _before + _size / 2 <= _cut")
    return each.select(*rows.columns, F.col("_each._copy").alias("_copy"), F.col("_each._shard").alias("_shard"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and shards (one for each copy, ascending) of every document."""
    seed = options.get("seed", SEED)
    rows = store(sized(docs, seed, ["doc_id"]).withColumn("_row", F.monotonically_increasing_id()), "sizes")
    rows = blocked(rows, block_counts(rows), seed)
    plan = plan_of(rows, **options)
    taken = drawn(rows, plan).groupBy("_row").agg(F.sort_array(F.collect_list("_shard")).alias("shards"))
    sources = docs.sparkSession.createDataFrame(list(zip(plan.sources, plan.sizes, plan.targets, strict=True)) or [], "_s string, source_size long, target double")
    out = rows.join(small(sources, len(plan.sources)), F.col("_s").eqNullSafe(F.col("_source"))).join(taken, "_row", "left")
    shards = F.coalesce("shards", F.array().cast("array<int>"))
    copies = F.size(shards).cast("long")
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (copies * F.col("_size")).alias("taken"), copies.alias("copies"), shards.alias("shards"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, with the columns they came with: shard after shard, shuffled inside each.

    Shards are dealt by ranges of shard and order, so that a large one spans several tasks.
    """
    seed = options.get("seed", SEED)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    sizes = store(sized(docs, seed, []), "sizes")
    counts = block_counts(sizes)
    plan = plan_of(blocked(sizes, counts, seed), **options)
    order = F.xxhash64(F.lit(seed), F.col("_key"), F.col("_copy"))
    taken = drawn(blocked(sized(docs, seed, [own]), counts, seed), plan).withColumn("_order", order)
    return taken.repartitionByRange("_shard", "_order").sortWithinPartitions("_shard", "_order").select("_row.*")
