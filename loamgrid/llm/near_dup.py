"""Near-duplicate documents by BagMinHash signatures, banding and exact verification.

A document is the multiset of its 5-word shingles; similarity is the weighted Jaccard index of the
counts, and two documents are linked from 0.8 upwards. Classes are the components of the links.

*Signature.* Weights are discretised at the integers and grouped in dyadic intervals (0,1], (1,2], (2,4],
(4,8] ... Each pair of a shingle and an interval has a Poisson process of its own, of a rate equal to the
interval's length; each of its points has a place in the interval, which splits the interval's process
into those of its weights, and a slot of the signature. A point counts for a document whose weight
reaches its place. A slot keeps the time of its first point, so that two documents agree in a slot with
a probability equal to their weighted Jaccard index, without bias. Processes are followed only up to a
time limit at which all slots are likely to be full; the limit is doubled for documents that still have
an empty slot, which changes no result.

*Candidates.* 25 bands of 4 slots: a pair at the threshold is missed with a probability of 2e-6. Equal
texts are one node from the start. In a bucket all nodes are compared with a leader, the node with most
company over all its buckets. Buckets whose nodes are then of more than one component are gone through
once more: every node outside the bucket's largest component is compared with all nodes of other components
by inverted lists, and a forest of links is returned. No pair inside a component is made, and none across is
left out. Both the largest component and the rest are dealt in parts of bounded number and bytes of texts;
a task holds one part of each, or two of the rest, so that a large component is not copied for each of its
own parts.

Defined cases: documents without words (null, empty, white space) are alone in their classes; documents
of fewer than five words are one shingle of all their words; repeated rows, also of one doc_id, are
copies; a class is named by its smallest doc_id (null if it has none); an empty table has no classes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.shared import store, store_and_sum
from loamgrid.llm.wordhash import bounds, gram_hashes, mix, normalise, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 25, 4
SLOTS = BANDS * BAND_ROWS
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
PHASES = ((0, 5), (5, BANDS))  #: bands whose buckets are gone through together
MAX_PART, PART_CHARS = 4000, 16 << 20  #: nodes and characters of a bucket's part
FEW = 250_000  #: links whose components one task finds; more go by steps over the cluster
TOGETHER = 256  #: documents signed by one set of array operations


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes, sorted, and their counts."""
    norm = normalise(text)
    starts, ends = bounds(norm)
    words = word_hashes(norm, starts, ends)
    if not len(words):
        return words, np.zeros(0, np.int64)
    return np.unique(gram_hashes(words, min(SHINGLE, len(words))), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard index of two multisets."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    common = int(np.minimum(a[1][both], b[1][at[both]]).sum())
    total = int(a[1].sum() + b[1].sum()) - common
    return common / total if total else 0.0


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def step(n: int) -> np.uint64:
    return np.uint64(n * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The times in the slots of each bag; infinite for an empty bag."""
    out = np.full((len(bags), SLOTS), np.inf)
    sizes = np.array([len(b[0]) for b in bags])
    total = np.array([int(b[1].sum()) for b in bags], np.float64)
    owner = np.repeat(np.arange(len(bags)), sizes)
    element = np.concatenate([b[0] for b in bags]) if len(bags) else np.zeros(0, np.uint64)
    weight = np.concatenate([b[1] for b in bags]) if len(bags) else np.zeros(0, np.int64)
    top = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # the last interval that the weight reaches into
    level = np.arange(int((top + 1).sum())) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    owner, element, weight = (np.repeat(x, top + 1) for x in (owner, element, weight))
    length = np.where(level == 0, 1, 2.0 ** np.maximum(level - 1, 0))
    below = np.where(level == 0, 0, length)
    seed = mix(element ^ mix((level + 1).astype(np.uint64) * GOLDEN))
    limit = SLOTS / np.maximum(total, 1) * (np.log(SLOTS) + 3)
    open_ = np.flatnonzero(sizes > 0)
    while len(open_):
        out[open_] = np.inf
        mine = np.flatnonzero(np.isin(owner, open_))
        time, turn = np.zeros(len(mine)), 0
        while len(mine):
            x = mix(seed[mine] + step(2 * turn + 1))
            time = time - np.log(uniform(x)) / length[mine]
            live = time <= limit[owner[mine]]
            mine, time = mine[live], time[live]
            y = mix(seed[mine] + step(2 * turn + 2))
            place = below[mine] + np.ceil(uniform(mix(y)) * length[mine])
            counts = place <= weight[mine]
            slot = owner[mine[counts]] * SLOTS + (y[counts] % np.uint64(SLOTS)).astype(np.int64)
            np.minimum.at(out.reshape(-1), slot, time[counts])
            turn += 1
        open_ = open_[np.isinf(out[open_]).any(axis=1)]
        limit[open_] *= 2
    return out


def band_hashes(times: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), BANDS, BAND_ROWS)
    out = np.zeros(x.shape[:2], np.uint64)
    for k in range(BAND_ROWS):
        out = mix(out * np.uint64(31) + x[:, :, k])
    return out.view(np.int64)


def text_key(text: Column) -> list[Column]:
    """128 bits of the text."""
    return [F.xxhash64(text, F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), F.reverse(text)).alias("h2")]


def signed(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, h1, h2, chars, bands) of every row of ``docs``; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                few = batch.slice(at, TOGETHER)
                place: dict[tuple[int, int], int] = {}
                keys = list(zip(few.column(1).to_pylist(), few.column(2).to_pylist(), strict=True))
                bags, texts = [], few.column(3)
                for i, key in enumerate(keys):
                    if key not in place:
                        place[key] = len(bags)
                        bags.append(shingles(texts[i].as_py()))
                bands = band_hashes(signatures(bags))
                own = [bands[place[k]] if len(bags[place[k]][0]) else None for k in keys]
                rid = pa.array(range(base + seq, base + seq + len(keys)), pa.int64())
                seq += len(keys)
                yield pa.RecordBatch.from_arrays([rid, few.column(0), few.column(1), few.column(2), few.column(4), pa.array(own, pa.list_(pa.int64()))], ["rid", "doc_id", "h1", "h2", "chars", "bands"])

    return docs.select("doc_id", *text_key(F.col("text")), "text", F.length("text").cast("long").alias("chars")).mapInArrow(run, "rid long, doc_id long, h1 long, h2 long, chars long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            a, b, left, right = batch.columns
            good = []
            for i, leader in enumerate(a.to_pylist()):
                if leader not in held:
                    if len(held) >= 64:
                        held.clear()
                    held[leader] = shingles(left[i].as_py())
                good.append(similarity(held[leader], shingles(right[i].as_py())) >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("v").alias("b"), F.col("text").alias("right")), "b").join(texts.select(F.col("v").alias("a"), F.col("text").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def parts_of(placed: DataFrame) -> DataFrame:
    """(pos, band, s, t, v, root): the nodes of buckets of several roots, dealt to the tasks s, t.

    The largest root's nodes are in parts s = -1, -2, ..., the others in parts 0, 1, ...; tasks are all pairs
    of a part of the largest with one of the others, and all pairs of two of the others.
    """
    roots = placed.groupBy("pos", "band", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("chars").alias("x"))
    parts = lambda c, x: F.ceil(F.greatest(c / MAX_PART, x / PART_CHARS)).cast("int")
    buckets = roots.groupBy("pos", "band").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root", "x")).alias("m"), F.sum("c").alias("c"), F.sum("x").alias("x")).where("roots > 1")
    buckets = buckets.select("pos", "band", F.col("m.root").alias("main"), parts(F.col("m.c"), F.col("m.x")).alias("own"), parts(F.col("c") - F.col("m.c"), F.col("x") - F.col("m.x")).alias("others"))
    held = placed.select("pos", "band", "v", "root").join(buckets, ["pos", "band"])
    main = held.where("root = main").withColumn("s", -1 - F.pmod(F.xxhash64("v"), F.col("own")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    rest = held.where("root <> main").withColumn("p", F.pmod(F.xxhash64("v"), F.col("others")).cast("int")).withColumn("q", F.explode(F.sequence(-F.col("own"), F.col("others") - 1))).where("p <> q")
    rest = rest.withColumn("s", F.least("p", "q")).withColumn("t", F.greatest("p", "q"))
    return main.unionByName(rest, True).select("pos", "band", "s", "t", "v", "root")


def linked_in_buckets(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between nodes of different roots that share a bucket, enough of them to join what belongs together.

    A task gets nodes of a bucket's largest root and of others, or of others alone (``parts_of``). It finds
    the common shingles of each node of another root with all nodes by an inverted list and keeps a forest,
    so that it returns fewer links than it has nodes, though it compares all of different roots.
    """
    rows = parts_of(placed).join(texts, "v")

    def run(table: pa.Table) -> pa.Table:
        v, root = table.column("v").to_numpy(), table.column("root").to_numpy()
        bags = [shingles(t.as_py()) for t in table.column("text")]
        _, group, members = np.unique(root, return_inverse=True, return_counts=True)
        forest = list(range(len(members)))

        def top(i: int) -> int:
            while forest[i] != i:
                forest[i] = forest[forest[i]]
                i = forest[i]
            return i

        sizes = np.array([len(b[0]) for b in bags])
        totals = np.array([int(b[1].sum()) for b in bags])
        hashes, counts = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
        owner = np.repeat(np.arange(len(bags)), sizes)
        order = np.argsort(hashes, kind="stable")
        hashes, counts, owner = hashes[order], counts[order], owner[order]
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(group != members.argmax()).tolist():
            own, n = bags[i]
            low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
            width = high - low
            at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
            common = np.bincount(owner[at], np.minimum(counts[at], np.repeat(n, width)), len(bags))
            near = np.flatnonzero((common >= THRESHOLD * (totals + totals[i] - common) - 1e-9) & (group != group[i]))
            for j in near.tolist():
                x, y = top(int(group[i])), top(int(group[j]))
                if x != y and similarity(bags[i], bags[j]) >= THRESHOLD:
                    forest[x] = y
                    found.append((int(v[i]), int(v[j])))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("pos", "band", "s", "t").applyInArrow(run, "a long, b long")


def roots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, root) of the nodes of edges (u, v) that are not the smallest of their component."""
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while (j := up.get(i, i)) != i:
            up[i] = up.get(j, j)
            i = j
        return i

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = top(u), top(v)
            if x != y:
                up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(i) for i in list(up)], pa.int64())], ["v", "root"])


def components(links: DataFrame) -> DataFrame:
    """(v, root) of the nodes of ``links`` (a, b) that have a smaller one in reach: the smallest.

    Links that fit a task with ease (``FEW``) are joined in one. Else alternating large-star and small-star
    steps; each result is written, so that no plan grows and no step is lost with an executor.
    """
    edges, seen = store_and_sum(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", F.count(F.lit(1)).alias("n"))
    if seen.get("n", 0) <= FEW:
        return store(edges.coalesce(1).mapInArrow(roots_of, "v long, root long"), "roots")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges, now = store_and_sum(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30))).alias("s"))
        if now == before:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rid, doc_id, h1, h2) of every row, (h1, h2, v, root, class_id, keep_doc) of every distinct text with words)."""
    rows = store(signed(docs), "signed")
    nodes = store(rows.where("bands is not null").groupBy("h1", "h2").agg(F.min("rid").alias("v"), F.min("doc_id").alias("doc_id"), F.first("chars").alias("chars"), F.first("bands").alias("bands")), "nodes")
    places = nodes.select("v", "chars", F.posexplode("bands").alias("pos", "band"))
    sizes = places.groupBy("pos", "band").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least")).where("n > 1").select("pos", "band", "n")
    members = store(places.join(sizes, ["pos", "band"]), "members")
    company = store(members.groupBy("v").agg(F.sum("n").alias("company")), "company")
    members = store(members.join(company, "v"), "members")
    wanted = nodes.join(company.select("v"), "v").select("h1", "h2", F.col("doc_id").alias("_d"), "v")
    keyed = docs.select("doc_id", *text_key(F.col("text")), "text").alias("d")
    texts = store(keyed.join(wanted.alias("w"), (F.col("d.h1") == F.col("w.h1")) & (F.col("d.h2") == F.col("w.h2")) & F.col("d.doc_id").eqNullSafe(F.col("w._d"))).select("v", "text").dropDuplicates(["v"]), "texts")  # written, so that a hot leader's pairs can be split
    best = members.groupBy("pos", "band").agg(F.max(F.struct("company", (-F.col("v")).alias("w"))).alias("b")).select("pos", "band", (-F.col("b.w")).alias("a"))
    pairs = members.join(best, ["pos", "band"]).where("a <> v").select("a", F.col("v").alias("b")).distinct()
    tested = store(pairs, "pairs")
    links = store(verified(tested, texts), "links")
    for low, high in PHASES:
        roots = components(links)
        placed = members.where(f"pos >= {low} and pos < {high} and n > 2").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
        links = links.unionByName(store(linked_in_buckets(placed, texts), "links"))
    roots = components(links)
    full = nodes.select("h1", "h2", "v", "doc_id").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = full.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rows.drop("bands", "chars"), store(full.join(least, "root").select("h1", "h2", "v", "doc_id", "root", "class_id"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id of every row of ``docs`` (doc_id, text)."""
    rows, found = classes(docs)
    named = rows.join(found.select("h1", "h2", "class_id", "v"), ["h1", "h2"], "left")
    return named.select("doc_id", F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the smallest doc_id, and every row without words; columns as they came."""
    _, found = classes(docs)
    first = found.where("doc_id <=> class_id").groupBy("root").agg(F.min(F.struct("v", "h1", "h2", "doc_id")).alias("k")).select("k.h1", "k.h2", F.col("k.doc_id").alias("_d"), F.lit(True).alias("_first"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *text_key(F.col("text")), F.col("doc_id").alias("_d"), F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("_words"))
    worded = own.where("_words").alias("o").join(first.alias("f"), (F.col("o.h1") == F.col("f.h1")) & (F.col("o.h2") == F.col("f.h2")) & F.col("o._d").eqNullSafe(F.col("f._d"))).select("o._row", F.col("o.h1").alias("h1"), F.col("o.h2").alias("h2"), F.col("o._d").alias("_d"))
    rank = F.row_number().over(Window.partitionBy("h1", "h2", "_d").orderBy("h1"))
    kept = worded.withColumn("_rank", rank).where("_rank = 1").select("_row")
    return kept.unionByName(own.where("not _words").select("_row")).select("_row.*")
