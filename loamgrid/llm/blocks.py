"""Blocks of documents that ask a distributed table, and get their answers back in one piece.

Counting or looking up every word sequence of a corpus by one row each costs far more in row overhead
than in data. Here a block of some megabytes of documents sends, for each of P hash partitions, one
row that holds a sorted array of its distinct keys; a partition merges the arrays of all blocks and
answers each block with one array in the same order; the block's documents and its answers meet again
by the block's number. A key that is very frequent is one entry in each block, so that no partition
gets more of it than there are blocks.

The number of partitions grows with the corpus, so that what a partition merges stays bounded. Up to ``FAN``
partitions a block has a row for each. Beyond, keys go up in levels (``Ladder``): a block deals its keys to
``FAN`` parts, a relay merges one part of about ``FAN`` blocks and deals it to ``FAN`` finer parts, and so
on; answers come down the same way, each relay giving its blocks what they asked for. So the rows of a
block, and those of a relay, are ``FAN`` at most, and all rows together grow with the corpus (times its
logarithm to the base ``FAN``), not with blocks times partitions.

Blocks are written to the shared folder first: their numbers and contents stay as they are, whichever tasks
are run again.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.shared import store

BLOCK_BYTES = 4 << 20
PARTITION_BYTES = 16 << 20
FAN = 512
ROWS = 512
SUMMARY = -1  #: the block number of what a partition says of itself
ASK = "block long, p int, data binary"
Merge = Callable[[list[np.ndarray]], tuple[np.ndarray, list[np.ndarray]]]
Share = Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]]


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def in_blocks(docs: DataFrame, normalise: Callable[[str | None], bytes], name: str, group: Callable[[object], int] | None = None) -> DataFrame:
    """(block, group, n_docs, n_bytes, payload) of ``docs`` (doc_id, text), written to the shared folder.

    group: sorts documents by their id into blocks of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 24, 0
        held: dict[int, tuple[list, list]] = {}
        size: dict[int, int] = {}

        def flush(g: int) -> pa.RecordBatch:
            nonlocal seq
            ids, texts = held.pop(g)
            table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
            row = [base + seq], [g], [len(ids)], [size.pop(g)], [pack(table)]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["block", "grp", "n_docs", "n_bytes", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                few = batch.slice(at, ROWS)
                for doc, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                    g = group(doc) if group else 0
                    ids, texts = held.setdefault(g, ([], []))
                    norm = normalise(text)
                    ids.append(doc)
                    texts.append(norm)
                    size[g] = size.get(g, 0) + len(norm) + 64
                    if size[g] >= BLOCK_BYTES:
                        yield flush(g)
        for g in list(held):
            yield flush(g)

    return store(docs.select("doc_id", "text").mapInArrow(run, "block long, grp int, n_docs long, n_bytes long, payload binary"), name, "none")


def squeeze(x: np.ndarray, steps: bool = False) -> bytes:
    """An array as compressed bytes, byte after byte of each field. steps: of the first field, which ascends, the differences."""
    fields = [x[f] for f in x.dtype.names] if x.dtype.names else [x]
    if steps and len(x):
        fields[0] = np.concatenate([fields[0][:1], np.diff(fields[0])])
    raw = b"".join(np.ascontiguousarray(f).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"" for f in fields)
    return len(x).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(data: bytes, dtype: np.dtype, steps: bool = False) -> np.ndarray:
    n, dtype = int.from_bytes(data[:4], "little"), np.dtype(dtype)
    if not n:
        return np.zeros(0, dtype)
    raw = np.frombuffer(pa.decompress(data[4:], n * dtype.itemsize, codec="zstd", asbytes=True), np.uint8)
    out, at = np.zeros(n, dtype), 0
    for name in dtype.names or [None]:
        kind = dtype[name] if name else dtype
        field = np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel()
        at += n * kind.itemsize
        if steps and at == n * kind.itemsize:
            field = np.cumsum(field, dtype=kind)
        if name:
            out[name] = field
        else:
            out = field
    return out


def documents(payload: bytes) -> tuple[list, list[bytes]]:
    table = unpack(payload)
    return table.column("doc_id").to_pylist(), table.column("text").to_pylist()


class Ladder:
    """The levels between blocks and partitions: ``parts[k]`` parts after the k-th deal; the last are the partitions."""

    def __init__(self, blocks: DataFrame):
        found = blocks.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
        self.blocks = found[1]
        wanted, levels = max(8, -(-(found[0] or 0) // PARTITION_BYTES)), 1
        while FAN**levels < wanted:
            levels += 1
        below = FAN ** (levels - 1)
        self.parts = [FAN**k for k in range(1, levels)] + [-(-wanted // below) * below]

    @property
    def first(self) -> int:
        """Number of parts that a block deals to."""
        return self.parts[0]

    def _relay(self, k: int, by: str | None) -> Column:
        """The relay above a block or relay; about FAN share one, all of the same ``by``."""
        own = F.pmod(F.xxhash64("block") if k == 0 else F.col("block"), F.lit(max(1, -(-self.blocks // FAN ** (k + 1)))))
        return own + F.shiftleft(F.col(by).cast("long"), 40) if by else own

    def up(self, asked: DataFrame, merge: Merge, dtype: np.dtype, wide: np.dtype | None = None, by: str | None = None) -> list[DataFrame]:
        """The rows of each level, from those of the blocks (block, p, data) to those that the partitions get.

        merge: (one sorted array, each array's places in it) of many. wide: what merged arrays are of, if it is not dtype. by: an int
        column by which rows are kept apart.
        """
        levels, keep = [asked], [by] if by else []
        for k in range(len(self.parts) - 1):
            now, then = self.parts[k : k + 2]

            up = levels[-1].withColumn("relay", self._relay(k, by)).groupBy("relay", "p", *keep).applyInArrow(merged_up(merge, dtype if k == 0 else wide or dtype, now, then, keep), ASK + "".join(f", {c} int" for c in keep))
            levels.append(store(up, "relayed", "none"))
        return levels

    def down(self, answers: DataFrame, levels: list[DataFrame], merge: Merge, dtype: np.dtype, kind: np.dtype, wide: np.dtype | None = None, by: str | None = None, share: Share = lambda found, places: [found[at] for at in places]) -> DataFrame:
        """The answers (block, p, data) to the blocks' own rows, from those to the last level's. dtype: of the answers; kind and wide: of what was asked.

        share: what each asker gets of a relay's answers, by its places.
        """
        for k in range(len(self.parts) - 2, -1, -1):
            now, then = self.parts[k : k + 2]

            below = levels[k].withColumn("relay", self._relay(k, by)).select("block", "p", "data", "relay")
            above = answers.where(F.col("block") != SUMMARY).withColumnRenamed("block", "relay").withColumn("part", F.pmod(F.col("p"), F.lit(now)).cast("int"))
            answers = store(below.groupBy("relay", "p").cogroup(above.groupBy("relay", "part")).applyInArrow(shared_down(merge, share, kind if k == 0 else wide or kind, dtype, now, then), ASK), "answers", "none")
        return answers


def merged_up(merge: Merge, kind: np.dtype, now: int, then: int, keep: list[str]) -> Callable[[pa.Table], pa.Table]:
    """One part of many blocks, merged and dealt to finer parts."""

    def run(table: pa.Table) -> pa.Table:
        p, above = table.column("p")[0].as_py(), table.column("relay")[0].as_py()
        total = merge([expand(x.as_py(), kind, True) for x in table.column("data")])[0]
        out = pa.Table.from_batches([rows_of(above, deal(total, now, then), p, now)])
        for c in keep:
            out = out.append_column(c, pa.array([table.column(c)[0].as_py()] * out.num_rows, pa.int32()))
        return out

    return run


def shared_down(merge: Merge, share: Share, kind: np.dtype, dtype: np.dtype, now: int, then: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The answers to one part of many blocks, for each of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pa.array(np.argsort(left.column("block").to_numpy(), kind="stable")))
        total, places = merge([expand(x.as_py(), kind, True) for x in left.column("data")])
        got = {p // now: d for p, d in zip(right.column("p").to_pylist(), right.column("data").to_pylist(), strict=True)}
        found = gather([expand(got[j], dtype) if j in got else np.zeros(0, dtype) for j in range(then // now)], total, now, then)
        return pa.table({"block": left.column("block"), "p": left.column("p"), "data": pa.array([squeeze(x) for x in share(found, places)], pa.binary())})

    return run


def ask(blocks: DataFrame, keys: Callable[[bytes], np.ndarray], n: int, name: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(block, p, data): what ``keys`` makes of a block, dealt by the first field modulo n. Written under a name if it is read more than once.

    keys: gives a structured array, sorted by its first field, a uint64. by: int columns of the blocks that the rows keep.
    """
    by = by or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (block, payload) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                found = keys(payload.as_py())
                if len(found):
                    out = rows_of(block, deal(found, 1, n))
                    for k, c in enumerate(by, 2):
                        out = out.append_column(c, pa.array([batch.column(k)[i].as_py()] * out.num_rows, pa.int32()))
                    yield out

    asked = blocks.select("block", "payload", *by).mapInArrow(run, ASK + "".join(f", {c} int" for c in by))
    return store(asked, name, "none") if name else asked


def part_of(found: np.ndarray, before: int, n: int) -> np.ndarray:
    """The part of each key among n, as a number among those that a part of ``before`` has of them."""
    return (found[found.dtype.names[0]] % np.uint64(n) // np.uint64(before)).astype(np.int64)


def deal(found: np.ndarray, before: int, n: int) -> list[np.ndarray]:
    """The array, all of one part of ``before``, in n / before parts by its first field; the order stays."""
    part = part_of(found, before, n)
    order = np.argsort(part, kind="stable")
    return np.split(found[order], np.searchsorted(part[order], np.arange(1, n // before)))


def gather(parts: list[np.ndarray], found: np.ndarray, before: int, n: int) -> np.ndarray:
    """The answers to ``deal(found, before, n)``, in the order of ``found``."""
    part = part_of(found, before, n)
    order = np.argsort(part, kind="stable")
    out = np.empty(len(found), parts[0].dtype if parts else np.uint8)
    out[order] = np.concatenate(parts) if parts else []
    return out


def rows_of(block: int, parts: list[np.ndarray], part: int = 0, before: int = 1) -> pa.RecordBatch:
    full = [(part + j * before, squeeze(x, True)) for j, x in enumerate(parts) if len(x)]
    return pa.RecordBatch.from_arrays([pa.array([block] * len(full), pa.int64()), pa.array([p for p, _ in full], pa.int32()), pa.array([d for _, d in full], pa.binary())], ["block", "p", "data"])


def answer(asked: DataFrame, reply: Callable[[int, list[np.ndarray]], list[np.ndarray]], dtype: np.dtype, name: str | None) -> DataFrame:
    """(block, p, data): for each partition ``reply(p, arrays of all blocks)``, an array for each block, and perhaps one more for itself. Written under a name if it is read more than once."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        arrays = [expand(x.as_py(), dtype, True) for x in table.column("data")]
        p, numbers = table.column("p")[0].as_py(), table.column("block").to_pylist()
        out = reply(p, arrays)
        numbers += [SUMMARY] * (len(out) - len(numbers))
        return pa.table({"block": pa.array(numbers, pa.int64()), "p": pa.array([p] * len(out), pa.int32()), "data": pa.array([squeeze(x) for x in out], pa.binary())})

    found = asked.groupBy("p").applyInArrow(run, ASK)
    return store(found, name, "none") if name else found


def meet(blocks: DataFrame, answers: DataFrame, n: int, then: Callable[[int, bytes, dict[int, bytes]], Iterator[pa.RecordBatch] | pa.Table], schema: str) -> DataFrame:
    """``then(block, payload, answer of each partition)`` for every block, also one without answers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right.column("p").to_pylist(), right.column("data").to_pylist(), strict=True))
        return then(left.column("block")[0].as_py(), left.column("payload")[0].as_py(), got)

    own = answers.where(F.col("block") != SUMMARY)
    return blocks.select("block", "payload").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, schema)


def replies(got: dict[int, bytes], found: np.ndarray, n: int, dtype) -> np.ndarray:
    """A block's answers in the order of the keys it asked for."""
    return gather([expand(got[p], dtype) if p in got else np.zeros(0, dtype) for p in range(n)], found, 1, n)
