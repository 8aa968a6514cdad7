"""Exact substring deduplication over a log-structured fingerprint index.

A *window* is ``SPAN`` consecutive words of one document. Each window has an anchor: the least hash of
the ``GRAM``-word sequences inside it, the leftmost on ties. Equal windows have equal anchors at equal
places, and neighbouring windows mostly share one, so that the index holds one entry for each run of
windows with one anchor: (anchor, digest of all the words that the run covers, count).

*Log structure.* Each block of documents flushes its entries as sorted arrays (level 0, one for each hash
partition of the anchors). Runs are immutable; when there are more than ``FAN_IN``, ``compact`` merges them
into one sorted run for each partition. ``probe`` merge-joins the arrays of a batch with the runs: those of
the batches before (a new batch against history), or, once the batch itself has been appended, with all. The
query takes its documents in ``BATCHES`` batches, appends one after the other, compacting on the way, and
then probes them against the whole index, since the first of two equal windows is to go, too.

*Verification.* An entry whose anchor occurs nowhere else holds no repeated window. An entry whose
anchor and digest both recur is repeated from end to end: the two are 64 bits of different hashes, one of
the anchor's words and one of all bytes of the run, so that a wrong match among n entries is about as
likely as n**2 / 2**129. What is left are anchors that recur in different surroundings: for these entries
alone the digests of the single windows, 128 bits of their very bytes, are compared in a second exchange
of the same form.

Each word covered by a repeated window goes, the first occurrence included; windows are judged on the
input, so that no decision depends on another.

Defined cases: null and empty texts have no words and lose none, their digest is that of the empty
string; texts of fewer than ``SPAN`` words lose none; rows with the same doc_id, or none, are documents
of their own; an empty table gives an empty result.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm import blocks as B
from loamgrid.llm.shared import store
from loamgrid.llm.wordhash import bounds, gram_hashes, normalise, word_hashes

SPAN, GRAM = 35, 8
FAN_IN, BATCHES = 4, 7  #: runs that a probe sees at most; batches of the query
ENTRY = np.dtype([("v", "<u8"), ("s", "<u8"), ("n", "u1")])
WINDOW = np.dtype([("v", "<u8"), ("s", "<u8"), ("n", "u1")])
ALONE, WHOLE, PARTLY, PUBLISH = 0, 1, 2, 4
HISTORY = -1  #: the number of arrays that stand for a compacted run


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbouring values the place of the least, the leftmost on ties."""
    at, have = np.arange(len(grams)), 1
    while have * 2 <= width:
        a, b = at[:-have], at[have:]
        at, have = np.where(grams[b] < grams[a], b, a), have * 2
    if have < width:
        gap = width - have
        a, b = at[:-gap], at[gap:]
        at = np.where(grams[b] < grams[a], b, a)
    return at


def entries(norm: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, digest, first window, last window) of each entry, and the words' starts and ends."""
    starts, ends = bounds(norm)
    if len(starts) < SPAN:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64), starts, ends
    grams = gram_hashes(word_hashes(norm, starts, ends), GRAM)
    at = anchors(grams, SPAN - GRAM + 1)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    view, digest = memoryview(norm), xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(view[a:b]) for a, b in zip(starts[first].tolist(), ends[last + SPAN - 1].tolist(), strict=True)), np.uint64, len(first))
    return grams[at[first]], digests, first, last, starts, ends


def distinct(v: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted, with their counts (255 at most: only whether it is above 1 matters), and each input's place."""
    order = np.lexsort((s, v))
    v, s, n = v[order], s[order], n[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    out = np.empty(len(at), ENTRY)
    out["v"], out["s"] = v[at], s[at]
    out["n"] = np.minimum(np.add.reduceat(n.astype(np.int64), at), 255) if len(at) else 0
    place = np.empty(len(v), np.int64)
    place[order] = np.cumsum(new) - 1
    return out, place


def merge(arrays: list[np.ndarray]) -> np.ndarray:
    """One sorted run from many."""
    if not arrays:
        return np.zeros(0, ENTRY)
    x = np.concatenate(arrays)
    return distinct(x["v"], x["s"], x["n"])[0]


class Block:
    """The entries of a block's documents."""

    def __init__(self, payload: bytes):
        self.ids, self.texts = B.documents(payload)
        found = [entries(t) for t in self.texts]
        self.words = [(f[4], f[5]) for f in found]
        self.doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        v, s, self.first, self.last = (np.concatenate([f[k] for f in found]) for k in range(4))
        self.entries, self.place = distinct(v, s, np.ones(len(v), np.uint8))

    def windows(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows to compare one by one: (entry's number, window's start, digests and counts of all)."""
        own = flags[self.place]
        shown = np.zeros(len(self.entries), bool)
        pick = []
        for k in np.flatnonzero((own & PARTLY > 0) | (own & PUBLISH > 0)):
            e = self.place[k]
            if own[k] & PARTLY or not shown[e]:
                shown[e] = True
                pick.append(k)
        pick = np.array(pick, np.int64)
        count = self.last[pick] - self.first[pick] + 1
        entry = np.repeat(pick, count)
        start = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count) + self.first[entry]
        raw = bytearray()
        digest, views = xxhash.xxh3_128_digest, [memoryview(t) for t in self.texts]
        owner = self.doc[entry]
        for d in np.unique(owner):
            mine = start[np.searchsorted(owner, d) : np.searchsorted(owner, d, "right")]
            starts, ends = self.words[d]
            for a, b in zip(starts[mine].tolist(), ends[mine + SPAN - 1].tolist(), strict=True):
                raw += digest(views[d][a:b])
        pair = np.frombuffer(bytes(raw), np.dtype([("v", "<u8"), ("s", "<u8")]))
        weight = np.where(own[entry] & PARTLY, 1, 2).astype(np.uint8)
        return entry, start, np.rec.fromarrays([pair["v"], pair["s"], weight], dtype=WINDOW)


def entries_of(payload: bytes) -> np.ndarray:
    return Block(payload).entries


def joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The merged run of all arrays, and the places of each array's pairs in it: one sort for all."""
    x = np.concatenate(arrays)
    total, place = distinct(x["v"], x["s"], x["n"])
    return total, np.split(place, np.cumsum([len(a) for a in arrays])[:-1])


def judge(total: np.ndarray) -> np.ndarray:
    """Flags of the entries of a merged run of everything; PUBLISH for all classes whose windows one block must show."""
    new = np.ones(len(total), bool)
    new[1:] = total["v"][1:] != total["v"][:-1]
    group = np.cumsum(new) - 1
    several = np.bincount(group, minlength=1)[group] > 1
    whole = total["n"] > 1
    return np.where(whole, np.where(several, WHOLE | PUBLISH, WHOLE), np.where(several, PARTLY, ALONE)).astype(np.uint8)


def published_once(flags: np.ndarray, places: list[np.ndarray]) -> list[np.ndarray]:
    """Each asker's flags; PUBLISH goes to the first that has an entry."""
    left, out = flags.copy(), []
    for at in places:
        out.append(left[at])
        left[at] &= ~np.uint8(PUBLISH)
    return out


class FingerprintIndex:
    """Sorted immutable runs of past batches: rows (block or run, p, data)."""

    def __init__(self, spark):
        self.spark = spark
        self.runs: list[DataFrame | tuple[DataFrame, int]] = []

    def append(self, flushed: DataFrame, batch: int | None = None) -> None:
        """Adds a batch's arrays as a run: the table, or its rows of one ``grp``; too many runs are compacted."""
        self.runs.append(flushed if batch is None else (flushed, batch))
        if len(self.runs) > FAN_IN:
            self.compact()

    def history(self) -> DataFrame:
        """The rows of all runs. Runs of one table are read from it in one pass: no run needs files of its own."""
        tables = [r for r in self.runs if isinstance(r, DataFrame)]
        shared = [r for r in self.runs if not isinstance(r, DataFrame)]
        for table in {id(t): t for t, _ in shared}.values():
            tables.append(table.where(F.col("grp").isin([g for t, g in shared if t is table])).drop("grp"))
        if not tables:
            return self.spark.createDataFrame([], B.ASK)
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def compact(self) -> None:
        """All runs become one sorted array for each partition."""

        def run(table: pa.Table) -> pa.Table:
            data = B.squeeze(merge([B.expand(x.as_py(), ENTRY, True) for x in table.column("data")]), True)
            return pa.table({"block": pa.array([HISTORY], pa.int64()), "p": table.column("p").slice(0, 1), "data": pa.array([data], pa.binary())})

        self.runs = [store(self.history().groupBy("p").applyInArrow(run, B.ASK), "run", "none")]

    def probe(self, batch: DataFrame, appended: bool = False) -> DataFrame:
        """Merge-join of a batch's arrays with all runs, and with each other unless the batch is part of the runs: (block, p, flags of the entries).

        The windows of a class are published by the first block that has it; if the batch is new, by the history.
        """

        def run(new: pa.Table, old: pa.Table) -> pa.Table:
            order = np.argsort(new.column("block").to_numpy(), kind="stable")
            new = new.take(pa.array(order))
            arrays = [B.expand(x.as_py(), ENTRY, True) for x in new.column("data")]
            runs = [B.expand(x.as_py(), ENTRY, True) for x in old.column("data")]
            if appended:  # counted there
                for x in arrays:
                    x["n"] = 0
            total, places = joined([*arrays, *runs])
            flags = judge(total)
            for at in [] if appended else places[len(arrays) :]:
                flags[at] &= ~np.uint8(PUBLISH)
            out = [B.squeeze(x) for x in published_once(flags, places[: len(arrays)])]
            return pa.table({"block": new.column("block"), "p": new.column("p"), "data": pa.array(out, pa.binary())})

        return batch.groupBy("p").cogroup(self.history().groupBy("p")).applyInArrow(run, B.ASK)


def count_windows(p: int, arrays: list[np.ndarray]) -> list[np.ndarray]:
    """For each block's windows whether they occur twice or more."""
    total, places = joined(arrays)
    twice = (total["n"] > 1).astype(np.uint8)
    return [twice[at] for at in places]


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def dedup(docs: DataFrame, batches: int = BATCHES, texts: bool = False) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): counts and the digest of the kept words; with ``texts`` the kept text, too.

    The documents come in so many batches (by a hash of their id), as they would over time.
    """
    spark = docs.sparkSession
    blocks = B.in_blocks(docs, normalise, "blocks", lambda doc: zlib.crc32(str(doc).encode()) % batches)
    ladder = B.Ladder(blocks)
    n, one = ladder.first, len(ladder.parts) == 1
    levels = ladder.up(B.ask(blocks.select("block", "payload", "grp"), entries_of, n, "flushed", ["grp"]), joined, ENTRY, by="grp")
    index = FingerprintIndex(spark)
    for g in range(batches):
        index.append(levels[-1], g)
    flags = store(index.probe(levels[-1].drop("grp"), appended=True), "flags", "none")
    flags = ladder.down(flags, levels, joined, np.dtype(np.uint8), ENTRY, by="grp", share=published_once)

    def windows(block: int, payload: bytes, got: dict[int, bytes]) -> pa.Table:
        own = Block(payload)
        _, _, asked = own.windows(B.replies(got, own.entries, n, np.uint8))
        asked = distinct(asked["v"], asked["s"], asked["n"])[0]
        return pa.Table.from_batches([B.rows_of(block, B.deal(asked, 1, n))])

    asked = B.meet(blocks, flags, n, windows, B.ASK)
    levels = ladder.up(asked if one else store(asked, "windows", "none"), joined, WINDOW)
    verdicts = ladder.down(B.answer(levels[-1], count_windows, WINDOW, None if one else "verdicts"), levels, joined, np.dtype(np.uint8), WINDOW)
    both = flags.unionByName(verdicts.withColumn("p", F.col("p") + n))

    def cut(block: int, payload: bytes, got: dict[int, bytes]) -> pa.Table:
        own = Block(payload)
        flags = B.replies(got, own.entries, n, np.uint8)
        entry, start, asked = own.windows(flags)
        keys, place = distinct(asked["v"], asked["s"], asked["n"])
        twice = B.replies({p - n: d for p, d in got.items() if p >= n}, keys, n, np.uint8)[place] > 0
        mine = flags[own.place]
        whole = np.flatnonzero(mine & WHOLE)
        doc = np.concatenate([own.doc[whole], own.doc[entry[twice]]])
        low = np.concatenate([own.first[whole], start[twice]])
        high = np.concatenate([own.last[whole], start[twice]]) + SPAN
        order = np.argsort(doc, kind="stable")
        doc, low, high = doc[order], low[order], high[order]
        rows = []
        for d, (norm, (starts, _)) in enumerate(zip(own.texts, own.words, strict=True)):
            i, j = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
            kept, removed = norm, 0
            if j > i:
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, low[i:j], 1)
                np.add.at(edge, high[i:j], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = int(gone.sum())
                kept = b" ".join(w for w, g in zip(norm.split(b" "), gone.tolist(), strict=True) if not g)
            rows.append((own.ids[d], len(starts), removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if texts else None))
        ids, words, removed, digest, text = zip(*rows, strict=True)
        out = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"text": pa.array(text, pa.string())} if texts else {}))

    return B.meet(blocks, both, n, cut, RESULT + (", text string" if texts else ""))
