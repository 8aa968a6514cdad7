"""A bigram language model by deleted interpolation, and the scores of all documents under it.

The probability of a token w after u is

    a(b) * c(u, w) / c(u)  +  (1 - a(b)) * (c(w) + 0.1) / (N + 0.1 * (V + 1))

where b is the bucket of c(u), how often the context was seen (powers of two). Contexts that training
never saw have only the second term. The weights a(b) are learned by expectation-maximisation on counts
that were held out: one training document in nine is *deleted* from the counts, and its tokens are
explained by what is left; the final counts are of all training documents.

What expectation-maximisation needs of a token is its bucket and the ratio of the two terms; tokens are
gathered in a histogram over bucket and ratio (sixteenths of a power of two), whose size does not depend
on the corpus, and the iterations run on that.

Counts are exact and grow with the corpus. Blocks of documents ask hash partitions for the counts of
their distinct tokens and bigrams (``blocks``), so that no row is made for a single token.

Tokens: words in lower case (A-Z only), then an end for each document. A document begins in a context
of its own. Defined cases: null and empty texts are one end token; rows that share a doc_id are all
scored, and all learned from if the id is in training; a null id is held out; a corpus without training documents
gives the smoothed term alone.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm import blocks as B
from loamgrid.llm.wordhash import bounds, mix, normalise, word_hashes

HELD_OUT, DELETED, TRAINED = 0, 1, 2
FOLDS, SMOOTH = 10, 0.1
BUCKETS = 40  #: powers of two of a context's count
RATIO_STEPS, RATIO_RANGE = 16, 64  #: of a power of two, and powers of two to either side
ITERATIONS = 60
TOKEN = np.uint64(1 << 63)  #: the top bit of a token's key is set, that of a bigram's is not
END, BEGIN = np.uint64(0xEA09E667F3BCC909), np.uint64(0x3B67AE8584CAA73B)
PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
ASKED = np.dtype([("v", "<u8"), ("n", "<u4"), ("m", "<u4")])  #: key, training count, count in deleted documents
WIDE = np.dtype([("v", "<u8"), ("n", "<u8"), ("m", "<u8")])  #: the same of many blocks
TOTAL = np.dtype([("n", "<u8"), ("m", "<u8")])


def part_of(doc_id: int | None) -> int:
    """By crc32 of the id as text: one in ten held out, one in ten deleted while weights are learned."""
    if doc_id is None:
        return HELD_OUT
    r = zlib.crc32(str(doc_id).encode()) % FOLDS
    return HELD_OUT if r == 0 else DELETED if r == 1 else TRAINED


def lowered(text: str | None) -> bytes:
    return normalise(text).lower()


class Tokens:
    """A block's tokens and bigrams, each as a place in the block's distinct keys."""

    def __init__(self, payload: bytes):
        self.ids, texts = B.documents(payload)
        each, lengths = [], []
        for t in texts:
            each.append(word_hashes(t, *bounds(t)))
            lengths.append(len(each[-1]) + 1)
        self.lengths = np.array(lengths, np.int64)
        ends = np.cumsum(self.lengths) - 1
        w = np.empty(int(self.lengths.sum()), np.uint64)
        body = np.ones(len(w), bool)
        body[ends] = False
        w[body] = np.concatenate(each) | TOKEN if each else []
        w[ends] = END
        u = np.empty_like(w)
        u[1:] = w[:-1]
        u[ends - self.lengths + 1] = BEGIN
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        part = np.array([part_of(i) for i in self.ids], np.int64)
        self.part = part[self.doc]
        pair = mix(u * PAIR + w) & ~TOKEN
        #: a begin is asked for as a context that is no token
        starts = np.full(len(texts), BEGIN)
        keys = np.concatenate([w, pair, starts])
        self.keys, place = np.unique(keys, return_inverse=True)
        self.w, self.pair = place[: len(w)], place[len(w) : 2 * len(w)]
        begin = place[2 * len(w) :]
        self.u = np.empty_like(self.w)
        self.u[1:] = self.w[:-1]
        self.u[ends - self.lengths + 1] = begin
        self.counted = np.concatenate([self.part, self.part, part])
        self.place = place

    def asked(self) -> np.ndarray:
        """Keys with the block's counts."""
        out = np.zeros(len(self.keys), ASKED)
        out["v"] = self.keys
        out["n"] = np.bincount(self.place[self.counted != HELD_OUT], minlength=len(out))
        out["m"] = np.bincount(self.place[self.counted == DELETED], minlength=len(out))
        return out


def asked_of(payload: bytes) -> np.ndarray:
    return Tokens(payload).asked()


def summed(arrays: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys with the sums of their counts, and each array's places among them."""
    keys, place = np.unique(np.concatenate([a["v"] for a in arrays]), return_inverse=True)
    total = np.zeros(len(keys), WIDE)
    total["v"] = keys
    for f in ("n", "m"):
        np.add.at(total[f], place, np.concatenate([a[f] for a in arrays]).astype(np.uint64))
    return total, np.split(place, np.cumsum([len(a) for a in arrays])[:-1])


def add_up(p: int, arrays: list[np.ndarray]) -> list[np.ndarray]:
    """For each block the corpus counts of its keys; last, the sums of the partition's tokens (see ``Vocabulary``)."""
    total, places = summed(arrays)
    token = total["v"] >= TOKEN
    kept = total["n"][token] - total["m"][token]
    sums = np.array([total["n"][token].sum(), (total["n"][token] > 0).sum(), kept.sum(), (kept > 0).sum()], np.int64)
    counts = np.empty(len(total), TOTAL)
    counts["n"], counts["m"] = total["n"], total["m"]
    return [*(counts[x] for x in places), sums]


class Vocabulary:
    """Number of tokens and of distinct tokens in training, with and without the deleted documents."""

    def __init__(self, n: int, v: int, kept_n: int, kept_v: int):
        self.n, self.v, self.kept_n, self.kept_v = n, v, kept_n, kept_v


def vocabulary(answers: DataFrame) -> Vocabulary:
    """From the partitions' own sums, which stand beside their answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([B.expand(d.as_py(), np.int64) for d in batch.column(0)]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(4)], list("abcd"))

    sums = answers.where(F.col("block") == B.SUMMARY).select("data").mapInArrow(run, "a long, b long, c long, d long")
    return Vocabulary(*(x or 0 for x in sums.agg(*[F.sum(c) for c in "abcd"]).first()))


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def learn(cells: list[tuple[int, int, int]], iterations: int = ITERATIONS) -> np.ndarray:
    """The weight of the bigram term for each bucket, by expectation-maximisation over (bucket, ratio, tokens).

    ratio: log2 of bigram term over smoothed term, in steps; None where the bigram term is zero.
    """
    weights = np.full(BUCKETS, 0.5)
    by: dict[int, list[tuple[float, int]]] = {}
    for b, r, c in cells:
        by.setdefault(b, []).append((0.0 if r is None else 2.0 ** (r / RATIO_STEPS), c))
    pooled = [x for v in by.values() for x in v]
    for b in [-1, *sorted(by)]:
        ratio, count = (np.array(x, float) for x in zip(*(pooled if b < 0 else by[b]), strict=True)) if pooled else (np.zeros(1), np.ones(1))
        a = 0.5 if b < 0 else weights[b]
        for _ in range(iterations):
            share = a * ratio / (a * ratio + 1 - a)
            a = min(max(float((share * count).sum() / count.sum()), 1e-6), 1 - 1e-6)
        if b < 0:
            weights[:] = a  # what a bucket without held-out tokens gets
        else:
            weights[b] = a
    weights[0] = 0.0
    return weights


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame) -> DataFrame:
    """The scores of every document of ``docs`` (doc_id, text)."""
    blocks = B.in_blocks(docs, lowered, "blocks", part_of)
    ladder = B.Ladder(blocks)
    n, one = ladder.first, len(ladder.parts) == 1
    levels = ladder.up(B.ask(blocks, asked_of, n, None if one else "asked"), summed, ASKED, WIDE)
    answers = B.answer(levels[-1], add_up, ASKED if one else WIDE, "counts")
    size = vocabulary(answers)
    answers = ladder.down(answers, levels, summed, TOTAL, ASKED, WIDE)

    def histogram(block: int, payload: bytes, got: dict[int, bytes]) -> pa.Table:
        t = Tokens(payload)
        c = B.replies(got, t.asked(), n, TOTAL)
        kept = c["n"].astype(np.int64) - c["m"]
        u, w, uw = kept[t.u], kept[t.w], kept[t.pair]
        seen = u > 0
        b = bucket_of(u[seen])
        with np.errstate(divide="ignore"):
            r = np.log2(uw[seen] / u[seen] * (size.kept_n + SMOOTH * (size.kept_v + 1)) / (w[seen] + SMOOTH)) * RATIO_STEPS
        limit = RATIO_RANGE * RATIO_STEPS
        cell = np.where(np.isinf(r), -limit - 1, np.clip(np.where(np.isinf(r), 0, np.rint(r)), -limit, limit)).astype(np.int64)
        keys, count = np.unique(b * 1_000_000 + cell + 500_000, return_counts=True)
        return pa.table({"b": pa.array(keys // 1_000_000, pa.int32()), "r": pa.array(keys % 1_000_000 - 500_000, pa.int32()), "n": pa.array(count, pa.int64())})

    deleted = B.meet(blocks.where(F.col("grp") == DELETED), semi(answers, blocks, DELETED), n, histogram, "b int, r int, n long")
    none = -RATIO_RANGE * RATIO_STEPS - 1
    cells = [(x["b"], None if x["r"] == none else x["r"], x["n"]) for x in deleted.groupBy("b", "r").agg(F.sum("n").alias("n")).collect()]
    weights = learn(sorted(cells, key=lambda x: (x[0], x[1] is not None, x[1])))

    def score(block: int, payload: bytes, got: dict[int, bytes]) -> pa.Table:
        t = Tokens(payload)
        c = B.replies(got, t.asked(), n, TOTAL)["n"].astype(np.int64)
        u, w, uw = c[t.u], c[t.w], c[t.pair]
        base = (w + SMOOTH) / (size.n + SMOOTH * (size.v + 1))
        a = weights[bucket_of(u)]
        full = a * uw / np.maximum(u, 1) + (1 - a) * base
        add = lambda x: np.bincount(t.doc, x, len(t.ids))
        known = add(w > 0).astype(np.int64)
        return pa.table({
            "doc_id": pa.array(t.ids, pa.int64()), "held_out": pa.array([part_of(i) == HELD_OUT for i in t.ids], pa.bool_()), "n_tokens": pa.array(t.lengths, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array([size.n] * len(t.ids), pa.int64()), "base_score": pa.array(add(np.log10(base)), pa.float64()), "score": pa.array(add(np.log10(full)), pa.float64()),
        })

    return B.meet(blocks, answers, n, score, RESULT)


def semi(answers: DataFrame, blocks: DataFrame, group: int) -> DataFrame:
    return answers.join(blocks.where(F.col("grp") == group).select("block"), "block", "left_semi")
