import math
import re
import zlib
from collections import Counter

import numpy as np

from loamgrid.llm import blocks as B
from loamgrid.llm import language_model as L


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["\0end"]


def held(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 10 == 0


def test_counts_and_base_score_match_brute_force(awkward, monkeypatch):
    scores = []
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    c = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = sorted(((d, held(d), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x)), 6)) for d, x in rows), key=repr)
    for small in (False, True):
        if small:  # several levels between blocks and partitions
            monkeypatch.setattr(B, "PARTITION_BYTES", 15_000)
            monkeypatch.setattr(B, "FAN", 3)
        found = L.scores(awkward.repartition(8) if small else awkward).collect()
        got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found), key=repr)
        assert got == want
        scores.append(sorted((repr(r["doc_id"]), round(r["score"], 6)) for r in found))
    assert scores[0] == scores[1]


def test_held_out_text_scores_better_than_the_base(spark):
    rnd = np.random.default_rng(1)
    follow = {i: rnd.integers(0, 40, 3) for i in range(40)}
    docs = []
    for d in range(120):
        w = [int(rnd.integers(0, 40))]
        for _ in range(80):
            w.append(int(follow[w[-1]][rnd.integers(0, 3)]))
        docs.append((d, " ".join(f"w{k}" for k in w)))
    rows = L.scores(spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").collect()
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) * 0.7


def model(rows):
    """Interpolated bigrams from the documents' own definition: dictionaries, and weights by a search over a grid."""
    part = lambda d: -1 if held(d) else zlib.crc32(str(d).encode()) % 10

    def counts(keep):
        uni, ctx, big = Counter(), Counter(), Counter()
        for d, x in rows:
            if keep(part(d)):
                t = tokens(x)
                uni.update(t)
                ctx.update(["\0begin", *t[:-1]])
                big.update(zip(["\0begin", *t], t, strict=False))
        return uni, ctx, big, sum(uni.values()), len(uni)

    def ctx_count(uni, ctx, u):
        return ctx[u] if u == "\0begin" else uni[u]

    def base(c, w):
        return (c[0][w] + 0.1) / (c[3] + 0.1 * (c[4] + 1))

    kept = counts(lambda p: p > 1)
    cells = {}
    for d, x in rows:
        if part(d) == 1:
            t = tokens(x)
            for u, w in zip(["\0begin", *t], t, strict=False):
                n = ctx_count(kept[0], kept[1], u)
                if n:
                    cells.setdefault(n.bit_length(), []).append((kept[2][u, w] / n, base(kept, w)))
    grid = np.linspace(0.0005, 0.9995, 2000)
    best = lambda found: grid[int(np.argmax(sum(np.log(grid * p + (1 - grid) * q) for p, q in found)))]
    pooled = best([x for v in cells.values() for x in v])
    weights = {b: best(v) for b, v in cells.items()}
    full = counts(lambda p: p > 0)

    def p(u, w):
        n = ctx_count(full[0], full[1], u)
        a = weights.get(n.bit_length(), pooled) if n else 0
        return (a * full[2][u, w] / n if n else 0) + (1 - a) * base(full, w)

    return p, full


def chained(n_docs, words=30):
    rnd = np.random.default_rng(1)
    follow = {i: rnd.integers(0, words, 3) for i in range(words)}
    docs = []
    for d in range(n_docs):
        w = [int(rnd.integers(0, words))]
        for _ in range(int(rnd.integers(1, 90))):
            w.append(int(follow[w[-1] % words][rnd.integers(0, 3)]) if rnd.random() < 0.9 else int(rnd.integers(0, 3 * words)))
        docs.append((d, " ".join(f"w{k}" for k in w)))
    return docs


def test_scores_match_a_plain_model_that_sums_to_one(spark):
    rows = chained(300)
    p, full = model(rows)
    for u in ["\0begin", "w1", "w2", "w70", "never seen"]:
        assert abs(sum(p(u, w) for w in [*full[0], "never seen either"]) - 1) < 1e-9
    for r in L.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t = tokens(dict(rows)[r["doc_id"]])
        want = sum(math.log10(p(u, w)) for u, w in zip(["\0begin", *t], t, strict=False))
        assert abs(r["score"] - want) < 0.004 * len(t), (r["doc_id"], r["score"], want)


def test_expectation_maximisation_finds_the_mixture():
    rnd = np.random.default_rng(2)
    p, q, a = np.array([0.7, 0.2, 0.1]), np.array([0.1, 0.3, 0.6]), 0.8
    seen = rnd.choice(3, 200_000, p=a * p + (1 - a) * q)
    cells = [(3, round(math.log2(p[k] / q[k]) * L.RATIO_STEPS), int((seen == k).sum())) for k in range(3)]
    assert abs(L.learn(cells)[3] - a) < 0.03


def test_empty_table(nothing):
    assert L.scores(nothing).count() == 0
