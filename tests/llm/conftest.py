import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, leaf long, _row int, v string, block int, `a.b` int"


def prose(rnd, n):
    return " ".join(rnd.choice(["the", "of", "and", "to", "in", "a", "that", "for"]) if rnd.random() < 0.35 else "w" + rnd.choice("abcdefgh") + rnd.choice("ijklmnop") + rnd.choice("qrstuvwx") for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies, shared passages and lines."""
    rnd = random.Random(11)
    passage, line = prose(rnd, 60), "Served by node 17 at 10:33 for user 42"
    base = [prose(rnd, 120) for _ in range(8)]
    texts = [*base, base[0], base[0].replace(" ", "\t\n "), base[1] + " tail", " ".join(base[2].split()[:110] + ["x"] * 3), f"{base[3]}\n{passage}", f"{passage} {base[4]}", None, "", "  \n\t ", "one", "two words", "a a a a " * 40, "é ü 日本 🎉 ▁ \x00 x", prose(rnd, 30_000)]
    texts += [f"Served by node {k} at 1{k % 10}:33 for user {k * 7}\n{prose(rnd, 70)}" for k in range(14)]
    texts += [line, f"{line}\n{line}"]
    rows = [(k, t, "en" if k % 3 else None, None if k % 7 == 0 else f"s{k % 3}", None if t is None else len(t), "clash", k, k, None, None, k) for k, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, base[5], None, None, None, None, None, None, None, None, None), (3, "same id, another text", "en", "s1", 5, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
