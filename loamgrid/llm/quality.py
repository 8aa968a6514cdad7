"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with the
references of its language (``lang``; null is a language of its own) by Jensen-Shannon distance (base 2,
so from 0 to 1). A document is rejected if it fails the base rules, or if either distance is above the
limit for its length. The distance of a good text falls with the root of its number of words, as that of
any sample from its distribution does, so the limit is ``LIMIT + SLACK / sqrt(words)``: a short text, of
which a histogram says little, is let pass where a long one is not.

References are learned (``references``) from documents labelled good: of the ``SAMPLE`` labelled ids whose
md5 is least, the shares of the character classes and of the ``COMMON`` commonest words of each language.
A language with fewer than ``MIN_REFERENCE_WORDS`` words in that sample has no reference, and its
documents are judged by the base rules alone. The table of references has at most ``SAMPLE`` rows of some
hundred bytes, which bounds what is broadcast and what the driver sees.

The base rules: fewer than 50 words, or over half of the words inside a 3-word window that occurs
twice or more in the text. All counts are over the whole text.

Arrays of a document are bound once by ``let``; a plain column would be put into the lambdas by the
optimiser and evaluated again for every element.

Defined cases: a null or empty text has no words, all counts are 0 and it fails the base rules; without
labels there are no references; labels of unknown ids, repeated labels and null ids are of no account;
rows that repeat an id are judged each; other columns pass through or are ignored, whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.shared import WORD, let, store

SPACES = r"[\x20\x09-\x0D]+"
PLAIN = r"[a-z\x20\x09-\x0D]+"  #: the commonest class, and what is no part of a word
#: Characters by class: lower-case a-z (what the first pattern leaves out), upper-case A-Z, other letters, digits,
#: full stops and commas, other ASCII punctuation and symbols, anything else (what the last one leaves).
CLASSES = ("[A-Z]+", r"\p{L}+", "[0-9]+", "[.,]+", r"[!-/:-@\[-`{-~]+")
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
POSITION_BITS = 31
LIMIT, SLACK = 0.08, 1.8
COMMON, SAMPLE, MIN_REFERENCE_WORDS = 12, 20_000, 2000


def words(text: Column) -> Column:
    """The words of a text, in order; none of a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def repeated_words(found: Column) -> Column:
    """Number of words inside a 3-word window that occurs twice or more.

    Each window becomes one long, the low bits of its hash above its position, and the longs are sorted:
    a window whose hash bits stand alone is not repeated. The others are sorted by their very words, where
    equal windows are neighbours whatever their hashes have in common. An array has fewer than 2**31
    elements, so that every position fits.
    """
    low = (1 << POSITION_BITS) - 1

    def of(ws: Column) -> Column:
        return let(candidates(ws), lambda at: F.when(F.size(at) > 1, covered(ws, at)).otherwise(F.lit(0).cast("long")))

    def candidates(ws: Column) -> Column:
        """Positions, from 0, of the windows whose hash bits occur twice or more."""
        keys = F.transform(F.slice(ws, F.lit(1), F.size(ws) - 2), lambda w, i: F.shiftleft(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)), POSITION_BITS).bitwiseOR(i.cast("long")))
        pair = lambda s: lambda x, k: F.when(F.shiftrightunsigned(x.bitwiseXOR(F.get(s, k + 1)), POSITION_BITS) == 0, F.array(x, F.get(s, k + 1)))
        pairs = let(F.sort_array(keys), lambda s: F.filter(F.transform(s, pair(s)), lambda x: x.isNotNull()))
        return F.transform(F.array_distinct(F.flatten(pairs)), lambda x: x.bitwiseAND(low).cast("int"))

    def covered(ws: Column, at: Column) -> Column:
        windows = F.transform(at, lambda i: F.struct(F.get(ws, i).alias("a"), F.get(ws, i + 1).alias("b"), F.get(ws, i + 2).alias("c"), i.alias("i")))

        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

        repeated = let(F.sort_array(windows), lambda s: F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"]))
        # a window adds what the next one does not cover
        return let(F.sort_array(repeated), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda t, x: t + x))

    return let(found, lambda ws: F.when(F.size(ws) >= 4, of(ws)).otherwise(F.lit(0).cast("long")))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def class_counts(word_chars: Column, rest: Column) -> Column:
    """Number of characters of each class, as doubles. rest: the text without ``PLAIN``."""

    def after(left: Column, k: int) -> Column:
        """Lengths of what is left after each further class has been taken out."""
        own = F.array(F.length(left).cast("double"))
        return let(F.regexp_replace(left, CLASSES[k], ""), lambda x: F.concat(own, after(x, k + 1))) if k < len(CLASSES) else own

    lengths = F.concat(F.array(word_chars.cast("double")), after(rest, 0), F.array(F.lit(0.0)))
    return let(lengths, lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda n, i: n - F.get(x, i + 1)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2."""

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / F.lit(2.0)
        own = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return own(a) + own(b)

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda t, x: t + x)
    return F.sqrt(F.greatest(total / F.lit(2.0), F.lit(0.0)))


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)).cast("double"))


def with_rest(p: Column) -> Column:
    """An array of shares, and what they leave of 1."""
    return let(p, lambda x: F.concat(x, F.array(F.aggregate(x, F.lit(1.0), lambda t, y: t - y))))


def references(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, common: int = COMMON, least: int = MIN_REFERENCE_WORDS) -> DataFrame:
    """(_lang, voc, word_shares, class_shares) of each language, from the good documents of the sample."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(sample)
    rows = docs.select("doc_id", F.col("lang").alias("_lang"), "text").join(F.broadcast(good), F.col("doc_id") == F.col("_id"), "left_semi")
    each = rows.select("_lang", F.explode(words(F.lower("text"))).alias("w")).groupBy("_lang", "w").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("_lang").orderBy(F.col("n").desc(), "w")
    top = each.withColumn("r", F.row_number().over(order)).where(f"r <= {common}").groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("r", "w", "n"))).alias("top"))
    total = each.groupBy(F.col("_lang").alias("_l")).agg(F.sum("n").alias("total")).where(f"total >= {least}")
    parts = rows.select("_lang", F.length(F.array_join(words(F.col("text")), "")).alias("k"), F.regexp_replace("text", PLAIN, "").alias("rest"))
    classes = parts.select("_lang", class_counts(F.col("k"), F.col("rest")).alias("c")).groupBy(F.col("_lang").alias("_m")).agg(F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(len(CLASSES) + 2)]).alias("c"))
    found = top.join(total, F.col("_lang").eqNullSafe(F.col("_l"))).join(classes, F.col("_lang").eqNullSafe(F.col("_m")))
    in_all = F.aggregate("c", F.lit(0.0), lambda t, x: t + x)
    return found.select("_lang", F.col("top.w").alias("voc"), with_rest(shares(F.col("top.n"), F.col("total"))).alias("word_shares"), shares(F.col("c"), in_all).alias("class_shares"))


def measures(text: Column, known: list[str], voc: Column, word_shares: Column, class_shares: Column) -> Column:
    """Counts, distances and verdicts of a text, as one struct. known: the common words of all languages.

    It is one expression in which every step is bound: no rule of the optimiser can write a step out
    twice, also where a filter on a verdict is pushed below the projection.
    """

    def raw(t: Column) -> Column:
        return F.struct(words(t).alias("words"), F.regexp_replace(t, PLAIN, "").alias("rest"), duplicate_lines(t).alias("lines"))

    def counted(s: Column) -> Column:
        hits = F.transform(F.filter(s["words"], lambda w: F.lower(w).isin(known)), F.lower)
        n_words, word_chars = F.size(s["words"]).cast("long"), F.length(F.array_join(s["words"], "")).cast("long")
        symbols = F.regexp_count(s["rest"], F.lit(SYMBOLS)).cast("long")
        common = let(hits, lambda h: F.transform(voc, lambda v: (F.size(h) - F.size(F.array_remove(h, v))).cast("double")))
        return F.struct(n_words.alias("n_words"), word_chars.alias("word_chars"), symbols.alias("n_symbols"), s["lines"].alias("n_dup_lines"), repeated_words(s["words"]).alias("n_repeat_words"), common.alias("common"), s["rest"].alias("rest"))

    def compared(m: Column) -> Column:
        by_class = let(shares(class_counts(m["word_chars"], m["rest"]), m["word_chars"]), lambda p: js_distance(p, class_shares))
        by_word = let(with_rest(shares(m["common"], m["n_words"])), lambda p: js_distance(p, word_shares))
        return let(F.struct(by_class.alias("c"), by_word.alias("w")), lambda d: verdicts(m, d))

    return let(F.coalesce(text, F.lit("")), lambda t: let(let(raw(t), counted), compared))


def verdicts(m: Column, d: Column) -> Column:
    n, r = m["n_words"], m["n_repeat_words"]
    failed = (n < MIN_WORDS) | (100 * r > MAX_REPEATED_PERCENT * n)
    limit = F.lit(LIMIT) + F.lit(SLACK) / F.sqrt(F.greatest(n, F.lit(1)).cast("double"))
    odd = F.coalesce(F.greatest(d["c"], d["w"]) > limit, F.lit(False))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return F.struct(*[m[k].alias(k) for k in names], failed.alias("base_failed"), (~failed & ~odd).alias("kept"), d["c"].alias("class_distance"), d["w"].alias("word_distance"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` as _row (all its columns), with the measures as _m."""
    refs = store(references(docs, labels), "references")
    known = sorted({w for r in refs.select("voc").collect() for w in r["voc"]})
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"), F.col("lang").alias("_l"))
    both = own.join(F.broadcast(refs), F.col("_l").eqNullSafe(F.col("_lang")), "left")
    return both.select("_row", measures(F.col("_text"), known, *[F.col(c) for c in ("voc", "word_shares", "class_shares")]).alias("_m"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, the verdicts and the distances of every row of ``docs`` (doc_id, text, lang)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(docs.select("doc_id", "text", "lang"), labels).select("_row.doc_id", *[F.col(f"_m.{k}").alias(k) for k in names])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they came with."""
    return judged(docs, labels).where("_m.kept").select("_row.*")


def oracle() -> str:
    """DuckDB SQL for ``judge`` over ``documents`` and ``labels``."""
    spaces = r"[\x20\x09-\x0D]"
    classes, rest = [], f"regexp_replace(text, '{PLAIN}', '', 'g')"
    for i, c in enumerate(CLASSES):
        classes.append(f"length({rest})::DOUBLE AS k{i + 1}")
        rest = f"regexp_replace({rest}, '{c}', '', 'g')"
    last = len(CLASSES) + 1
    classes = ", ".join([*classes, f"length({rest})::DOUBLE AS k{last}"])
    counts = "[" + ", ".join([*(f"k{i} - k{i + 1}" for i in range(last)), f"k{last}"]) + "]"
    js = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda x: (CASE WHEN x[1] > 0 THEN x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) ELSE 0::DOUBLE END) + (CASE WHEN x[2] > 0 THEN x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) ELSE 0::DOUBLE END))) / 2, 0))"
    part = lambda n, of: f"list_transform({n}, lambda x: x / greatest({of}, 1)::DOUBLE)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{spaces}+'), lambda x: x <> '') AS ws, length(regexp_replace(text, '{spaces}+', '', 'g'))::DOUBLE AS k0, {classes} FROM d),
g AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {SAMPLE}),
e AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(list_filter(regexp_split_to_array(lower(text), '{spaces}+'), lambda x: x <> '')) AS w FROM w SEMI JOIN g USING (doc_id)) GROUP BY lang, w),
rt AS (SELECT lang AS tl, sum(n)::DOUBLE AS total FROM e GROUP BY lang HAVING sum(n) >= {MIN_REFERENCE_WORDS}),
rw AS (SELECT lang AS rl, list(w ORDER BY r) AS voc, list(n::DOUBLE ORDER BY r) AS vn FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM e) WHERE r <= {COMMON} GROUP BY lang),
rc AS (SELECT lang AS cl, [{", ".join(f"sum(c[{i + 1}])" for i in range(last + 1))}] AS cn FROM (SELECT lang, {counts} AS c FROM w SEMI JOIN g USING (doc_id)) GROUP BY lang),
ref AS (SELECT rl, voc, list_concat({part("vn", "total")}, [1 - list_sum({part("vn", "total")})]) AS wq, {part("cn", "list_sum(cn)")} AS cq FROM rw JOIN rt ON rl IS NOT DISTINCT FROM tl JOIN rc ON rl IS NOT DISTINCT FROM cl),
tri AS (SELECT rid, i, ws[i:i+2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS r FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, k0::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
 (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
 coalesce(r, 0)::BIGINT AS n_repeat_words, {counts} AS c, list_transform(voc, lambda v: len(list_filter(ws, lambda x: lower(x) = v))::DOUBLE) AS vn, wq, cq FROM w LEFT JOIN cov USING (rid) LEFT JOIN ref ON lang IS NOT DISTINCT FROM rl),
p AS (SELECT *, {part("c", "word_chars")} AS cp, list_concat({part("vn", "n_words")}, [1 - list_sum({part("vn", "n_words")})]) AS wp FROM m),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed, greatest({js("cp", "cq")}, {js("wp", "wq")}) AS far FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT coalesce(wq IS NOT NULL AND far > {LIMIT} + {SLACK} / sqrt(greatest(n_words, 1)::DOUBLE), false) AS kept FROM j"""
