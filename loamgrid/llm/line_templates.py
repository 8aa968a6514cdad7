"""Line deduplication by a log-template tree, in DataFrame functions only.

Lines are parsed to a fixed depth: by their number of tokens, then by their first ``LEAD`` tokens, with
tokens that hold a digit written as ``<*>``. A leaf of the tree generalises its lines further: a token that
stands at its place in fewer than ``MIN_DOCS`` documents of the leaf (a line counts once for each document)
is the value of a variable field and is written as ``<*>``, too. What comes out is the line's template; a
leaf holds as many as its lines have. A line with more variable fields than ``LIKE`` allows (at least that
share of its tokens must stand, with digits or without) is a template of its own, so that lines of prose
that merely begin alike are not taken together.

A template found in at least ``MIN_DOCS`` documents is recurring. Its lines are dropped from every
document but the first, the one of the smallest doc_id, so that no content is lost altogether.

Lines travel as hashes; text is fetched only for one example of each masked line in leaves that hold
several lines and enough documents to matter. Tokens are counted by leaf, place and token, lines are never
compared with each other, and no leaf is gathered in a task. Counts are aggregated before any shuffle by
leaf, so that a line found in a third of all documents is one row of each task. The joins that texts take
part in are merge joins at every size: what they meet grows with the documents.

Defined cases: null and empty texts have one line without tokens and keep it (a null text stays null);
blank lines are kept; a line of one or two tokens that all hold digits has nothing to go by and stands for
itself, digits and all; rows that repeat both doc_id and text are one document; a null doc_id comes last
among the firsts, and of rows of one doc_id the one whose text has the least hash comes first; an empty
table gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.shared import let, store

SPACES = r"[\x20\x09-\x0D]+"
LEAD, MIN_DOCS, LIKE = 3, 10, 0.75
FIELD = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"  #: a token with a digit
ANY = "<*>"


def masked(line: Column) -> Column:
    """Tokens joined by one space, those with digits as ``<*>``; of one or two that all hold digits, the tokens themselves."""
    named = lambda plain: let(F.regexp_replace(plain, FIELD, ANY), lambda m: F.when(m.isin(ANY, f"{ANY} {ANY}"), plain).otherwise(m))
    return let(F.trim(F.regexp_replace(line, SPACES, " ")), named)


def line_hash(m: Column) -> Column:
    return F.xxhash64(F.lit(7), m)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, h, pos, leaf, mh) of every line with a token."""
    found = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    tokens = found.select("doc_id", "h", "pos", masked(F.col("line")).alias("m")).withColumn("t", F.split("m", " "))
    return tokens.select("doc_id", "h", "pos", F.xxhash64(F.size("t"), *[F.get("t", F.lit(i)) for i in range(LEAD)]).alias("leaf"), line_hash(F.col("m")).alias("mh"))


def first_of(doc: str, *more: str) -> Column:
    return F.min(F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("doc_id"), *more))


def generalised(examples: DataFrame) -> DataFrame:
    """(leaf, mh, template) of ``examples`` (leaf, mh, docs, m)."""
    tokens = examples.withColumn("t", F.split("m", " ")).select("leaf", "mh", "docs", F.size("t").alias("n"), F.slice("t", 1, LEAD).alias("lead"), F.posexplode(F.slice("t", F.lit(LEAD + 1), F.size("t"))).alias("at", "token"))
    tokens = tokens.withColumn("th", F.xxhash64("token"))
    common = tokens.groupBy("leaf", "at", "th").agg(F.sum("docs").alias("f")).where(f"f >= {MIN_DOCS}").select("leaf", "at", "th", F.lit(True).alias("stands"))
    each = tokens.join(store(common, "tokens"), ["leaf", "at", "th"], "left").withColumn("token", F.when(F.col("stands"), F.col("token")).otherwise(ANY))
    stands = F.count("stands") + F.lit(LEAD)
    whole = each.groupBy("leaf", "mh", "n", "lead").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("ts"), stands.alias("stands"))
    template = line_hash(F.array_join(F.concat("lead", F.col("ts.token")), " "))
    return whole.where(F.col("stands") >= F.lit(LIKE) * F.col("n")).select("leaf", "mh", template.alias("template"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, gone) of the documents that lose lines: the positions of those lines."""
    lines = store(lines_of(docs), "lines")
    each = lines.groupBy("leaf", "mh", "doc_id", "h").agg(F.min("pos").alias("pos"))
    alike = store(each.groupBy("leaf", "mh").agg(F.count(F.lit(1)).alias("docs"), first_of("doc_id", "h", "pos").alias("at")), "alike")
    large = store(alike.groupBy("leaf").agg(F.sum("docs").alias("all"), F.count(F.lit(1)).alias("kinds")).where(f"all >= {MIN_DOCS}").select("leaf", "kinds"), "leaves")
    own = store(alike.join(large, "leaf").select("leaf", "mh", "docs", "at.doc_id", "at.h", "at.pos", "kinds"), "examples")
    wanted = own.where("kinds > 1").groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("pos", "leaf", "mh", "docs")).alias("w"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(wanted.hint("merge"), (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    said = let(F.split("text", "\n", -1), lambda ls: F.transform("w", lambda x: F.struct(x["leaf"].alias("leaf"), x["mh"].alias("mh"), x["docs"].alias("docs"), masked(F.get(ls, x["pos"])).alias("m"))))
    fetched = texts.select(F.explode(said).alias("w")).select("w.*")
    examples = store(fetched.groupBy("leaf", "mh", "docs").agg(F.first("m").alias("m")), "texts")
    named = store(own.select("leaf", "mh").join(generalised(examples), ["leaf", "mh"], "left").withColumn("template", F.coalesce("template", "mh")), "templates")
    placed = store(lines.join(named, ["leaf", "mh"]).select("doc_id", "h", "pos", "leaf", "template"), "placed")
    # written, so that the join below stands between two plain exchanges and a hot template's rows can be split
    recurring = placed.groupBy("leaf", "template", "doc_id", "h").agg(F.lit(1).alias("one")).groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs"), first_of("doc_id", "h").alias("first")).where(f"docs >= {MIN_DOCS}")
    recurring = store(recurring.select("leaf", "template", "first"), "recurring")
    gone = placed.join(recurring, ["leaf", "template"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))))
    return gone.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("gone"))


def cut(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their _lines, _gone and _kept (text) beside their own columns in _row."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"), F.col("text").alias("_text"))
    gone = dropped_lines(docs.select("doc_id", "text"))
    both = own.join(gone.hint("merge"), (F.col("_h") == F.col("h")) & F.col("_d").eqNullSafe(F.col("doc_id")), "left")
    stay = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone"))
    kept = let(F.split("_text", "\n", -1), lambda ls: F.array_join(F.transform(stay(ls), lambda i: F.get(ls, i)), "\n"))
    return both.select("_row", F.size(F.split(F.coalesce("_text", F.lit("")), "\n", -1)).cast("long").alias("_lines"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("_gone"), F.when(F.col("gone").isNull(), F.col("_text")).otherwise(kept).alias("_kept"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    c = cut(docs.select("doc_id", "text"))
    return c.select("_row.doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_dropped"), F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"))


def without_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the kept text, and n_chars to match; a document that loses all its words goes."""
    c = cut(docs).where((F.col("_gone") <= 0) | F.col("_kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("_kept"), "n_chars": F.when(F.col("_gone") > 0, F.length("_kept").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return c.select(*[new[k].alias(k) if new.get(k) is not None else F.col(f"_row.`{k}`") for k in docs.columns])


def oracle() -> str:
    """DuckDB SQL for ``digest`` over ``documents``, for distinct doc_ids that are not null."""
    mask = "regexp_replace(p, '[^ ]*[0-9][^ ]*', '<*>', 'g')"
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
b AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS p FROM l),
m AS (SELECT doc_id, pos, CASE WHEN {mask} IN ('<*>', '<*> <*>') THEN p ELSE {mask} END AS m FROM b),
k AS (SELECT *, [len(t)::VARCHAR, t[1], t[2], t[3]] AS leaf FROM (SELECT *, string_split(m, ' ') AS t FROM m WHERE m <> '')),
a AS (SELECT leaf, m, t, count(DISTINCT doc_id) AS docs FROM k GROUP BY leaf, m, t),
u AS (SELECT a.leaf, m, t, docs, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM a JOIN (SELECT leaf FROM a GROUP BY leaf HAVING sum(docs) >= {MIN_DOCS}) b ON a.leaf = b.leaf),
f AS (SELECT *, i <= {LEAD} OR sum(docs) OVER (PARTITION BY leaf, i, token) >= {MIN_DOCS} AS stands FROM u),
g AS (SELECT leaf, m, count(*) FILTER (stands) AS s, len(any_value(t)) AS n, list(CASE WHEN stands THEN token ELSE '<*>' END ORDER BY i) AS template FROM f GROUP BY leaf, m),
p AS (SELECT doc_id, pos, k.leaf, CASE WHEN s >= {LIKE} * n THEN array_to_string(template, ' ') ELSE k.m END AS template FROM k JOIN g ON k.leaf = g.leaf AND k.m = g.m),
r AS (SELECT leaf, template, min(doc_id) AS first FROM p GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
x AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM p JOIN r ON p.leaf = r.leaf AND p.template = r.template WHERE doc_id <> first GROUP BY doc_id),
d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, coalesce(gone, []) AS gone FROM documents LEFT JOIN x USING (doc_id))
SELECT doc_id, len(ls)::BIGINT AS n_lines, len(gone)::BIGINT AS n_dropped, sha256(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i)), chr(10))) AS kept_sha256 FROM d"""
