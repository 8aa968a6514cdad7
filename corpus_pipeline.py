"""From raw documents to token ids: five stages, each reading what its predecessor wrote.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of
``documents``. ``run`` writes each result to the shared folder and reads it again as the next one's input.
"""

from pyspark.sql import DataFrame, SparkSession

from loamgrid.llm import line_templates, mixing, near_dup, pieces, quality
from loamgrid.llm.queries import piece_model
from loamgrid.llm.shared import scratch, table, tidied, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for their first document."""
    return line_templates.without_lines(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the source bytes of each."""
    return pieces.encode(docs, piece_model())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", minhash_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", to_pieces),
]
#: The near-duplicate, mixing and encoding stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again, and what a stage wrote on the way is removed."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{k}")
        with tidied(spark):
            docs = written(stage(spark, docs, sf_dir), path)
    return docs
