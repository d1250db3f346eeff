"""From documents to packed sequences: five stages, each over all that the one before it left.

A document that repeats (same id and text) is one that the stages treat alike.
Stages keep the columns of documents, and any others of whatever name, until
the last, which returns pieces. Each takes empty tables and gives empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import field, kept_at, new_path, remove_kept, scratch, table, whole_row
from tapewright.llm.line_dedup import line_dedup
from tapewright.llm.mixing import repeated
from tapewright.llm.near_dup import near_duplicates
from tapewright.llm.packing import best_fit
from tapewright.llm.quality_rules import quality_rules


def _named(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents whose ids are in verdicts; null ids match."""
    rows = docs.select(whole_row(docs, docs.columns).alias("row"), F.col("doc_id").alias("id"))
    ids = verdicts.select(F.col("doc_id").alias("named")).distinct()
    met = rows.join(ids, rows["id"].eqNullSafe(ids["named"]), "left_semi")
    return met.select(*[field("row", c) for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; of rows that repeat an id, all or, if one is rejected, none.

    Null and empty texts have too few words and go; rows with null ids are kept or rejected together.
    """
    judged = quality_rules(docs, table(spark, sf_dir, "labels"))
    verdicts = judged.groupBy("doc_id").agg(F.min("kept").alias("kept")).where("kept")
    return _named(docs, verdicts)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; n_chars follows the text. Emptied texts stay, null ones become empty."""
    left = line_dedup(docs.select(whole_row(docs, docs.columns).alias("row"), "doc_id", "text"))
    own = {"text": F.col("text").alias("text"), "n_chars": F.char_length("text").cast("long").alias("n_chars")}
    return left.select(*[own.get(c, field("row", c)) for c in docs.columns])


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, the one with the least id. Rows with null ids, and texts without words, stay."""
    return _named(docs, near_duplicates(docs, width=5).where("kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. A null source is a source; rows that repeat are taken alike."""
    return repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each copy packed for itself, and their places in sequences; a null or empty text is its end."""
    return best_fit(docs)


STAGES = [("quality rules", rules), ("line dedup", lines), ("MinHash near-dedup", near_dup), ("mixing", mixing), ("best-fit packing", packing)]

#: Quality rules, near-dedup and packing are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again. Its working tables and its input go then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark, "stage"):
            docs = kept_at(stage(spark, docs, sf_dir), path)
        remove_kept(before)
        before = docs
    return docs
