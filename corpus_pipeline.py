"""A training corpus from ``documents``: five stages, each writing a table that the next one reads.

Toxic documents go, boilerplate lines of each source go, one document of each group of near
copies stays, documents with benchmark passages go, and the rest is put in the order of a mix
of its sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.columns import fresh, same
from millrace.llm.decontamination import contaminated
from millrace.llm.line_dedup import drop_boilerplate
from millrace.llm.mixing import mix
from millrace.llm.near_dup import near_duplicates
from millrace.llm.queries import table
from millrace.llm.storage import materialise
from millrace.llm.toxicity import learn_and_score

#: Documents scoring at least this are toxic.
TOXIC = 0.5


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class models, learnt from the labelled ones among them, do not call toxic."""
    (score,) = fresh(docs, "score")
    return learn_and_score(docs, table(spark, sf_dir, "labels"), score=score).where(F.col(score) < TOXIC).select(docs.columns)


def remove_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many documents of their source share. ``n_chars`` follows the text.

    Exact copies count as one document, and a document of shared lines only stays whole for near-dedup, so
    that of a group of copies one keeps its text, however large the group is.
    """
    cleaned = drop_boilerplate(docs, copies_once=True, keep_emptied=True)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near copies (five-word shingles, 0.8) connect: that of least id, then of least text hash.

    Rows are told apart by id and text, so a near copy goes whoever shares its id, and documents without an id
    come last but are one group like others. A row that repeats another's id and text is dropped with the copies; documents
    without words have no copies and stay.
    """
    (name,) = fresh(docs, "row_name")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_hash"))
    named = docs.withColumn(name, row)
    found = near_duplicates(named.select(name, "text"), doc=name, shingle=5, percent=80)
    kept = found.where("kept").select(name).distinct()
    chosen = named.join(kept, same(named, kept, name), "left_semi")
    return chosen.dropDuplicates([name]).select(docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item; shorter items say too little and drop nothing."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), least=10).where("n_hit > 0")
    hit = found.select("doc_id", "text_hash").distinct()
    (name,) = fresh(docs, "text_hash")
    marked = docs.withColumn(name, F.xxhash64("text"))
    same_row = marked["doc_id"].eqNullSafe(hit["doc_id"]) & marked[name].eqNullSafe(hit["text_hash"])
    return marked.join(hit, same_row, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix; sources weigh the square root of their size."""
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_boilerplate_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
]

#: Class models and schedules cannot be said in SQL; ``tests/llm/test_queries.py`` has a version of plain steps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
