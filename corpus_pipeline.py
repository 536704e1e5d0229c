"""The corpus pipeline: quality rules, language, near-duplicates, packing, each over all that its predecessor kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common, jaccard, langcrf, packing, quality, simhash
from skein.llm.components import named
from skein.llm.queries import tokenizer_file


#: Stages in order; docs of each is the result of the one before, written as Parquet and read again.
STAGES: list[tuple] = []
#: Folders that the result of the stage before may still be read from.
_left: list[str] = []


def stage(name: str):
    """A stage by name: what the stage before left in the shared folder goes first, its result being written and read again."""

    def enter(make):
        @wraps(make)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            while _left:
                common.remove(spark, _left.pop())
            with common.noted() as made:
                out = make(spark, docs, sf_dir)
            _left.extend(made)
            return out

        STAGES.append((name, run))
        return run

    return enter


@stage("quality")
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cutoff reject go."""
    return quality.keep_good(spark, docs, common.table(spark, sf_dir, "labels"))


@stage("language")
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with no language that their words agree on, go."""
    return langcrf.keep_known(spark, docs)


def least_rows(spark: SparkSession, docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Of each component of ``parts`` (id, component; ``jaccard.text_id()``), and of each other text, one row: that of the least doc_id, nulls last."""
    rows = docs.select("doc_id", jaccard.text_id().alias("text_id"))
    rows = rows.join(parts.select(F.col("id").alias("text_id"), "component"), "text_id", "left").select("doc_id", "text_id", F.coalesce("component", "text_id").alias("component"))
    rows = common.cut(spark, rows.groupBy("component", "doc_id", "text_id").count(), "rows")
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")).alias("least"), F.count(F.lit(1)).alias("n"))
    groups = common.cut(spark, least.where("n > 1").select("component", "least"), "groups")
    is_least = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_id") == F.col("least.text_id"))
    members = named(rows, groups, "component").select("doc_id", "text_id", "count", is_least.alias("stays"))
    alone = rows.where("count > 1").join(groups, "component", "left_anti").select("doc_id", "text_id", "count", F.lit(True).alias("stays"))
    marked = common.cut(spark, members.unionByName(alone).where("not stays or count > 1"), "marked")
    common.free(spark, rows, groups)
    marked = marked.select(F.col("doc_id").alias("of_doc"), F.col("text_id").alias("of_text"), "stays")
    same = F.col("of_doc").eqNullSafe(docs.doc_id) & (F.col("of_text") == F.xxhash64(docs.text.cast("binary")))
    kept = docs.join(marked, same, "left_anti")
    repeated = marked.where("stays")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


@stage("near_duplicates")
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: of groups by fingerprints first, then of texts whose five-word shingles
    are of Jaccard similarity 0.8 or more, by steps.

    A pair of 0.8 differs in about ten bits of 64 and up to twenty, where no tree over fingerprints rules anything out, so an
    exact prefix filter finds among what is left those that the fingerprints' rule of four bits does not. A text linked only
    through one that the fingerprints removed stays; no two texts of 0.8 or more are left.
    """
    found = simhash.near_duplicates(spark, docs.select(jaccard.text_id().alias("doc_id"), "text"))
    near = found.select(F.col("doc_id").alias("id"), F.col("component_id").alias("component")).distinct()
    left = common.cut(spark, least_rows(spark, docs, near), "left")
    return least_rows(spark, left, jaccard.near_copies(spark, left))


@stage("packing")
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows."""
    return packing.pack_documents(spark, docs, tokenizer_file("word_bpe_49k.json"), end_id=2)


#: Tokenizing and the learned labeller aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, make in STAGES[:-1]:
        docs = common.cut(spark, make(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
