"""The queries of this subpackage's operators over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, langcrf, merkle, packing, pq, quality, replay, simhash, sitetree, token_store, toolcalls, topk, warc
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(spark, table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_documents(spark, table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, table(spark, sf_dir, "pages"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.format_turns(spark, table(spark, sf_dir, "conversations"))


def tool_calls_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op5 over the conversations with calls, results and declared tools put in: theirs hold none."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("skein_conversations")
    turns = spark.sql(toolcalls.MADE.replace("{conversations}", "skein_conversations"))
    found = toolcalls.format_turns(spark, turns).where("n_calls > 0")
    return found.select("conv_id", "turn", "n_calls", "n_linked", "n_invalid", F.get_json_object("message", "$.tool_calls[0].level").cast("long").alias("level"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langcrf.predict(spark, table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_vectors(spark, table(spark, sf_dir, "embeddings"))


def near_vectors_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op10 over the embeddings with near neighbours put beside them: theirs hold no pair so near."""
    return pq.near_vectors(spark, spark.sql(pq.MADE_SPARK, embeddings=table(spark, sf_dir, "embeddings")))


def op11_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(spark, table(spark, sf_dir, "conversations"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark, table(spark, sf_dir, "documents"), merkle.lowered_fifth())


def op13_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(spark, table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_main_text, op2_simhash, op3_token_store, op4_warc, op5_tool_calls, tool_calls_made, op6_quality, op7_language, op8_packing, op9_byte_bpe, op10_pq, near_vectors_made, op11_replay, op12_manifest, op13_top]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op11_replay": replay.ORACLE, "op12_manifest": merkle.ORACLE, "op13_top": topk.ORACLE, "near_vectors_made": pq.MADE_ORACLE, "op10_pq": pq.ORACLE, "op4_warc": warc.ORACLE, "op5_tool_calls": toolcalls.ORACLE, "tool_calls_made": toolcalls.MADE_ORACLE, "op6_quality": quality.ORACLE}
