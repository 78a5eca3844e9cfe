"""The registered queries of this package. Each reads its whole table, runs its
operator with production parameters and returns the full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm import (alignment, binary_packing, chat, embedding_dedup, mtree, packing, periodic_runs,
                             pii, quality_lm, sentencepiece_fst, simhash, token_files, toxicity)
from ledgerframe.llm.oracles import ORACLE  # noqa: F401
from ledgerframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query
def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), capacity=4096, end_id=1)


@query
def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, distance=2)


@query
def op6_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"), kind="byte", end_id=1)


@query
def op2_sentencepiece_fst(spark, sf_dir):
    return sentencepiece_fst.digests(table(spark, sf_dir, "documents"))


@query
def op3_quality_kneser_ney(spark, sf_dir):
    return quality_lm.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_toxicity_fm(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                             threshold=0.7)


@query
def op8_pii_boosted(spark, sf_dir):
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


@query
def op9_chat_formatting(spark, sf_dir):
    probe = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(probe)))


@query
def op10_mtree_top_k(spark, sf_dir):
    return mtree.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10, scale=1024)


@query
def op11_token_alignment(spark, sf_dir):
    return alignment.digests(table(spark, sf_dir, "documents"))


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text with a periodic tail for one document in ten (by crc32 of the decimal id), as the
    registered query's contract plants them; other texts stay as they are."""
    code = F.crc32(F.col(id_col).cast("long").cast("string"))
    plant = F.floor(code / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        first = F.pmod(plant, n)
        period = F.floor((n - first) / (F.lit(3) + F.pmod(plant, F.lit(8)))) + 1
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - first - 1), lambda k: F.get(
            words, (first + F.pmod(k, period)).cast("int")))
        return F.when(n == 0, F.lit("")).otherwise(
            F.array_join(F.concat(F.slice(words, 1, first.cast("int")), tail), " "))

    # The words are bound to a variable, so that they are taken once.
    words = F.regexp_extract_all(F.col(text_col), F.lit("([^\\x20\\x09-\\x0D]+)"))
    return F.when(F.pmod(code, F.lit(10)) == 0, F.get(F.transform(F.array(words), planted), F.lit(0))
                  ).otherwise(F.col(text_col))


@query
def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return periodic_runs.digests(docs.select("doc_id", repeat_tails(docs).alias("text")))


@query
def op13_binary_packing(spark, sf_dir):
    return binary_packing.pack(table(spark, sf_dir, "documents"), capacity=2048, end_id=1)
