"""Company universe: ranked ticker map, overrides and explicit ticker lists
(E3-E5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe import domain


def top_n_universe(ticker_map: DataFrame, n: int) -> DataFrame:
    """By rank, the first ticker of each CIK (share classes collapse onto
    the higher-ranked ticker), then the first ``n`` CIKs. ``ticker_map`` has
    (rank, cik, ticker, title). The first-per-CIK step is an aggregate with a
    partial stage, the top-n a TakeOrderedAndProject (only n rows per task
    are shuffled)."""
    first = ticker_map.groupBy("cik").agg(
        F.min_by(F.struct("rank", "ticker", "title"), F.col("rank")).alias("f"))
    return (first.select(F.col("f.rank").alias("rank"), "cik", F.col("f.ticker").alias("ticker"),
                         F.col("f.title").alias("title"))
            .orderBy("rank").limit(n))


def apply_overrides(ticker_map: DataFrame, overrides: DataFrame) -> DataFrame:
    """An override (ticker, cik, title) wins over the ticker map's entry.
    The override list is a hand-kept, fixed-size table: broadcast."""
    o = overrides.select("ticker", F.col("cik").alias("o_cik"), F.col("title").alias("o_title"))
    j = ticker_map.join(F.broadcast(o), "ticker", "left")
    return j.select("rank", F.coalesce("o_cik", "cik").alias("cik"), "ticker",
                    F.coalesce("o_title", "title").alias("title"))


def requested_tickers(spark: SparkSession, tickers: Sequence[str]) -> DataFrame:
    """E5 input: trim, upper-case, drop blanks and repeats."""
    df = spark.createDataFrame([(t,) for t in tickers], T.StructType([T.StructField("raw", T.StringType())]))
    return (df.select(F.upper(F.trim("raw")).alias("ticker")).where(F.col("ticker") != "")
            .dropDuplicates(["ticker"]))


def resolve_universe(requested: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """E5: explicit tickers -> (ticker, found, cik, title). Unknown tickers are
    reported with found = false, not fatal. A ticker appearing twice in the
    map resolves to its best-ranked entry."""
    best = ticker_map.groupBy("ticker").agg(F.min_by(F.struct("cik", "title"), F.col("rank")).alias("b"))
    j = requested.join(best, "ticker", "left")
    return j.select("ticker", F.col("b").isNotNull().alias("found"),
                    F.col("b.cik").alias("cik"), F.col("b.title").alias("title"))


def choose_universe(spark: SparkSession, ticker_map: DataFrame, tickers: Sequence[str] | None = None,
                    top_n: int | None = None, default: Sequence[str] = tuple(domain.DEFAULT_TICKERS)) -> DataFrame:
    """E5 in the order of the load: explicit ``tickers`` if any are given, else the ``top_n`` companies of the
    map, else the ``default`` list. (ticker, found, cik, title) as :func:`resolve_universe`."""
    if tickers:
        return resolve_universe(requested_tickers(spark, tickers), ticker_map)
    if top_n:
        top = top_n_universe(ticker_map, top_n)
        return top.select("ticker", F.lit(True).alias("found"), "cik", "title")
    return resolve_universe(requested_tickers(spark, default), ticker_map)


def found_and_missing(requested: DataFrame, ticker_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E5 as two outputs: ``left_semi`` for found, ``left_anti`` for not found."""
    keys = ticker_map.select("ticker")
    return requested.join(keys, "ticker", "left_semi"), requested.join(keys, "ticker", "left_anti")
