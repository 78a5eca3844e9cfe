"""Incremental fact ingestion (T3): newly landed company-facts files are parsed once and
appended to the raw-fact store, with the rejected entries and why, and the metrics and filings of the companies they touch
are recomputed from all of those companies' facts and upserted into keyed tables (S4).

A micro-batch reads the facts of the hash buckets its companies lie in and writes as many
rows as those companies have: neither grows with the rest of the store.

Replay safety: each micro-batch writes its facts to its own ``run=<checkpoint>/epoch=<id>``
folder with overwrite, so a batch that Spark re-runs after a failure replaces its own output
instead of duplicating it; the tables know the batches they hold. Derived rows (Q4, fallback
liabilities) are recomputed for touched companies only; rows that a correction removes are not
deleted (the upsert never deletes).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.operators import derived, periods
from ledgerframe.sources.company_facts import (FACT_COLUMNS, facts_to_raw, landed_entries, load_metrics,
                                               quarantine_of)
from ledgerframe.sources.keyed_table import KeyedTable

FACT_BUCKETS = 64
ENTRIES = ("cik string, tag string, unit string, fy int, fp string, form string, start_date date, end_date date, "
           "filed date, accn string, val decimal(38,10), ord int, file_name string, reason string, raw string")


def metrics_table(spark: SparkSession, store_dir: str) -> KeyedTable:
    """All of a metric row's values follow the newest load."""
    return KeyedTable(spark, f"{store_dir}/metrics", ["company_id", "metric", "fiscal_year", "fiscal_period"],
                      ["value", "unit", "accn", "start_date", "end_date"])


def filings_table(spark: SparkSession, store_dir: str) -> KeyedTable:
    """A filing that is known only takes a new filing date."""
    return KeyedTable(spark, f"{store_dir}/filings", ["accn"], ["filed"])


def companies_table(spark: SparkSession, store_dir: str) -> KeyedTable:
    """Ticker, name and industry follow the newest load."""
    return KeyedTable(spark, f"{store_dir}/companies", ["cik"], ["ticker", "name", "sic_description"])


def upsert_companies(spark: SparkSession, store_dir: str, tickers: DataFrame, submissions: DataFrame,
                     batch: tuple[str, int] | None = None) -> dict:
    """Companies of the ticker map (S2) with their industry (S3); of a company's several
    tickers the first one of the map counts."""
    first = tickers.groupBy("cik").agg(F.min_by(F.struct("ticker", "title"), "rank").alias("t"))
    rows = first.join(submissions.dropDuplicates(["cik"]), "cik", "left").select(
        "cik", "t.ticker", F.col("t.title").alias("name"), "sic_description")
    return companies_table(spark, store_dir).upsert(rows, batch)


def _fact_bucket(cik: Column) -> Column:
    return F.pmod(F.xxhash64(cik), F.lit(FACT_BUCKETS)).cast("int")


def process_batch(spark: SparkSession, docs: DataFrame, epoch_id: int, store_dir: str, fy_min: int,
                  fy_max: int, run: str = "0") -> None:
    digits = F.regexp_extract("file_name", r"(\d+)", 1)
    docs = docs.select(F.when(digits != "", F.lpad(digits, 10, "0")).alias("cik"), "file_name", "body")
    entries = landed_entries(docs)
    own = f"run={run}/epoch={epoch_id}"
    bucket = F.coalesce(_fact_bucket(F.col("cik")), F.lit(0))
    entries.withColumn("rejected", F.col("reason").isNotNull()).withColumn("bucket", bucket).hint(
        "rebalance", "rejected", "bucket").write.mode("overwrite").partitionBy("rejected", "bucket").parquet(
        f"{store_dir}/facts/{own}")
    stored = stored_entries(spark, store_dir)
    all_facts = stored.where("not rejected")
    landed = all_facts.where((F.col("run") == run) & (F.col("epoch") == epoch_id))
    # At most FACT_BUCKETS numbers: they prune the scan of the store.
    buckets = [r["bucket"] for r in landed.select("bucket").distinct().collect()]
    if not buckets:
        return
    # Facts of a company may arrive in several files: recompute from all of them.
    touched = all_facts.where(F.col("bucket").isin(buckets)).join(
        landed.select("cik").distinct(), "cik", "left_semi").select(*FACT_COLUMNS)
    metrics_table(spark, store_dir).upsert(load_metrics(touched, fy_min, fy_max), (run, epoch_id))
    usable = periods.usable_facts(facts_to_raw(touched), fy_min, fy_max)
    merged = periods.merge_tags(periods.select_periods(usable, tiebreak=("ord",)))
    filings_table(spark, store_dir).upsert(derived.extract_filings(merged), (run, epoch_id))
    for table in (metrics_table(spark, store_dir), filings_table(spark, store_dir)):
        table.compact()


def stored_entries(spark: SparkSession, store_dir: str) -> DataFrame:
    """All entries that landed, by run, epoch, rejected and bucket. With an explicit schema: a batch
    without any entry leaves no file to infer one from."""
    return spark.read.schema(f"{ENTRIES}, run string, epoch long, rejected boolean, bucket int").parquet(
        f"{store_dir}/facts")


def rejected(spark: SparkSession, store_dir: str) -> DataFrame:
    """The entries and documents that were rejected, and why."""
    return quarantine_of(stored_entries(spark, store_dir).where("rejected"))


def start_ingest(spark: SparkSession, landing_dir: str, store_dir: str, checkpoint: str, fy_min: int,
                 fy_max: int, available_now: bool = True):
    """File-source stream over ``landing_dir`` (one JSON document per file)."""
    # A checkpoint counts its own epochs: a new one must not overwrite what another stored.
    run = "r" + hashlib.sha1(checkpoint.encode()).hexdigest()[:12]
    docs = (spark.readStream.format("text").option("wholetext", "true").load(landing_dir)
            .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("body")))
    writer = (docs.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, epoch: process_batch(spark, df, epoch, store_dir, fy_min, fy_max, run)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def current_metrics(spark: SparkSession, store_dir: str) -> DataFrame:
    return metrics_table(spark, store_dir).read()
