"""Sinks: idempotent upsert into snapshot directories (S4), whole-table
rebuild (S5), capped result sets (S6) and JSON-safe rows (S7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe import domain
from ledgerframe.sources import files

SNAPSHOT = "snapshot-"


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], update_cols: Sequence[str]) -> DataFrame:
    """``INSERT ... ON CONFLICT (keys) DO UPDATE SET update_cols``.

    Full outer join on the keys. Where an update row exists, the listed columns
    take the update's value even when it is NULL (a presence flag decides,
    not ``coalesce``); other columns keep the target's value; new keys come in
    whole; nothing is ever deleted. ``updates`` must be unique on ``keys``
    (check with D1). Running it twice with the same updates gives the same
    table."""
    keys = list(keys)
    cols = [c for c in target.columns]
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in cols if c not in keys], F.lit(True).alias("_t"))
    u = updates.select(*keys, *[F.col(c).alias(f"u_{c}") for c in cols if c not in keys], F.lit(True).alias("_u"))
    j = t.join(u, keys, "full_outer")
    has_u = F.col("_u").isNotNull()
    has_t = F.col("_t").isNotNull()
    out = []
    for c in cols:
        if c in keys:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(has_u, F.col(f"u_{c}")).otherwise(F.col(f"t_{c}")).alias(c))
        else:
            out.append(F.when(has_t, F.col(f"t_{c}")).otherwise(F.col(f"u_{c}")).alias(c))
    return j.select(*out)


def upsert_snapshot(spark: SparkSession, table_dir: str, updates: DataFrame, keys: Sequence[str],
                    update_cols: Sequence[str], partition_by: Sequence[str] = ()) -> str:
    """S4 on storage: read the current snapshot and write the merged table to
    the next numbered snapshot folder, which is current as soon as its job has
    committed. The plan never reads and overwrites the same path, and a failed
    job leaves the old snapshot current. One writer at a time. Returns the new
    snapshot path."""
    current = current_snapshot(spark, table_dir)
    merged = updates if current is None else upsert(spark.read.parquet(current), updates, keys, update_cols)
    # A folder that a failed job left behind keeps its number.
    number = max((int(n.removeprefix(SNAPSHOT)) for n in _snapshots(spark, table_dir)), default=0) + 1
    new = f"{table_dir}/{SNAPSHOT}{number:012d}"
    writer = merged.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(new)
    return new


def _snapshots(spark: SparkSession, table_dir: str) -> list[str]:
    return [n for n in files.children(spark, table_dir) if n.startswith(SNAPSHOT)]


def current_snapshot(spark: SparkSession, table_dir: str) -> str | None:
    """The latest snapshot that was written to its end, found on the table's own store."""
    for name in reversed(_snapshots(spark, table_dir)):
        if files.is_complete(spark, f"{table_dir}/{name}"):
            return f"{table_dir}/{name}"
    return None


def rebuild(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Whole-table replace, so renamed or removed rows leave no orphan."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def capped(df: DataFrame, order: Sequence[Column | str], n: int = domain.RESULT_ROW_CAP) -> DataFrame:
    """The first ``n`` rows in a total ``order`` plus ``truncated``, true
    exactly when more than ``n`` rows exist. Only n + 1 rows are ever taken
    (TakeOrderedAndProject); the flag is a scalar subquery over them. (The
    reference flags a result of exactly n rows as truncated too; this flag
    is exact.)"""
    truncated = (df.orderBy(*order).limit(n + 1).agg((F.count("*") > n).alias("t")).scalar())
    return df.orderBy(*order).limit(n).withColumn("truncated", truncated)


def json_safe(df: DataFrame) -> DataFrame:
    """Decimals to double, dates and timestamps to ISO strings, the rest as is."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def to_json_lines(df: DataFrame) -> DataFrame:
    """S7 as a sink format: one JSON object per row."""
    return json_safe(df).select(F.to_json(F.struct("*")).alias("json"))
