"""Materialized tables in the shared folder named by ``spark.checkpoint.dir``.

The ETL writes the metrics table once; question operators read it (partition
pruning on ``metric``, min/max pushdown on the year) instead of recomputing
it from the raw facts. A written table also cuts lineage: a lost executor
re-reads files instead of re-running the joins.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ledgerframe.session import shared_dir
from ledgerframe.sources import files

VERSION = "1"
#: Beside the data of a copy; readers of the data skip names that begin so.
OBSERVED = "_observed.json"


def _fingerprint(spark: SparkSession, key: str, inputs: Sequence[str]) -> str:
    """Changes with the key, the inputs' paths and what is stored there."""
    stamped = [f"{p}|{files.stamp(spark, p)}" for p in inputs]
    return hashlib.sha1("|".join([VERSION, key, *stamped]).encode()).hexdigest()[:16]


def materialized(spark: SparkSession, key: str, build: Callable[[], DataFrame], inputs: Sequence[str],
                 partition_by: Sequence[str] = (), sort_by: Sequence[str] = (),
                 spread_by: Sequence[str] = (), spread: bool = False, observe: Sequence[Column] = ()) -> DataFrame:
    """Read table ``key`` for these inputs, writing it first if no complete copy is there.

    A copy is a folder of its own, so writers that meet do not disturb each other. A table that comes
    ``spread`` over tasks by keys of its own is written from where it is. The aggregates
    ``observe`` are computed in the pass that writes it and kept beside it (:func:`observed`)."""
    root = _root(spark, key, inputs)
    found = _complete(spark, root, bool(observe))
    if found:
        return spark.read.parquet(found)
    df, seen = build(), None
    if observe:
        seen = Observation()
        df = df.observe(seen, *observe)
    if (partition_by or spread_by) and not spread:  # the spread columns split the few partition values over many tasks
        df = df.repartition(*partition_by, *spread_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    path = f"{root}/copy-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if seen is not None:
        files.put_once(spark, f"{path}/{OBSERVED}", json.dumps(seen.get))
    return spark.read.parquet(path)


def observed(spark: SparkSession, key: str, inputs: Sequence[str]) -> dict | None:
    """What was observed while table ``key`` was written; None if no such copy is there."""
    found = _complete(spark, _root(spark, key, inputs), True)
    return json.loads(files.read_text(spark, f"{found}/{OBSERVED}")) if found else None


def _root(spark: SparkSession, key: str, inputs: Sequence[str]) -> str:
    return f"{shared_dir(spark)}/ledgerframe-tables/{key}-{_fingerprint(spark, key, inputs)}"


def _complete(spark: SparkSession, root: str, with_observed: bool) -> str | None:
    for name in files.children(spark, root):
        folder = f"{root}/{name}"
        if files.is_complete(spark, folder) and (not with_observed or files.exists(spark, f"{folder}/{OBSERVED}")):
            return folder
    return None
