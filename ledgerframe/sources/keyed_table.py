"""Keyed tables that take upserts by writing only what changed.

Rows lie in hash buckets of the key. An upsert writes its rows as one delta folder,
split by bucket, and commits by putting the next numbered manifest, one small file that
lists the folders of every bucket in order. Readers take the newest manifest: buckets
with one folder are read as they are, in the others each key's rows are merged (one
aggregate). Compaction rewrites the buckets that have gathered many folders.

Two writers that meet put the same manifest number: one of them succeeds, the other
reads the new manifest and puts its own folder behind. A batch that is replayed is found
by its run and number in the manifest and changes nothing. Files in no manifest belong
to failed or beaten writers; :meth:`KeyedTable.vacuum` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerframe.functions.columns import lookup
from ledgerframe.sources import files

BUCKETS = 64
#: Folders of a bucket beyond which compaction rewrites it.
MAX_FOLDERS = 8


class KeyedTable:
    """``keys`` are unique (NULLs equal); ``update_cols`` take a later row's value, also NULL,
    the other columns keep the first one. ``bucket_by`` (one of the keys) and ``buckets`` must
    be the same for all writers of a table."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], update_cols: Sequence[str],
                 bucket_by: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.update_cols = list(keys), list(update_cols)
        self.bucket_by, self.buckets = bucket_by or self.keys[0], buckets

    # ------------------------------------------------------------------ manifests
    def manifest(self) -> dict:
        """The newest manifest; version 0 is an empty table."""
        names = files.names(self.spark, f"{self.path}/_versions")
        if not names:
            return {"version": 0, "schema": None, "folders": {}, "buckets": {}, "applied": {}}
        return json.loads(files.read_text(self.spark, f"{self.path}/_versions/{names[-1]}"))

    def _commit(self, change: Callable[[dict], dict | None]) -> dict:
        """Puts the manifest that ``change`` makes of the newest one, again if another writer
        was first; ``change`` returns None if there is nothing to do any more."""
        while True:
            old = self.manifest()
            new = change(json.loads(json.dumps(old)))
            if new is None:
                return old
            new["version"] = old["version"] + 1
            name = f"{self.path}/_versions/{new['version']:012d}.json"
            if files.put_once(self.spark, name, json.dumps(new)):
                return new

    # ------------------------------------------------------------------ writing
    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """A new data folder with one part per bucket; the buckets that have rows."""
        folder = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(F.col(self.bucket_by).cast("string")), F.lit(self.buckets)).cast("int")
        # A rebalance splits a bucket that is far larger than the others over several tasks.
        rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(
            f"{self.path}/data/{folder}")
        parts = files.children(self.spark, f"{self.path}/data/{folder}")
        return folder, [p.removeprefix("bucket=") for p in parts if p.startswith("bucket=")]

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> dict:
        """Inserts or updates ``rows`` (unique on the keys). ``batch`` is ``(run, number)`` with
        rising numbers: one that was applied before changes nothing. Returns the manifest."""
        def applied(state: dict) -> bool:
            return batch is not None and state["applied"].get(batch[0], -1) >= batch[1]

        if applied(state := self.manifest()):
            return state
        folder, touched = self._write(rows)

        def add(state: dict) -> dict | None:
            if applied(state):
                return None
            state["schema"] = state["schema"] or rows.schema.jsonValue()
            if touched:
                state["folders"][folder] = state["version"] + 1
            for bucket in touched:
                state["buckets"].setdefault(bucket, []).append(folder)
            if batch is not None:
                state["applied"][batch[0]] = batch[1]
            return state

        return self._commit(add)

    def compact(self, max_folders: int = MAX_FOLDERS) -> dict:
        """Rewrites the buckets with more than ``max_folders`` folders as one folder."""
        state = self.manifest()
        many = {b: f for b, f in state["buckets"].items() if len(f) > max_folders}
        if not many:
            return state
        folder, _ = self._write(self._rows(state, list(many)))
        last = max(state["folders"][f] for own in many.values() for f in own)

        def replace(now: dict) -> dict | None:
            # Folders that came since stay behind the new one; a bucket that another
            # compaction has rewritten stays as that one left it.
            done = {b: f for b, f in many.items() if now["buckets"][b][:len(f)] == f}
            if not done:
                return None
            for bucket, merged in done.items():
                now["buckets"][bucket] = [folder, *now["buckets"][bucket][len(merged):]]
            now["folders"][folder] = last
            used = {f for own in now["buckets"].values() for f in own}
            now["folders"] = {f: v for f, v in now["folders"].items() if f in used}
            return now

        return self._commit(replace)

    def vacuum(self, keep_versions: int = 2, hours: float = 24.0) -> list[str]:
        """Deletes data folders that none of the newest manifests lists and nothing has changed
        for ``hours`` (a writer at work has not committed yet), and older manifests."""
        names = files.names(self.spark, f"{self.path}/_versions")
        kept = {f for n in names[-keep_versions:] for f in
                json.loads(files.read_text(self.spark, f"{self.path}/_versions/{n}"))["folders"]}
        gone = [f for f in files.children(self.spark, f"{self.path}/data")
                if f not in kept and files.age_hours(self.spark, f"{self.path}/data/{f}") >= hours]
        for name in names[:-keep_versions]:
            files.remove(self.spark, f"{self.path}/_versions/{name}")
        for folder in gone:
            files.remove(self.spark, f"{self.path}/data/{folder}")
        return gone

    # ------------------------------------------------------------------ reading
    def read(self, only: Sequence[str] | None = None) -> DataFrame:
        """The table, or the buckets of ``only`` (as :meth:`buckets_of` gives them)."""
        state = self.manifest()
        if state["schema"] is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._rows(state, only)

    def _rows(self, state: dict, only: Sequence[str] | None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        own = {b: f for b, f in state["buckets"].items() if only is None or b in only}
        single = [f"{self.path}/data/{f[0]}/bucket={b}" for b, f in own.items() if len(f) == 1]
        several = [f"{self.path}/data/{x}/bucket={b}" for b, f in own.items() if len(f) > 1 for x in f]
        reader = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        parts = [reader.parquet(*single)] if single else []
        if several:
            place = F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/", 1)
            rows = reader.parquet(*several).select("*", lookup(state["folders"], place).alias("__version"))
            first = [c for c in schema.names if c not in self.keys and c not in self.update_cols]
            merged = rows.groupBy(*self.keys).agg(
                F.max_by(F.struct(*self.update_cols), "__version").alias("__new"),
                F.min_by(F.struct(F.lit(0).alias("__"), *first), "__version").alias("__old"))
            parts.append(merged.select(*[F.col(c) if c in self.keys else F.col(
                "__new" if c in self.update_cols else "__old")[c].alias(c) for c in schema.names]))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
