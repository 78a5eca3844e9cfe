"""Landed source documents: company facts (S1), ticker map (S2), submissions
(S3), with a quarantine of documents and single entries (E16), and the full load from them.

Tag and unit names are data-dependent keys, so they are MAP keys, exploded into rows. Company
facts are parsed once, as VARIANT: an entry whose fields have another type than expected
becomes a row with a reason and leaves the other entries of its document alone. The
CIK comes from the file name, as the source takes it from the URL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe import domain
from ledgerframe.operators import derived, periods

#: Fields of an entry and their types; all but the start are required.
ENTRY_FIELDS = {"start": "date", "end": "date", "val": "decimal(38,10)", "accn": "string", "fy": "int",
                "fp": "string", "form": "string", "filed": "date"}
OPTIONAL_FIELDS = ["start"]
FACT_COLUMNS = ["cik", "tag", "unit", "fy", "fp", "form", "start_date", "end_date", "filed", "accn", "val", "ord"]
TICKER_MAP_SCHEMA = T.MapType(T.StringType(), T.StructType([
    T.StructField("cik_str", T.LongType()), T.StructField("ticker", T.StringType()),
    T.StructField("title", T.StringType())]))
SUBMISSIONS_SCHEMA = T.StructType([T.StructField("sicDescription", T.StringType())])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (cik, body). The CIK is the digits of the file name,
    zero-padded to 10."""
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("body"))
    digits = F.regexp_extract("file_name", r"(\d+)", 1)
    return docs.select(F.when(digits != "", F.lpad(digits, 10, "0")).alias("cik"), "file_name", "body")


def _entry(name: str, kind: str) -> Column:
    return F.try_variant_get("entry", f"$.{name}", kind)


def landed_entries(docs: DataFrame, tags: Sequence[str] | None = None) -> DataFrame:
    """S1 + E16 in one pass: the :data:`FACT_COLUMNS`, ``file_name``, ``reason`` and ``raw`` of every entry.

    ``ord`` is the entry's position in its tag/unit list (for "first entry wins" ties). ``reason`` is
    NULL for a fact; otherwise it names the field that is missing or of another type, and
    ``raw`` has the entry as it came. A document that does not parse, and a tag or unit that is
    no list of entries, is one row with a reason. Nothing fails the batch. ``tags`` limits the walk
    to the tags in use (applied to the map keys before anything is exploded)."""
    parsed = docs.select("cik", "file_name", "body", F.try_parse_json("body").alias("doc"))
    known = F.try_variant_get("doc", "$.facts", "map<string, variant>")
    gaap = F.try_variant_get("doc", "$.facts['us-gaap']", "map<string, variant>")
    if tags is not None:
        wanted = F.array(*[F.lit(t) for t in tags])
        gaap = F.map_filter(gaap, lambda k, v: F.array_contains(wanted, k))
    bad_doc = F.when(F.col("cik").isNull(), "no CIK in file name").when(known.isNull(), "malformed company facts")
    by_tag = parsed.select("cik", "file_name", bad_doc.alias("bad_doc"),
                           F.when(bad_doc.isNotNull(), F.col("body")).alias("body"),
                           F.explode_outer(F.when(bad_doc.isNull(), gaap)).alias("tag", "t"))
    units = F.try_variant_get("t", "$.units", "map<string, variant>")
    by_unit = by_tag.select("*", units.isNull().alias("no_units"), F.explode_outer(units).alias("unit", "list"))
    entries = F.try_variant_get("list", "$", "array<variant>")
    rows = by_unit.select("*", entries.isNull().alias("no_list"), F.posexplode_outer(entries).alias("ord", "entry"))
    required = F.lit(None).cast("string")
    for name, kind in reversed(ENTRY_FIELDS.items()):
        given = _entry(name, "variant")
        missing = given.isNull() | F.is_variant_null(given)
        if name in OPTIONAL_FIELDS:
            required = F.when(~missing & _entry(name, kind).isNull(), f"bad {name}").otherwise(required)
        else:
            required = F.when(missing, f"missing {name}").when(_entry(name, kind).isNull(), f"bad {name}").otherwise(required)
    reason = (F.when(F.col("bad_doc").isNotNull(), F.col("bad_doc"))
              .when(F.col("tag").isNotNull() & F.col("no_units"), "tag without units")
              .when(F.col("unit").isNotNull() & F.col("no_list"), "unit without entries")
              .when(F.col("ord").isNotNull(), required))
    named = {"start": "start_date", "end": "end_date"}
    fields = [_entry(n, k).alias(named.get(n, n)) for n, k in ENTRY_FIELDS.items()]
    raw = F.coalesce("body", F.to_json("entry"), F.to_json("list"), F.to_json("t"))
    whole = rows.select("cik", "file_name", "tag", "unit", *fields, "ord", reason.alias("reason"), raw.alias("raw"))
    # Documents, tags and units without any entry have nothing to say.
    some = whole.where("ord is not null or reason is not null")
    return some.select(*FACT_COLUMNS, "file_name", "reason", F.when(F.col("reason").isNotNull(), F.col("raw")).alias("raw"))


def facts_of(entries: DataFrame) -> DataFrame:
    return entries.where("reason is null").select(*FACT_COLUMNS)


def quarantine_of(entries: DataFrame) -> DataFrame:
    """``(cik, file_name, tag, unit, ord, reason, raw)``: what was rejected, and why."""
    return entries.where("reason is not null").select("cik", "file_name", "tag", "unit", "ord", "reason", "raw")


def parse_company_facts(docs: DataFrame, tags: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S1 + E16 as two frames, (facts, quarantine). Each parses when it is used: a job that needs both
    writes :func:`landed_entries` and reads both from there."""
    entries = landed_entries(docs, tags)
    return facts_of(entries), quarantine_of(entries)


def read_company_facts(spark: SparkSession, path: str, tags: Sequence[str] | None = None):
    """S1 on files: one company-facts document per file."""
    return parse_company_facts(read_documents(spark, path), tags)


def read_ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """(rank, cik, ticker, title); rank = the entry's key (file order is
    market-cap order), cik zero-padded to 10, ticker upper-cased."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", TICKER_MAP_SCHEMA).alias("m"))
    return doc.select(F.explode("m").alias("k", "e")).select(
        F.col("k").cast("int").alias("rank"),
        F.lpad(F.col("e.cik_str").cast("string"), 10, "0").alias("cik"),
        F.upper("e.ticker").alias("ticker"), F.col("e.title").alias("title"))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """S3: (cik, sic_description); an empty description becomes NULL."""
    docs = read_documents(spark, path)
    return docs.select("cik", F.nullif(F.from_json("body", SUBMISSIONS_SCHEMA)["sicDescription"], F.lit(""))
                       .alias("sic_description"))


def facts_to_raw(facts: DataFrame, metric_tags: Mapping[str, Sequence[str]] | None = None,
                 metric_units: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Attach the metric to each fact through the (metric, tag, unit) table:
    a tag counts for a metric only in that metric's source unit."""
    metric_tags = domain.METRIC_TAGS if metric_tags is None else metric_tags
    metric_units = domain.METRIC_UNIT if metric_units is None else metric_units
    rows = [(m, tag, metric_units[m][0]) for m, tags in metric_tags.items() for tag in tags]
    spark = facts.sparkSession
    # The tag table is configuration, a fixed handful of rows: broadcast.
    table = F.broadcast(spark.createDataFrame(rows, "metric STRING, tag STRING, unit STRING"))
    return facts.join(table, ["tag", "unit"]).select(
        F.col("cik").alias("company_id"), "metric", "tag", "fy", "fp", "form", "start_date", "end_date",
        "filed", "accn", F.col("val").try_cast(domain.VALUE_TYPE).alias("val"), "ord")


#: The two sides of the balance-sheet identity, as metrics of the load that are not kept.
IDENTITY_TAGS = {"identity_total": [domain.LIABILITIES_TOTAL_TAG], "identity_equity": domain.EQUITY_TAGS}


def liabilities_from_identity(rows: DataFrame) -> DataFrame:
    """E9 over metric rows that include both sides of the identity: where a period has no liabilities row
    and both sides share an end date, one is derived; the sides themselves go. One group holds a
    company's metrics of one period, a handful of rows."""
    cols = [c for c in rows.columns if c not in derived.SNAPSHOT_KEYS]

    def side(metric: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.struct("end_date", "accn", "value")))

    grouped = rows.groupBy(*derived.SNAPSHOT_KEYS).agg(
        F.collect_list(F.struct(*cols)).alias("own"), F.max(F.col("metric") == "total_liabilities").alias("has"),
        side("identity_total").alias("t"), side("identity_equity").alias("e"))
    known = {"metric": F.lit("total_liabilities"), "unit": F.lit("USD"), "end_date": F.col("t.end_date"),
             "accn": F.col("t.accn"), "value": (F.col("t.value") - F.col("e.value")).cast(domain.VALUE_TYPE)}
    types = dict(rows.dtypes)
    made = F.struct(*[known.get(c, F.lit(None)).cast(types[c]).alias(c) for c in cols])
    fits = ~F.col("has") & (F.col("t.end_date") == F.col("e.end_date"))
    kept = F.filter("own", lambda r: ~r["metric"].isin(*IDENTITY_TAGS))
    every = F.explode(F.when(fits, F.array_append(kept, made)).otherwise(kept)).alias("r")
    return grouped.select(*derived.SNAPSHOT_KEYS, every).select(
        *[F.col(c) if c in derived.SNAPSHOT_KEYS else F.col(f"r.{c}").alias(c) for c in rows.columns])


def load_metrics(facts: DataFrame, fy_min: int, fy_max: int) -> DataFrame:
    """The whole load from source facts, which are read once: E1-E8, E10, E12, and the E9 fallback from
    total (liabilities + equity) minus equity, whose sides go through the same selection."""
    tags = {**domain.METRIC_TAGS, **IDENTITY_TAGS}
    units = {**domain.METRIC_UNIT, **{m: ("USD", "USD") for m in IDENTITY_TAGS}}
    rows = periods.build_metrics(facts_to_raw(facts, tags, units), fy_min, fy_max, metric_tags=tags, tiebreak=("ord",))
    return liabilities_from_identity(rows)
