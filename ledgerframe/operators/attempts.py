"""Attempt logs of question requests: rollup (N5), retry statistics (N6) and
failure narratives (N7).

An attempt log has one row per attempt: request_id, attempt_number, outcome,
error_message, duration_ms (plus ts for windowed rollups). Every per-request
group is small (the retry loop stops at 3 attempts), so collecting a group's
attempts into an array is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.functions.columns import lookup

# --- fixed values -----------------------------------------------------------
# How each failed outcome is narrated; other outcomes are named as they are.
OUTCOME_PHRASES = {
    "guard_rejected": "was rejected by the SQL safety guard",
    "execution_error": "failed during execution",
    "empty_result": "ran successfully but returned no rows",
}
NARRATIVE_CLOSING = ("The question may reference data outside this database, "
                     "or may need rephrasing.")
# --- end of fixed values ----------------------------------------------------


def attempt_rollup(attempts: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request - attempts used, final outcome (of the last attempt),
    the outcomes in attempt order, total duration."""
    ordered = F.array_sort(F.collect_list(F.struct("attempt_number", "outcome")))
    return attempts.groupBy(key).agg(
        F.count("*").alias("attempts_used"),
        F.max_by("outcome", "attempt_number").alias("final_outcome"),
        F.array_join(F.transform(ordered, lambda s: s["outcome"]), ",").alias("outcomes"),
        F.sum("duration_ms").alias("total_duration_ms"),
    )


def retry_stats(rollup: DataFrame) -> DataFrame:
    """Share of requests that needed a 2nd / 3rd attempt, share that ended
    refused (unanswerable), and p50 / p95 of total request duration.

    The percentiles are exact at any size: the smallest duration whose cumulative
    share reaches p. Spark merges counts per distinct duration, and durations are
    whole milliseconds, so the buffer is bounded by the longest request."""
    n = F.count("*")
    return rollup.agg(
        n.alias("requests"),
        F.round(F.count_if(F.col("attempts_used") >= 2) / n, 6).alias("needed_second"),
        F.round(F.count_if(F.col("attempts_used") >= 3) / n, 6).alias("needed_third"),
        F.round(F.count_if(F.col("final_outcome") == "unanswerable") / n, 6).alias("refused_share"),
        F.expr("CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY total_duration_ms) AS BIGINT)").alias("p50_ms"),
        F.expr("CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY total_duration_ms) AS BIGINT)").alias("p95_ms"),
    )


def rejection_reasons(attempts: DataFrame) -> DataFrame:
    """Guard rejections by reason, with their count."""
    return (attempts.where(F.col("outcome") == "guard_rejected")
            .groupBy(F.col("error_message").alias("reason")).agg(F.count("*").alias("rejections")))


def failure_narrative(attempts: DataFrame, key: str = "request_id", closing: str = NARRATIVE_CLOSING) -> DataFrame:
    """For each request whose last attempt did not succeed, the plain-text
    account of what was tried, attempts in order."""
    phrase = F.coalesce(lookup(OUTCOME_PHRASES, F.col("outcome")), F.col("outcome"))
    detail = F.when(F.col("error_message").isNotNull() & (F.col("error_message") != ""),
                    F.format_string(" (%s)", F.col("error_message"))).otherwise(F.lit(""))
    line = F.format_string("Attempt %d %s%s.", F.col("attempt_number"), phrase, detail)
    per = attempts.groupBy(key).agg(
        F.count("*").alias("n"),
        F.max_by("outcome", "attempt_number").alias("final_outcome"),
        F.array_sort(F.collect_list(F.struct("attempt_number", line.alias("line")))).alias("lines"))
    failed = per.where(F.col("final_outcome") != "success")
    text = F.concat_ws(" ",
                       F.format_string("I could not answer this question after %d attempt(s).", F.col("n")),
                       F.array_join(F.transform("lines", lambda s: s["line"]), " "),
                       F.lit(closing))
    return failed.select(key, text.alias("answer"))


def windowed_rollup(attempts: DataFrame, duration: str = "1 hour", slide: str | None = None,
                    ts: str = "ts") -> DataFrame:
    """T2 (batch twin): attempts per event-time window - count, successes,
    mean duration. Tumbling when ``slide`` is None, else sliding."""
    w = F.window(ts, duration) if slide is None else F.window(ts, duration, slide)
    return (attempts.groupBy(w.alias("w")).agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("outcome") == "success").alias("successes"),
        F.round(F.avg("duration_ms"), 6).alias("avg_duration_ms"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "attempts", "successes", "avg_duration_ms"))
