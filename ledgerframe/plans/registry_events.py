"""Registered queries over embeddings, conversations and events: retrieval
(R), response handling (N1, N8), attempt analytics (N5-N7), evaluation over
the attempt log (V2, V4, V5) and the batch twins of the streams (T1b, T2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.operators import attempts, evaluate, questions, responses, retrieval, vector_index
from ledgerframe.plans import fixture_views as fv
from ledgerframe.plans.oracle_views import with_views
from ledgerframe.plans.registry import register
from ledgerframe.session import prepare
from ledgerframe.sources.tables import Tables

# FIXTURES.md §3: vec_id % 25 = 0 are queries, against all other rows; the index (R3) is asked every 50th
QUERY_SHARE, INDEX_QUERY_SHARE = 25, 50
K = 8


def _t(spark, sf_dir) -> Tables:
    prepare(spark)
    return Tables(spark, sf_dir)


def _vectors(t: Tables, share: int = QUERY_SHARE) -> tuple[DataFrame, DataFrame]:
    e = t.embeddings.select("vec_id", "embedding", "label")
    q = e.where(F.col("vec_id") % share == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return q, e.withColumnRenamed("vec_id", "doc_id")


TOPK_SQL = f"""
SELECT query_id, doc_id, ROUND(sim, 6) AS similarity, rank FROM (
  SELECT query_id, doc_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank
  FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
               list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS sim
        FROM embeddings q, embeddings d WHERE q.vec_id % {QUERY_SHARE} = 0 AND d.vec_id <> q.vec_id) p
  WHERE sim IS NOT NULL AND NOT isnan(sim)) r
WHERE rank <= {K}"""


@register("R2_topk_exact", TOPK_SQL)
def q_r2(spark, sf_dir):
    q, d = _vectors(_t(spark, sf_dir))
    top = retrieval.topk_cosine(q, d, K, but_own=True)
    return top.select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), "rank")


def _doc_texts(t: Tables) -> DataFrame:
    """The texts behind the vectors: document ``doc_id`` of the table ``documents``."""
    return t.documents.select("doc_id", F.col("source").alias("doc_type"),
                              F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"),
                              F.col("text").alias("content"))


@register("R4_context_pack", f"""
WITH top AS ({TOPK_SQL})
SELECT top.query_id,
       string_agg('[' || d.source || '] document ' || d.doc_id || chr(10) || d.text,
                  chr(10) || chr(10) ORDER BY top.rank) AS context
FROM top JOIN documents d ON d.doc_id = top.doc_id GROUP BY top.query_id""")
def q_r4(spark, sf_dir):
    t = _t(spark, sf_dir)
    q, d = _vectors(t)
    return retrieval.context_pack(retrieval.topk_cosine(q, d, K, but_own=True), _doc_texts(t))


def _index(spark, sf_dir, docs: DataFrame) -> vector_index.VectorIndex:
    """Built once for the table as it is stored."""
    return vector_index.stored_index(spark, "r3", docs, [f"{sf_dir.rstrip('/')}/embeddings.parquet"])


@register("R3_topk_approx")
def q_r3(spark, sf_dir):
    q, d = _vectors(_t(spark, sf_dir), INDEX_QUERY_SHARE)
    return _index(spark, sf_dir, d).top_k(q, K, but_own=True)


@register("R3_recall_report")
def q_r3r(spark, sf_dir):
    q, d = _vectors(_t(spark, sf_dir), INDEX_QUERY_SHARE)
    index = _index(spark, sf_dir, d)
    exact = retrieval.topk_cosine(q, d, K, but_own=True)
    return retrieval.recall_report(exact, index.top_k(q, K, but_own=True), index.survivors(q, K, but_own=True), q, d)


@register("R1_embed_conversations")
def q_r1(spark, sf_dir):
    c = _t(spark, sf_dir).conversations.select("conv_id", "turn", "text")
    return retrieval.embed_documents(c, "text", dim=64).select("conv_id", "turn", "embedding")


# ============================================================ N1, N8
@register("N1_valid_questions", """
SELECT conv_id, turn, length(text) AS n_chars,
  CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 3 THEN 'too_short'
       WHEN length(text) > 1000 THEN 'too_long' END AS reject_reason
FROM conversations""")
def q_n1(spark, sf_dir):
    c = _t(spark, sf_dir).conversations.select("conv_id", "turn", "text")
    return questions.validate_questions(c).select("conv_id", "turn", "n_chars", "reject_reason")


# DuckDB (RE2) has no lookarounds and an ASCII-only \b; word boundaries are
# spelled out with Unicode letter / digit classes instead.
_W = r"\p{L}\p{N}_"
N8_SQL = rf"""
WITH resp AS (
  SELECT conv_id, turn,
    CASE conv_id % 4 WHEN 0 THEN '```sql' || chr(10) || text || chr(10) || '```'
                     WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```'
                     WHEN 2 THEN 'CANNOT_ANSWER: ' || text ELSE text END AS t
  FROM conversations),
parts AS (
  SELECT conv_id, turn, t,
    regexp_matches(t, '(?m)^\s*CANNOT_ANSWER:\s*(.+)$') AS has_refusal,
    regexp_replace(regexp_extract(t, '(?m)^\s*CANNOT_ANSWER:\s*(.+)$', 1), '^\s+|\s+$', '', 'g') AS refusal,
    regexp_matches(t, '(?is)```sql\s*(.+?)```') AS has_sql,
    regexp_replace(regexp_extract(t, '(?is)```sql\s*(.+?)```', 1), '^\s+|\s+$', '', 'g') AS sql_block,
    regexp_matches(t, '(?s)```\s*(.+?)```') AS has_fence,
    regexp_replace(regexp_extract(t, '(?s)```\s*(.+?)```', 1), '^\s+|\s+$', '', 'g') AS cand,
    regexp_matches(t, '(?is)(^|[^{_W}])(select|with)([^{_W}]|$)') AS has_bare,
    regexp_replace(regexp_extract(t, '(?is)(?:^|[^{_W}])((?:select|with)(?:[^{_W}].*)?)$', 1),
                   '^\s+|\s+$', '', 'g') AS bare
  FROM resp),
fenced AS (
  SELECT *, CASE WHEN strpos(cand, chr(10)) > 0
                  AND regexp_full_match(regexp_replace(split_part(cand, chr(10), 1), '^\s+|\s+$', '', 'g'),
                                        '[A-Za-z][{_W}+-]*')
                  AND upper(regexp_replace(split_part(cand, chr(10), 1), '^\s+|\s+$', '', 'g'))
                      NOT IN ('SELECT', 'WITH')
             THEN regexp_replace(substr(cand, strpos(cand, chr(10)) + 1), '^\s+|\s+$', '', 'g')
             ELSE cand END AS fenced_sql
  FROM parts)
SELECT conv_id, turn,
  CASE WHEN has_refusal THEN 'refusal' WHEN has_sql THEN 'sql_fence'
       WHEN has_fence AND fenced_sql <> '' THEN 'any_fence' WHEN has_bare THEN 'bare' ELSE 'no_match' END AS kind,
  CASE WHEN has_refusal THEN refusal WHEN has_sql THEN sql_block
       WHEN has_fence AND fenced_sql <> '' THEN fenced_sql WHEN has_bare THEN bare END AS extracted
FROM fenced"""


@register("N8_extract_blocks", N8_SQL)
def q_n8(spark, sf_dir):
    c = _t(spark, sf_dir).conversations.select("conv_id", "turn", "text")
    return responses.extract_blocks(responses.build_fixture_responses(c)).select(
        "conv_id", "turn", "kind", "extracted")


# ============================================================ N5 - N7, V2, V4, V5
def _log(spark, sf_dir) -> DataFrame:
    return fv.attempt_log_v(_t(spark, sf_dir))


ROLLUP_SQL = """
SELECT request_id, count(*) AS attempts_used, arg_max(outcome, attempt_number) AS final_outcome,
       string_agg(outcome, ',' ORDER BY attempt_number) AS outcomes, sum(duration_ms) AS total_duration_ms
FROM attempt_log_v GROUP BY request_id"""


@register("N5_attempt_rollup", with_views(ROLLUP_SQL))
def q_n5(spark, sf_dir):
    return attempts.attempt_rollup(_log(spark, sf_dir))


@register("N6_retry_stats", with_views("""
SELECT count(*) AS requests,
  ROUND(count(*) FILTER (WHERE attempts_used >= 2) / count(*), 6) AS needed_second,
  ROUND(count(*) FILTER (WHERE attempts_used >= 3) / count(*), 6) AS needed_third,
  ROUND(count(*) FILTER (WHERE final_outcome = 'unanswerable') / count(*), 6) AS refused_share,
  (SELECT min(total_duration_ms) FROM (SELECT total_duration_ms, cume_dist() OVER (ORDER BY total_duration_ms) AS cd
                                       FROM rollup) WHERE cd >= 0.5) AS p50_ms,
  (SELECT min(total_duration_ms) FROM (SELECT total_duration_ms, cume_dist() OVER (ORDER BY total_duration_ms) AS cd
                                       FROM rollup) WHERE cd >= 0.95) AS p95_ms
FROM rollup""", rollup=ROLLUP_SQL))
def q_n6(spark, sf_dir):
    return attempts.retry_stats(attempts.attempt_rollup(_log(spark, sf_dir)))


@register("N6_rejection_reasons", with_views("""
SELECT error_message AS reason, count(*) AS rejections FROM attempt_log_v
WHERE outcome = 'guard_rejected' GROUP BY error_message"""))
def q_n6b(spark, sf_dir):
    return attempts.rejection_reasons(_log(spark, sf_dir))


@register("N7_failure_narrative", with_views(f"""
SELECT request_id,
  'I could not answer this question after ' || count(*) || ' attempt(s). '
  || string_agg('Attempt ' || attempt_number || ' '
       || CASE outcome WHEN 'guard_rejected' THEN 'was rejected by the SQL safety guard'
                       WHEN 'execution_error' THEN 'failed during execution'
                       WHEN 'empty_result' THEN 'ran successfully but returned no rows' ELSE outcome END
       || CASE WHEN error_message IS NOT NULL AND error_message <> '' THEN ' (' || error_message || ')' ELSE '' END
       || '.', ' ' ORDER BY attempt_number)
  || ' {attempts.NARRATIVE_CLOSING}' AS answer
FROM attempt_log_v GROUP BY request_id
HAVING arg_max(outcome, attempt_number) <> 'success'"""))
def q_n7(spark, sf_dir):
    return attempts.failure_narrative(_log(spark, sf_dir))


SCOREBOARD_SQL = """
SELECT split, count(*) AS items, count(*) FILTER (WHERE passed) AS passed,
       ROUND(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM (SELECT i.request_id, i.split, COALESCE(v.final_outcome = 'success', false) AS passed
      FROM (SELECT DISTINCT request_id, split FROM attempt_log_v) i
      LEFT JOIN (SELECT request_id, arg_max(outcome, attempt_number) AS final_outcome
                 FROM attempt_log_v GROUP BY request_id) v USING (request_id)) x
GROUP BY split"""


def _board(spark, sf_dir):
    log = _log(spark, sf_dir)
    items = log.select(F.col("request_id").alias("item_id"), "split").distinct()
    roll = attempts.attempt_rollup(log)
    verdict = roll.select(F.col("request_id").alias("item_id"), (F.col("final_outcome") == "success").alias("passed"))
    return items, verdict


@register("V4_scoreboard", with_views(SCOREBOARD_SQL))
def q_v4(spark, sf_dir):
    items, verdict = _board(spark, sf_dir)
    return evaluate.scoreboard(items, verdict)


@register("V5_gate", with_views(f"""
SELECT h.accuracy AS gated_accuracy, h.items AS gated_items, h.items - h.passed AS gated_misses,
       (SELECT max(accuracy) FROM board WHERE split <> 'holdout') AS reported_accuracy,
       0.85 AS floor, h.accuracy >= 0.85 AS gate_passed
FROM board h WHERE split = 'holdout'""", board=SCOREBOARD_SQL))
def q_v5(spark, sf_dir):
    items, verdict = _board(spark, sf_dir)
    return evaluate.gate(evaluate.scoreboard(items, verdict))


@register("V2_table_diff", with_views("""
SELECT COALESCE(e.request_id, a.request_id) AS request_id,
  CASE WHEN a.request_id IS NULL THEN 'missing' WHEN e.request_id IS NULL THEN 'extra' ELSE 'different' END AS status,
  concat_ws(',', CASE WHEN e.request_id IS NOT NULL AND a.request_id IS NOT NULL
                       AND NOT (abs(e.total_duration_ms - a.total_duration_ms)
                                <= 0.01 * greatest(abs(e.total_duration_ms), abs(a.total_duration_ms)))
                      THEN 'total_duration_ms' END,
                 CASE WHEN e.request_id IS NOT NULL AND a.request_id IS NOT NULL
                       AND e.final_outcome IS DISTINCT FROM a.final_outcome THEN 'final_outcome' END) AS columns
FROM rollup e FULL OUTER JOIN (
  SELECT request_id, final_outcome,
         CASE WHEN split = 'holdout' THEN total_duration_ms * 1.02 ELSE total_duration_ms END AS total_duration_ms
  FROM rollup JOIN (SELECT DISTINCT request_id, split FROM attempt_log_v) s USING (request_id)
  WHERE attempts_used < 3) a ON a.request_id = e.request_id
WHERE a.request_id IS NULL OR e.request_id IS NULL
   OR NOT (abs(e.total_duration_ms - a.total_duration_ms)
           <= 0.01 * greatest(abs(e.total_duration_ms), abs(a.total_duration_ms)))
   OR e.final_outcome IS DISTINCT FROM a.final_outcome""", rollup=ROLLUP_SQL))
def q_v2(spark, sf_dir):
    log = _log(spark, sf_dir)
    roll = attempts.attempt_rollup(log)
    splits = log.select("request_id", "split").distinct()
    actual = (roll.join(splits, "request_id").where(F.col("attempts_used") < 3)
              .select("request_id", "final_outcome",
                      F.when(F.col("split") == "holdout", F.col("total_duration_ms") * F.lit(1.02))
                      .otherwise(F.col("total_duration_ms").cast("double")).alias("total_duration_ms")))
    expected = roll.select("request_id", "final_outcome", F.col("total_duration_ms").cast("double"))
    return evaluate.table_diff(expected, actual, ["request_id"], ["total_duration_ms", "final_outcome"])


# ============================================================ T1b, T2 (batch twins)
@register("T1b_hits_in_window", """
SELECT event_id, user_id, ts,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS hits
FROM events""")
def q_t1b(spark, sf_dir):
    from ledgerframe.streaming import admission
    e = _t(spark, sf_dir).events.select("event_id", "user_id", "ts")
    return admission.hits_in_window(e, key="user_id", ts="ts", window_seconds=86400)


@register("T2_tumbling_rollup", with_views("""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       count(*) AS attempts, count(*) FILTER (WHERE outcome = 'success') AS successes,
       ROUND(avg(duration_ms), 6) AS avg_duration_ms
FROM attempt_log_v GROUP BY ALL"""))
def q_t2(spark, sf_dir):
    return attempts.windowed_rollup(_log(spark, sf_dir), "1 hour")


@register("T2_sliding_rollup", with_views("""
SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, count(*) AS attempts,
       count(*) FILTER (WHERE outcome = 'success') AS successes, ROUND(avg(duration_ms), 6) AS avg_duration_ms
FROM (SELECT date_trunc('hour', ts) AS window_start, outcome, duration_ms FROM attempt_log_v
      UNION ALL
      SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, outcome, duration_ms FROM attempt_log_v) w
GROUP BY window_start"""))
def q_t2s(spark, sf_dir):
    return attempts.windowed_rollup(_log(spark, sf_dir), "2 hours", "1 hour")


@register("T1_admission", """
WITH RECURSIVE e AS (
  SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT event_id, user_id, ts, n, TRUE AS admitted, [ts] AS held FROM e WHERE n = 1
  UNION ALL
  SELECT event_id, user_id, ts, n, len(held) < 3,
         CASE WHEN len(held) < 3 THEN list_append(held, ts) ELSE held END
  FROM (SELECT e.event_id, e.user_id, e.ts, e.n,
               list_filter(r.held, lambda h: h >= e.ts - INTERVAL 1 DAY) AS held
        FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) s)
SELECT event_id, user_id AS key, ts, admitted FROM r""")
def q_t1(spark, sf_dir):
    """Batch twin of the sliding-window admission stream: limit 3 per user per 1-day window
    (FIXTURES.md §3). The oracle replays the hits one by one."""
    from ledgerframe.streaming import admission
    e = _t(spark, sf_dir).events.select("event_id", "user_id", "ts")
    return admission.admission_batch(e, key="user_id", ts="ts", limit=3, window_seconds=86400)


@register("T2_session_rollup", """
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
       count(*) AS attempts, count(*) FILTER (WHERE event_type = 'purchase') AS successes
FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) e) s
GROUP BY user_id, sid""")
def q_t2sess(spark, sf_dir):
    from ledgerframe.streaming import attempt_windows
    ev = _t(spark, sf_dir).events
    return attempt_windows.session_rollup(attempt_windows.events_as_attempts(ev), "30 minutes", watermark=None)
