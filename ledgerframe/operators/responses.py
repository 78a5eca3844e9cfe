"""Extraction of the statement (or refusal) from model responses (N8), as
column expressions over a response log: every rule is a JVM regex, no UDF.

Precedence: a refusal line first; else a ```sql fenced block; else any fenced
block (a one-word language tag on its first line is dropped); else the text
from the first SELECT / WITH keyword; else no match. Regexes use Java's
UNIX_LINES mode (only \\n ends a line) and Unicode letter / digit classes so
they behave like the Python regexes they replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
REFUSAL_MARKER = "CANNOT_ANSWER:"
REFUSAL_RE = r"(?mdU)^\s*CANNOT_ANSWER:\s*(.+)$"
SQL_FENCE_RE = r"(?isU)```sql\s*(.+?)```"
ANY_FENCE_RE = r"(?sU)```\s*(.+?)```"
LANG_TAG_RE = r"[A-Za-z][\p{L}\p{N}_+-]*"
BARE_RE = r"(?isU)\b((?:select|with)\b.*)"
# --- end of fixed values ----------------------------------------------------


def strip_ws(c: Column) -> Column:
    """Python-style strip(): remove leading and trailing whitespace (not only spaces)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _found(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def extract_blocks(responses: DataFrame, text: str = "text") -> DataFrame:
    """Add ``kind`` (refusal | sql_fence | any_fence | bare | no_match) and
    ``extracted`` (the refusal reason or the statement text)."""
    t = F.coalesce(F.col(text), F.lit(""))
    refusal = strip_ws(F.regexp_extract(t, REFUSAL_RE, 1))
    sql_block = strip_ws(F.regexp_extract(t, SQL_FENCE_RE, 1))
    cand = strip_ws(F.regexp_extract(t, ANY_FENCE_RE, 1))
    has_nl = F.instr(cand, "\n") > 0
    first = strip_ws(F.substring_index(cand, "\n", 1))
    rest = strip_ws(F.expr("substr(_cand, instr(_cand, '\n') + 1)"))
    tag_line = has_nl & first.rlike(f"^{LANG_TAG_RE}$") & ~F.upper(first).isin("SELECT", "WITH")
    fenced = F.when(tag_line, rest).otherwise(cand)
    bare = strip_ws(F.regexp_extract(t, BARE_RE, 1))
    df = responses.withColumn("_cand", cand)
    kind = (F.when(_found(t, REFUSAL_RE), F.lit("refusal"))
            .when(_found(t, SQL_FENCE_RE), F.lit("sql_fence"))
            .when(_found(t, ANY_FENCE_RE) & (fenced != ""), F.lit("any_fence"))
            .when(_found(t, BARE_RE), F.lit("bare"))
            .otherwise(F.lit("no_match")))
    extracted = (F.when(kind == "refusal", refusal).when(kind == "sql_fence", sql_block)
                 .when(kind == "any_fence", fenced).when(kind == "bare", bare))
    return df.withColumn("kind", kind).withColumn("extracted", extracted).drop("_cand")


def build_fixture_responses(conversations: DataFrame) -> DataFrame:
    """Responses over the conversations table (FIXTURES.md §3, N8): by
    conv_id % 4, wrap the text in a ```sql fence, wrap it in a plain fence,
    prefix the refusal marker, or leave it as is."""
    t = F.col("text")
    m = F.col("conv_id") % 4
    resp = (F.when(m == 0, F.concat(F.lit("```sql\n"), t, F.lit("\n```")))
            .when(m == 1, F.concat(F.lit("```\n"), t, F.lit("\n```")))
            .when(m == 2, F.concat(F.lit(REFUSAL_MARKER + " "), t))
            .otherwise(t))
    return conversations.select("conv_id", "turn", resp.alias("text"))
