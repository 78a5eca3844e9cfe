"""Retrieval over vectors: embedding (R1), exact cosine top-k (R2), top-k through a stored
index (R3, :mod:`ledgerframe.operators.vector_index`) and context packs (R4).

Exact top-k is inherently "every query against every document". No (query, document) pair
becomes a row: queries and documents are dealt into blocks of bounded size, each pair of blocks
is scored in one task with matrix products, and only a running top-k per query leaves it. A
per-query ``row_number`` merges at most k rows per query and block (Spark adds a partial
WindowGroupLimit before the shuffle).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe import domain

# Rows of a block of queries and of documents: one pair of blocks is one group.
QUERY_BLOCK_ROWS, DOC_BLOCK_ROWS = 1024, 8192

TOPK_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("similarity", T.DoubleType()),
])

RANKED_SCHEMA = T.StructType([*TOPK_SCHEMA.fields, T.StructField("rank", T.IntegerType())])
# Documents scored at a time: bounds the score block to queries x this many rows.
SCORE_ROWS = 512


# ------------------------------------------------------------------ R1
def _hashing_encoder(df: DataFrame, text_col: str, dim: int) -> DataFrame:
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern="\\W+", toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim)
    norm = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0)
    out = norm.transform(tf.transform(tok.transform(df)))
    return out.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_unit")


def embed_documents(df: DataFrame, text_col: str = "text", dim: int = 64,
                    encoder: Callable[[list[str]], np.ndarray] | None = None,
                    batch_size: int = 128) -> DataFrame:
    """Add ``embedding ARRAY<FLOAT>`` computed from ``text_col``.

    Default encoder: lexical hashing (RegexTokenizer -> HashingTF -> L2
    Normalizer), all JVM-side; it is not equal in quality to a hosted neural
    model. A custom ``encoder`` maps a list of texts to an (n, dim) array and
    runs in an iterator pandas UDF, ``batch_size`` texts per call; Spark checks
    that every batch returns as many rows as it received."""
    if encoder is None:
        return _hashing_encoder(df, text_col, dim)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = []
            for i in range(0, len(texts), batch_size):
                chunk = texts.iloc[i:i + batch_size].fillna("").tolist()
                vecs = np.asarray(encoder(chunk), dtype=np.float32)
                if vecs.shape[0] != len(chunk):
                    raise ValueError(f"encoder returned {vecs.shape[0]} vectors for {len(chunk)} texts")
                parts.extend(list(vecs))
            yield pd.Series(parts, index=texts.index)

    return df.withColumn("embedding", encode(F.col(text_col)))


# ------------------------------------------------------------------ R2
def usable(df: DataFrame, key: str, name: str, vec: str) -> DataFrame:
    """``(name, vec, dim)`` of the rows whose vector has a cosine with something."""
    return df.select(F.col(key).cast("long").alias(name), F.col(vec).cast("array<double>").alias("vec")).where(
        "vec is not null and exists(vec, x -> x <> 0) and "
        "forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    ).withColumn("dim", F.size("vec"))


def unit_rows(vectors: list) -> np.ndarray:
    """The vectors at length 1; scaled first, for the squares of very large or small numbers."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _local_topk(k: int, but_own: bool):
    """One block of queries against one block of documents: at most k rows per query leave."""
    def run(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "doc_id", "similarity"]
        if not len(queries) or not len(docs):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "doc_id": pd.Series(dtype="int64"),
                                 "similarity": pd.Series(dtype="float64")})
        q = unit_rows(queries["vec"].tolist())
        docs = docs.sort_values("doc_id")
        dids, qids = docs["doc_id"].to_numpy(), queries["query_id"].to_numpy()
        best_sim, best_id = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)
        for at in range(0, len(docs), SCORE_ROWS):
            d = unit_rows(docs["vec"].iloc[at:at + SCORE_ROWS].tolist())
            sim = q @ d.T
            if but_own:  # before the cut to k: an id may repeat
                sim[qids[:, None] == dids[at:at + SCORE_ROWS]] = -np.inf
            sim = np.hstack([best_sim, sim])
            ids = np.hstack([best_id, np.broadcast_to(dids[at:at + SCORE_ROWS], (len(q), len(d)))])
            top = np.argsort(-sim, axis=1, kind="stable")[:, :k]  # ids rise, so ties keep the smaller
            best_sim, best_id = np.take_along_axis(sim, top, 1), np.take_along_axis(ids, top, 1)
        found = best_sim > -np.inf
        return pd.DataFrame(dict(zip(names, (np.repeat(qids, found.sum(axis=1)), best_id[found], best_sim[found]))))
    return run


def topk_cosine(queries: DataFrame, docs: DataFrame, k: int = domain.RETRIEVAL_TOP_K,
                query_id: str = "query_id", doc_id: str = "doc_id", vec: str = "embedding",
                query_rows: int = QUERY_BLOCK_ROWS, doc_rows: int = DOC_BLOCK_ROWS,
                but_own: bool = False) -> DataFrame:
    """R2: exact top-k by cosine similarity (= 1 - cosine distance) per query:
    (query_id, doc_id, similarity, rank), similarity descending, doc id ascending on
    ties. NULL, empty and zero vectors and vectors with NULL or non-finite components
    have no similarity and are excluded; vectors of different lengths never meet.

    Queries and documents are dealt into blocks of bounded size by hash; each pair of
    blocks meets in one task and returns k rows per query. Only block counts per vector
    length reach the plan, as a join; nothing passes through the driver. ``but_own`` leaves out
    documents with the query's own id (queries that are documents themselves) and rows without an id."""
    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    q, d = usable(queries, query_id, "query_id", vec), usable(docs, doc_id, "doc_id", vec)
    if but_own:
        q, d = q.where("query_id is not null"), d.where("doc_id is not null")
    sizes = blocks(q, query_rows, "q_blocks").join(blocks(d, doc_rows, "d_blocks"), "dim")

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.col(own).cast("long")).cast("int").alias(own[0])
        return df.join(sizes, "dim").select(
            "dim", key, "vec", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0]))

    keys = ["dim", "q", "d"]
    cand = dealt(q, "query_id", "q_blocks", "d_blocks").groupBy(*keys).cogroup(
        dealt(d, "doc_id", "d_blocks", "q_blocks").groupBy(*keys)).applyInPandas(_local_topk(k, but_own), TOPK_SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("doc_id").asc())
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ------------------------------------------------------------------ R3
def recall_report(exact: DataFrame, approx: DataFrame, candidates: DataFrame, queries: DataFrame,
                  docs: DataFrame) -> DataFrame:
    """R3 report: recall@k (share of the exact top-k pairs that the index also returns) and
    candidate share (pairs scored with whole vectors / all pairs)."""
    e = exact.select("query_id", "doc_id")
    hit = e.join(approx.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    n_exact = e.agg(F.count("*")).scalar()
    n_hit = hit.agg(F.count("*")).scalar()
    n_cand = candidates.agg(F.count("*")).scalar()
    n_pairs = queries.agg(F.count("*")).scalar() * docs.agg(F.count("*")).scalar()
    return e.sparkSession.range(1).select(
        n_exact.alias("exact_pairs"), n_hit.alias("found_pairs"),
        F.round(n_hit / n_exact, 6).alias("recall_at_k"),
        F.round(n_cand / n_pairs, 6).alias("candidate_share"))


# ------------------------------------------------------------------ R4
def context_pack(topk: DataFrame, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per query, the top-k documents rendered ``[doc_type] title\\ncontent``
    in rank order, separated by a blank line. ``docs`` has (doc_id, doc_type,
    title, content); the group per query is at most k rows."""
    d = docs.select(F.col(doc_id).alias("doc_id"), "doc_type", "title", "content")
    text = F.format_string("[%s] %s\n%s", "doc_type", "title", "content")
    j = topk.join(d, "doc_id").select("query_id", F.struct("rank", text.alias("t")).alias("r"))
    packed = j.groupBy("query_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return packed.select("query_id", F.array_join(F.transform("rs", lambda r: r["t"]), "\n\n").alias("context"))
