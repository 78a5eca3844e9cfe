"""Exact top-k inner products by best-first search in M-trees (operator 10).

Vectors become integers ``floor(scale * x)``. Inner products turn into distances by one
more coordinate: with ``R`` the largest squared length of a tree's vectors,
``x' = (x, sqrt(R - |x|^2))`` and ``q' = (q, 0)`` give
``|q' - x'|^2 = |q|^2 + R - 2 q.x``, a metric whose nearest vectors are the highest
scores. Every candidate block of bounded size is an M-tree: leaf pages hold vectors
and their distance to the page's pivot, inner pages hold pages with covering radii and
distances to *their* parent. A search takes pages from a queue by the least distance
they can hold, and skips a page, before computing any distance to its pivot, when the
stored parent distance already rules it out, and vectors of a leaf likewise. Distances
only steer (with slack for float rounding); scores are exact integers.

Equal vectors are one entry with the smallest ids (never more than a query can
return), so a vector that a third of all rows share is one entry. Queries meet blocks
in a join by block, not with each other: first each query searches one block, whose
k-th score is a floor for the others, which then return only what reaches the floor.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored

BLOCK_ROWS = 4096
QUERY_ROWS = 512
PAGE = 48
SLACK = 1e-6
LONG = 2 ** 63 - 1


class Node:
    """A page: its entries are children (nodes) or rows of vectors."""

    __slots__ = ("pivot", "radius", "to_parent", "children", "rows", "row_distance")

    def __init__(self, pivot: np.ndarray):
        self.pivot, self.radius, self.to_parent = pivot, 0.0, 0.0
        self.children: list[Node] = []
        self.rows = self.row_distance = None


class MTree:
    """Bulk-loaded M-tree over integer vectors (rows of ``x``)."""

    def __init__(self, x: np.ndarray, page: int = PAGE):
        self.x, self.page = x, page
        # Integers far beyond float range of exactness only widen the steering slack.
        squared = (x.astype(np.float64) ** 2).sum(axis=1)
        self.largest = float(squared.max()) if len(x) else 0.0
        self.lifted = np.column_stack([x.astype(np.float64),
                                       np.sqrt(np.maximum(self.largest - squared, 0))])
        self.root = self._load(np.arange(len(x))) if len(x) else None

    def _far(self, rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self.lifted[rows] - pivot, axis=1)

    def _load(self, rows: np.ndarray) -> Node:
        far = self._far(rows, self.lifted[rows].mean(axis=0))
        node = Node(self.lifted[rows[np.argmin(far)]])
        far = self._far(rows, node.pivot)
        node.radius = float(far.max())
        if len(rows) <= self.page or node.radius == 0:
            order = np.argsort(far, kind="stable")
            node.rows, node.row_distance = rows[order], far[order]
            return node
        # Far-apart seeds, each the farthest from those before; rows go to the nearest.
        ways = min(self.page, max(2, -(-len(rows) // self.page)), 16)
        seed = rows[np.argmax(far)]
        nearest, owner = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        for k in range(ways):
            away = self._far(rows, self.lifted[seed])
            closer = away < nearest
            nearest[closer], owner[closer] = away[closer], k
            seed = rows[np.argmax(nearest)]
        for k in np.unique(owner):
            child = self._load(rows[owner == k])
            child.to_parent = float(np.linalg.norm(child.pivot - node.pivot))
            node.children.append(child)
        return node

    def search(self, q: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and integer scores that hold the ``k`` highest scores, ties of the last one
        included, and none below ``floor``; unordered."""
        if self.root is None or k < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        point = np.append(q.astype(np.float64), 0.0)
        own = float(point @ point)
        slack = SLACK * (1 + np.sqrt(own) + np.sqrt(self.largest))

        def reach(score: float | None) -> float:
            """The distance within which vectors of at least this score lie."""
            if score is None:
                return np.inf
            return np.sqrt(max(own + self.largest - 2.0 * score, 0)) + slack

        best: list[int] = []  # the k highest scores so far
        limit = reach(floor)
        rows, scores = [], []
        top = float(np.linalg.norm(point - self.root.pivot))
        queue, tick = [(max(top - self.root.radius, 0.0), 0, top, self.root)], 1
        while queue:
            least, _, away, node = heapq.heappop(queue)
            if least > limit:
                break
            if node.rows is None:
                for child in node.children:
                    if abs(away - child.to_parent) - child.radius > limit:
                        continue  # ruled out by the stored parent distance
                    far = float(np.linalg.norm(point - child.pivot))
                    if far - child.radius <= limit:
                        heapq.heappush(queue, (max(far - child.radius, 0.0), tick, far, child))
                        tick += 1
                continue
            at = node.rows[np.abs(away - node.row_distance) <= limit]
            if not len(at):
                continue
            got = self.x[at] @ q
            if floor is not None:
                at, got = at[got >= floor], got[got >= floor]
            rows.append(at)
            scores.append(got)
            for s in np.sort(got)[::-1][:k].tolist():
                if len(best) < k:
                    heapq.heappush(best, s)
                elif s > best[0]:
                    heapq.heapreplace(best, s)
                else:
                    break
            if len(best) == k:
                limit = min(limit, reach(best[0]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, got = np.concatenate(rows), np.concatenate(scores)
        if len(best) == k:
            at, got = at[got >= best[0]], got[got >= best[0]]
        return at, got


def usable_vectors(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id",
                   vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x array<double>, small)`` of rows that take part: a vector that is not null or empty, without
    null or non-finite components, and a known id. The inner product of two ``small`` ones fits a long."""
    x = F.col(vector_col).cast("array<double>")
    finite = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(
        "vec_id is not null and size(x) > 0 and "
        "forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    bound = F.sqrt(F.lit(2.0 ** 62) / F.size("x")) - 1
    return finite.withColumn("small", F.forall("x", lambda c: F.abs(c) * scale < bound))


def integer_vectors(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v array<long>)`` of the small ones of :func:`usable_vectors`."""
    return usable_vectors(vectors, scale, id_col, vector_col).where("small").select(
        "vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def whole(x: float, scale: int) -> int:
    """``floor(scale * x)``, also beyond the range of doubles."""
    scaled = x * scale
    return math.floor(scaled) if math.isfinite(scaled) else int(x) * scale


def order_of(score: int) -> str:
    """A text that rises with the integer, of any size."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def _order_column(score: Column) -> Column:
    """:func:`order_of` of a long."""
    digits = F.regexp_replace(score.cast("string"), "-", "")
    n = F.length(digits)
    return F.when(score >= 0, F.concat(F.lit("1"), F.lpad(n.cast("string"), 5, "0"), digits)).otherwise(F.concat(
        F.lit("0"), F.lpad((F.lit(99999) - n).cast("string"), 5, "0"), F.translate(digits, "0123456789", "9876543210")))


def _exact(k: int, scale: int):
    """A block of queries against a block of vectors with integers of any size; ``score`` is cut to a long."""
    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(block):
            block = block.sort_values("vec_id", kind="stable")
            ids, raw = block["vec_id"].tolist(), [tuple(x) for x in block["x"]]
            rows = np.array([[whole(c, scale) for c in x] for x in raw], object)
            for query, x in zip(queries["query_id"].tolist(), queries["x"]):
                scores = (rows @ np.array([whole(c, scale) for c in x], object)).tolist()
                own = next((n for n, i in enumerate(ids) if i == query and raw[n] == tuple(x)), None)
                pairs = heapq.nsmallest(k, ((-s, i) for n, (s, i) in enumerate(zip(scores, ids)) if n != own))
                found += [(query, i, max(min(-s, LONG), -LONG - 1), order_of(-s)) for s, i in pairs]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score", "place"])

    return search


def _all_against(queries: DataFrame, rows: DataFrame, k: int, scale: int) -> DataFrame:
    """``queries(query_id, x)`` against all ``rows(vec_id, x)`` of their length, in blocks of bounded size; rows of
    an id are in one block."""
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(F.size("x").alias("dim")).agg(F.ceil(F.count("*") / size).alias(name))

    sizes = blocks(queries, QUERY_ROWS, "qs").join(blocks(rows, BLOCK_ROWS, "ds"), "dim")

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return df.withColumn("dim", F.size("x")).join(sizes, "dim").select(
            F.col("dim").alias("dim"), F.col(key).alias(key), F.col("x").alias("x"),  # both sides may be one table
            F.pmod(F.xxhash64(key), F.col(own)).alias(own[0]),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other[0]))

    keys = ["dim", "q", "d"]
    return dealt(queries, "query_id", "qs", "ds").groupBy(*keys).cogroup(
        dealt(rows, "vec_id", "ds", "qs").groupBy(*keys)).applyInPandas(
        _exact(k, scale), "query_id long, vec_id long, score long, place string")


def _matrix(lists: pd.Series) -> np.ndarray:
    return np.array(lists.tolist(), np.int64)


def _others(ids: list[int], query: int, entry: np.ndarray, point: np.ndarray) -> list[int]:
    """The rows of an entry but the query's own one."""
    if query in ids and np.array_equal(entry, point):
        at = list(ids).index(query)
        return [*ids[:at], *ids[at + 1:]]
    return ids


def _search(k: int):
    out = ["query_id", "vec_id", "score"]

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        """The queries sent to a block against its tree."""
        if not len(queries) or not len(block):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in out})
        tree, ids = MTree(_matrix(block["v"])), block["ids"].tolist()
        found = []
        points = _matrix(queries["v"])
        for query, point, floor in zip(queries["query_id"], points, queries["floor"]):
            # One more than k, as the query's own row may be among them.
            rows, scores = tree.search(point, k + 1, None if pd.isna(floor) else int(floor))
            pairs = heapq.nsmallest(k, ((-s, i) for r, s in zip(rows.tolist(), scores.tolist())
                                        for i in _others(ids[r], query, tree.x[r], point)))
            found += [(query, i, -s) for s, i in pairs]
        return pd.DataFrame(found, columns=out)

    return search


def top_k(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, scale: int = 1024,
          block_rows: int = BLOCK_ROWS, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest scores of each query among all
    other rows, ties to the smaller id; fewer if there are fewer candidates.

    Rows that :func:`usable_vectors` leaves out take no part. Vectors meet queries of their own length
    only. Vectors with components so large that an inner product might not fit a long are scored
    exactly all the same, by integers of any size against all rows in blocks; such a score is ranked as
    it is and returned cut to the range of a long. A repeated row is a candidate each time, and its query is
    asked once; an id with several vectors is a candidate with each, and its queries' results are
    mixed; a query never meets its own row. Other columns are not read."""
    every = stored(usable_vectors(vectors, scale, id_col, vector_col), "mtree-vectors")
    given = every.where("small").select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    # Equal vectors are one entry: the k + 1 smallest ids can be asked for, no more.
    nth = Window.partitionBy("v").orderBy("vec_id")
    entries = stored(given.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= k + 1)
                     .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "mtree-entries")
    sizes = entries.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).select(
        "dim", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    sizes = stored(sizes, "mtree-sizes")
    blocks = stored(entries.join(sizes, F.size("v") == F.col("dim")).withColumn(
        "block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).drop("blocks"), "mtree-blocks")
    queries = stored(given.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct()
                     .join(sizes, F.size("v") == F.col("dim")), "mtree-queries")

    schema = "query_id long, vec_id long, score long"

    def against(sent: DataFrame) -> DataFrame:
        """Queries with a block and a floor, in groups of bounded size, against the blocks."""
        parts = stored(sent.groupBy("dim", "block").agg(
            F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts")), "mtree-parts")
        grouped = sent.join(parts, ["dim", "block"]).withColumn(
            "part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        trees = blocks.join(parts, ["dim", "block"]).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["dim", "block", "part"]
        return grouped.select(*keys, "query_id", "v", "floor").groupBy(*keys).cogroup(
            trees.select(*keys, "v", "ids").groupBy(*keys)).applyInPandas(_search(k), schema)

    home = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    first = stored(against(queries.select(
        "dim", home.alias("block"), "query_id", "v", F.lit(None).cast("long").alias("floor"))), "mtree-home")
    floors = first.groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    rest = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(
        F.col("block") != home).join(floors, "query_id", "left").select(
        "dim", "block", "query_id", "v", F.col("least").alias("floor"))
    both = first.unionByName(against(rest)).withColumn("place", _order_column(F.col("score")))
    large = every.where("not small")
    if not large.isEmpty():
        asking = every.where(is_query).select(F.col("vec_id").alias("query_id"), "x", "small").distinct()
        exact = _all_against(asking.select("query_id", "x"), large.select("vec_id", "x"), k, scale).unionByName(
            _all_against(asking.where("not small").select("query_id", "x"), every.where("small").select("vec_id", "x"), k, scale))
        both = both.unionByName(exact)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    return both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
