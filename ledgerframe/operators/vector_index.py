"""A stored vector index for cosine top-k (R3): quantised residuals in cells.

Cells are k-means centres of unit vectors, fitted on a bounded sample; their number grows
with the square root of the rows up to a bound. Every vector lies in the cell of its nearest
centre as a residual of 8-bit codes with a scale and the exact norm of what the codes miss.
A query's similarity to a vector is therefore known to within that norm without the vector.
A cell is stored as tiles of bounded size, so a cell with a third of all rows is many tiles.

A search scores the tiles of a query's nearest cells by their codes and keeps, tile by tile, the
vectors whose similarity can be as high as the k-th best lower bound; the bound over all
tiles cuts them again, and the survivors, a few more than k, are scored with their whole vectors.
Within the probed cells the result is exact; which cells are probed decides the recall.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerframe.operators.retrieval import unit_rows, usable
from ledgerframe.sources.store import materialized

#: Vectors that the centres are fitted on, and most centres (their table goes to every task).
SAMPLE_ROWS, MAX_CELLS = 50_000, 4096
#: Vectors of a tile and queries that meet it together.
TILE_ROWS, QUERY_ROWS = 4096, 1024
#: The share of the cells that a query probes.
PROBE_SHARE = 0.7
#: Beyond the rounding of sums in double precision.
SLACK = 1e-9
TILES = "cell int, part int, ids binary, codes binary, scales binary, misses binary"


def _unit(vec: str) -> Column:
    """As :func:`~ledgerframe.operators.retrieval.unit_rows`, as a column."""
    top = F.array_max(F.transform(vec, F.abs))
    near = F.transform(vec, lambda x: x / top)
    # The scaled vector and its norm are bound to variables, so that they are made once.
    def over(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y * y))
        return F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x / n)), F.lit(0))

    return F.get(F.transform(F.array(near), over), F.lit(0))


def fit_centres(vectors: DataFrame, rows: int, seed: int = 7, max_iter: int = 20) -> np.ndarray:
    """Centres of unit vectors from a sample of at most about ``SAMPLE_ROWS`` of them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    some = vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    units = some.select(array_to_vector(_unit("vec")).alias("features"))
    cells = int(min(MAX_CELLS, np.ceil(np.sqrt(rows))))
    return np.array(KMeans(k=max(2, cells), seed=seed, maxIter=max_iter).fit(units).clusterCenters())


def quantise(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(cell, codes, scale, miss)`` of each unit vector; ``miss`` is at least the norm of the
    difference between the vector and what its centre and codes give."""
    cell = np.argmin((centres ** 2).sum(axis=1) - 2 * units @ centres.T, axis=1)
    rest = units - centres[cell]
    scale = (np.abs(rest).max(axis=1) / 127).astype(np.float32)
    safe = np.where(scale > 0, scale, 1).astype(np.float64)
    codes = np.clip(np.rint(rest / safe[:, None]), -127, 127).astype(np.int8)
    miss = np.linalg.norm(rest - codes * scale.astype(np.float64)[:, None], axis=1)
    return cell, codes, scale, np.nextafter(miss.astype(np.float32), np.float32(np.inf))


def _tiles(vectors: DataFrame, centres: np.ndarray, tile_rows: int) -> DataFrame:
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, codes, scale, miss = quantise(unit_rows(pdf["vec"].tolist()), centres)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "cell": cell.astype(np.int32),
                                    "codes": [c.tobytes() for c in codes], "scale": scale, "miss": miss})

    coded = vectors.select("doc_id", "vec").mapInPandas(
        code, "doc_id long, cell int, codes binary, scale float, miss float")
    # A row per cell, MAX_CELLS at most.
    parts = coded.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).alias("parts"))
    dealt = coded.join(F.broadcast(parts), "cell").withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        return pd.DataFrame([{"cell": pdf["cell"].iloc[0], "part": pdf["part"].iloc[0],
                              "ids": pdf["doc_id"].to_numpy().astype("<i8").tobytes(), "codes": b"".join(pdf["codes"]),
                              "scales": pdf["scale"].to_numpy().astype("<f4").tobytes(),
                              "misses": pdf["miss"].to_numpy().astype("<f4").tobytes()}])

    return dealt.groupBy("cell", "part").applyInPandas(pack, TILES)


@dataclass
class VectorIndex:
    """``centres`` (a bounded table), ``tiles`` and the whole ``vectors`` (doc_id, vec, dim) of one
    length; vectors of other lengths have no similarity with these and are not in it."""

    centres: np.ndarray
    tiles: DataFrame
    vectors: DataFrame

    def survivors(self, queries: DataFrame, k: int, query_id: str = "query_id", vec: str = "embedding",
                  probe_share: float = PROBE_SHARE, but_own: bool = False) -> DataFrame:
        """``(query_id, doc_id)`` whose similarity the codes cannot keep out of the top ``k``."""
        centres, top = self.centres, k + but_own
        cells, dim = centres.shape
        probes = max(1, int(np.ceil(cells * probe_share)))
        asked = usable(queries, query_id, "query_id", vec).where(F.col("dim") == dim)

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    units = unit_rows(pdf["vec"].tolist())
                    near = np.argsort(-(units @ centres.T), axis=1, kind="stable")[:, :probes]
                    yield pd.DataFrame({"query_id": pdf["query_id"], "unit": [u.tobytes() for u in units],
                                        "cells": list(near.astype(np.int32))})

        probed = asked.mapInPandas(probe, "query_id long, unit binary, cells array<int>")
        # Queries meet a tile in blocks of bounded size.
        blocks = asked.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / QUERY_ROWS)).cast("int").alias("blocks"))
        parts = self.tiles.groupBy("cell").agg((F.max("part") + 1).alias("parts"))
        met = probed.crossJoin(F.broadcast(blocks)).select(
            "query_id", "unit", F.explode("cells").alias("cell"),
            F.pmod(F.xxhash64("query_id"), F.col("blocks").cast("long")).cast("int").alias("block"))
        met = met.join(F.broadcast(parts), "cell").select(
            "*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        tiles = self.tiles.crossJoin(F.broadcast(blocks)).select(
            "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

        def score(asking: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asking) and len(tile):
                t = tile.iloc[0]
                ids = np.frombuffer(t["ids"], "<i8")
                codes = np.frombuffer(t["codes"], np.int8).reshape(len(ids), dim).astype(np.float64)
                misses = np.frombuffer(t["misses"], "<f4").astype(np.float64) + SLACK
                units = np.frombuffer(b"".join(asking["unit"]), np.float64).reshape(-1, dim)
                near = (units @ centres[t["cell"]])[:, None] + units @ codes.T * np.frombuffer(t["scales"], "<f4").astype(np.float64)
                low, high = near - misses, near + misses
                floor = np.sort(low, axis=1)[:, -top] if len(ids) >= top else np.full(len(units), -np.inf)
                q, d = np.nonzero(high >= floor[:, None])
                out = [asking["query_id"].to_numpy()[q], ids[d], low[q, d], high[q, d]]
            return pd.DataFrame(dict(zip(["query_id", "doc_id", "low", "high"], out or [[], [], [], []])))

        keys = ["cell", "part", "block"]
        scored = met.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInPandas(
            score, "query_id long, doc_id long, low double, high double")
        if but_own:
            scored = scored.where("query_id <> doc_id")
        best = Window.partitionBy("query_id").orderBy(F.col("low").desc())
        floor = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("query_id").agg(
            F.when(F.count("*") == k, F.min("low")).alias("floor"))
        return scored.join(floor, "query_id").where("floor is null or high >= floor").select("query_id", "doc_id")

    def top_k(self, queries: DataFrame, k: int, query_id: str = "query_id", vec: str = "embedding",
              probe_share: float = PROBE_SHARE, but_own: bool = False) -> DataFrame:
        """(query_id, doc_id, similarity, rank) as :func:`~ledgerframe.operators.retrieval.topk_cosine`, over
        the cells that each query probes."""
        asked = usable(queries, query_id, "query_id", vec).select("query_id", _unit("vec").alias("a"))
        found = self.survivors(queries, k, query_id, vec, probe_share, but_own)
        pairs = found.join(self.vectors.select("doc_id", _unit("vec").alias("b")), "doc_id").join(asked, "query_id")
        dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
        w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("doc_id").asc())
        return pairs.select("query_id", "doc_id", dot.alias("similarity")).withColumn(
            "rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stored_index(spark: SparkSession, name: str, docs: DataFrame, inputs: Sequence[str], doc_id: str = "doc_id",
                 vec: str = "embedding", tile_rows: int = TILE_ROWS) -> VectorIndex:
    """The index of ``docs`` in the shared folder, built on first use and again when ``inputs`` (the
    stored files that ``docs`` comes from) change. Every usable vector of the most frequent
    length is in it (ties: the shorter one)."""
    every = usable(docs, doc_id, "doc_id", vec)

    def of_length() -> DataFrame:
        most = every.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").first()
        return every.where(F.col("dim") == (most["dim"] if most else 0))

    vectors = materialized(spark, f"{name}-vectors", of_length, inputs)
    rows = vectors.count()
    if not rows:
        return VectorIndex(np.zeros((1, 1)), spark.createDataFrame([], TILES), vectors)

    def centres() -> DataFrame:
        fitted = fit_centres(vectors, rows)
        return spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(fitted)], "cell int, centre array<double>")

    table = materialized(spark, f"{name}-centres", centres, inputs).orderBy("cell").collect()
    found = np.array([r["centre"] for r in table])
    tiles = materialized(spark, f"{name}-tiles-{tile_rows}", lambda: _tiles(vectors, found, tile_rows), inputs)
    return VectorIndex(found, tiles, vectors)
