"""Embedding near-duplicates (operator 1): int8 tile products with error bounds.

Vectors with equal labels are compared in tiles. Inside a tile pair every vector
is scaled to unit length and quantised to int8 with a scale of its own; one
matrix product of the quantised tiles gives all approximate cosines, and the
norms of each vector's quantisation error bound how far any of them can be off
(with ``x = x^ + e``: ``|x.y - x^.y^| <= |e_x||y^| + |x^||e_y| + |e_x||e_y|``).
Only pairs that the bound leaves possible are computed again in double precision
from the stored components. Nothing is pruned by anything but that bound.

Tiles come from a hash of the vector, with as many tiles per label as its count
asks for, so a label with a third of all rows is many tiles like any others and
no task holds more than two tiles. Bit-equal vectors of a label are one vector
with a weight before that. A tile pair returns a weight sum per vector and the
edges of a spanning forest, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored
from ledgerframe.llm.components import components

TILE_ROWS = 1024
# Float rounding of the approximate path (exact integer products, double scales).
ROUNDING = 1e-9
_PACKED = "label string, tile int, tiles int, ids binary, weights binary, vectors binary, dim int"


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the decoded rows, norms of the row errors."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return (codes, scale, np.linalg.norm(decoded, axis=1),
            np.linalg.norm(unit - decoded, axis=1))


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float,
               same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(i, j)`` with cosine at least ``threshold``; ``i < j`` in one tile."""
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    code_x, scale_x, long_x, off_x = quantise(x / norm_x[:, None])
    code_y, scale_y, long_y, off_y = quantise(y / norm_y[:, None])
    # Products of int8 codes are exact in float32 while their sum stays below 2^24.
    kind = np.float32 if x.shape[1] * 127 * 127 < 2 ** 24 else np.float64
    near = (code_x.astype(kind) @ code_y.astype(kind).T) * scale_x[:, None] * scale_y[None, :]
    near += off_x[:, None] * (long_y + off_y)[None, :] + long_x[:, None] * off_y[None, :]
    i, j = np.nonzero(near >= threshold - ROUNDING)
    if same:
        i, j = i[i < j], j[i < j]
    kept = []
    for at in range(0, len(i), 1 << 16):  # bounded memory for the exact pass
        a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
        cosine = np.einsum("ij,ij->i", x[a], y[b]) / (norm_x[a] * norm_y[b])
        kept.append(cosine >= threshold)
    sure = np.concatenate(kept) if kept else np.zeros(0, bool)
    return i[sure], j[sure]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position that each of ``n`` positions reaches over the links."""
    low = np.arange(n)
    while len(i):
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if np.array_equal(before, low):
            break
    return low


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    """One row for the vectors of a tile."""
    vectors = np.array(group["vector"].tolist(), np.float64)
    # A power of two per row keeps norms in range and every cosine as it is.
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return pd.DataFrame([{
        "label": group["label"].iloc[0], "tile": group["tile"].iloc[0],
        "tiles": group["tiles"].iloc[0],
        "ids": group["rep"].to_numpy(np.int64).tobytes(),
        "weights": group["weight"].to_numpy(np.int64).tobytes(),
        "vectors": vectors.tobytes(), "dim": vectors.shape[1]}])


def _meet(threshold: float):
    def meet(group: pd.DataFrame) -> pd.DataFrame:
        """Weights and forest edges of one tile pair (one row if a tile meets itself)."""
        sides = group.drop_duplicates("tile").sort_values("tile")
        ids = [np.frombuffer(b, np.int64) for b in sides["ids"]]
        weights = [np.frombuffer(b, np.int64) for b in sides["weights"]]
        xs = [np.frombuffer(b, np.float64).reshape(-1, d)
              for b, d in zip(sides["vectors"], sides["dim"])]
        i, j = tile_links(xs[0], xs[-1], threshold, len(xs) == 1)
        if len(xs) == 2:
            j = j + len(ids[0])
        node, weight = np.concatenate(ids), np.concatenate(weights)
        linked = np.zeros(len(node), np.int64)
        np.add.at(linked, i, weight[j])
        np.add.at(linked, j, weight[i])
        low = _forest(len(node), i, j)
        got = np.flatnonzero(linked)
        return pd.DataFrame({"rep": node[got], "linked": linked[got], "root": node[low[got]]})

    return meet


def embedding_groups(vectors: DataFrame, threshold: float = 0.98, tile_rows: int = TILE_ROWS,
                     id_col: str = "vec_id", vector_col: str = "embedding",
                     label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Links join vectors of one label and one length with a cosine of at least
    ``threshold``. A row whose label or vector is null, whose vector is empty or
    zero, or holds a null or non-finite component links with nothing: zero links,
    its own component. Copies count as links of one another. A row with a null id
    links with nothing and has a null component. Rows that repeat an id are one
    node: each of them counts as a link of the others' partners, ``n_links`` is
    summed over the rows of the id. Other columns are not read.
    """
    given = stored(vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector")), "embedding-rows")
    usable = given.where(
        "vec_id is not null and label is not null and vector is not null and "
        "forall(vector, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) "
        "and exists(vector, c -> c <> 0)")
    classes = stored(
        usable.groupBy("label", "vector")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
        .withColumn("label", F.concat_ws("\x01", F.size("vector").cast("string"), "label")),
        "embedding-classes")
    sizes = classes.groupBy("label").agg(F.count("*").alias("n")).select(
        "label", F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles"))
    tiled = classes.join(sizes, "label").withColumn(
        "tile", F.pmod(F.xxhash64("rep", "weight"), F.col("tiles").cast("long")).cast("int"))
    packed = stored(tiled.groupBy("label", "tile").applyInPandas(_pack, _PACKED),
                    "embedding-tiles")
    pairs = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = stored(pairs.groupBy(
        "label", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")
    ).applyInPandas(_meet(threshold), "rep long, linked long, root long"), "embedding-met")
    # A vector's own copies link with it as well.
    partners = met.select("rep", "linked").unionByName(
        classes.where("weight > 1").select("rep", F.lit(0).cast("long").alias("linked")))
    linked = partners.groupBy("rep").agg(F.sum("linked").alias("linked"))

    members = usable.select(
        "vec_id", F.concat_ws("\x01", F.size("vector").cast("string"), "label").alias("label"),
        "vector").join(classes, ["label", "vector"]).select("vec_id", "rep", "weight")
    members = stored(members, "embedding-members")
    ties = members.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    found = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b"))
                       .unionByName(ties), "embedding")
    counted = stored(
        members.join(linked.hint("shuffle_merge"), "rep", "left")
        .groupBy("vec_id").agg(F.sum(F.coalesce("linked", F.lit(0)) + F.col("weight") - 1)
                               .alias("n_links")), "embedding-counted")
    return (given.select("vec_id").join(counted, "vec_id", "left")
            .join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"),
                    F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False))
                    .alias("kept")))
