"""SimHash near-duplicates (operator 5): 64-bit fingerprints, pigeonhole blocks,
Hamming verification, components.

Fingerprints are cut into ``distance + 2`` blocks. Two fingerprints that differ
in at most ``distance`` bits leave at least two blocks untouched, so they share
the key of one pair of blocks; a join on these keys finds every candidate and the
Hamming distance decides. Equal fingerprints are one class before any join.

A key that more than ``bucket_limit`` *different* fingerprints share (copies with
scattered edits of one long text) is not joined with itself: its fingerprints emit
every mask of ``ceil(distance / 2)`` or fewer flipped bits, and two fingerprints
meet under a common variant exactly if they differ in at most twice as many bits,
so for an even distance the variant itself proves the link. This is exact and
linear in the fingerprints; odd distances verify the pair like the blocks do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored, text_or_empty
from ledgerframe.llm.components import components

FINGERPRINT_BITS = 64
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer; no word gives zero."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    total = len(starts)
    ones = np.zeros(FINGERPRINT_BITS, np.int64)
    for at in range(0, total, 8192):  # bounded memory for very long texts
        hashes = np.fromiter(
            (digest(line[a:b], SEED) for a, b in zip(starts[at:at + 8192].tolist(),
                                                    ends[at:at + 8192].tolist())),
            np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, fp long)`` for every row; a null text counts as empty."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": prints.view(np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       text_or_empty(text_col).alias("text")
                       ).mapInPandas(score, "doc_id long, fp long")


def _blocks(distance: int) -> list[int]:
    """Masks of every pair of ``distance + 2`` nearly equal blocks."""
    count = distance + 2
    edges = [FINGERPRINT_BITS * i // count for i in range(count + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [p | q for p, q in combinations(parts, 2)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(classes: DataFrame, distance: int = 2, bucket_limit: int = 64) -> DataFrame:
    """Links ``(a, b)`` between representatives ``rep`` of ``classes(fp, rep)``
    whose different fingerprints lie within ``distance`` bits. Links inside a
    crowded bucket may be given by way of a common member of their component."""
    masks = _blocks(distance)
    keyed = classes.select(
        "fp", "rep",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks]))
        .alias("block", "key"))
    sizes = stored(keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1"),
                   "simhash-buckets")
    near = keyed.join(sizes.where(F.col("n") <= bucket_limit).select("block", "key"),
                      ["block", "key"])
    left = near.select("block", "key", F.col("fp").alias("fp_a"), F.col("rep").alias("a"))
    right = near.select("block", "key", F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
    apart = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))
    found = left.join(right, ["block", "key"]).where(
        (F.col("fp_a") < F.col("fp_b")) & (apart <= distance)).select("a", "b")

    crowded = keyed.join(sizes.where(F.col("n") > bucket_limit).select("block", "key"),
                         ["block", "key"], "left_semi").select("fp", "rep").distinct()
    radius = (distance + 1) // 2
    flips = [sum(1 << i for i in bits) for size in range(radius + 1)
             for bits in combinations(range(FINGERPRINT_BITS), size)]
    variants = crowded.select(
        "fp", "rep",
        F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(m))) for m in flips]))
        .alias("variant"))
    # A variant has at most len(flips) different fingerprints around it.
    met = variants.groupBy("variant").agg(
        F.collect_list(F.struct("fp", "rep")).alias("around")).where(F.size("around") > 1)
    if distance % 2 == 0:
        hubs = met.select(F.array_min("around").alias("hub"), F.explode("around").alias("other"))
        via = hubs.select(F.col("hub.rep").alias("a"), F.col("other.rep").alias("b"))
    else:
        pairs = met.select(F.explode("around").alias("x"), "around").select(
            "x", F.explode("around").alias("y"))
        via = pairs.where(
            (F.col("x.fp") < F.col("y.fp"))
            & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance)
        ).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    return found.unionByName(via.where("a <> b"))


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2, bucket_limit: int = 64,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    Words are runs without ASCII white space after lower-casing A-Z; a text of
    fewer than ``shingle`` words is one shingle, a text without words (or null)
    has fingerprint zero and links like any other. ``component_id`` is the
    smallest ``doc_id`` reachable over links of at most ``distance`` bits.
    Rows that repeat a ``doc_id`` are one document: they share its component,
    and all of them are returned. Rows with a null id are returned with a null
    ``component_id`` and link with nothing. Other columns are not read.
    """
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    known = prints.where("doc_id is not null")
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    # Rows that repeat an id tie their classes together.
    repeated = known.groupBy("doc_id").agg(
        F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("n")
    ).where("n > 1 and low <> high").select("doc_id")
    same_id = known.join(repeated, "doc_id").join(classes, "fp").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links(classes, distance, bucket_limit).unionByName(same_id), "simhash")
    named = stored(classes.join(found, classes["rep"] == found["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")), "simhash-named")
    return prints.join(named.hint("shuffle_merge"), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one document per group: the
    smallest id stays. Of rows that repeat that id the one with the least hash
    of all columns stays; rows with a null id stay."""
    groups = simhash_groups(docs, shingle, distance, id_col=id_col, text_col=text_col)
    heads = stored(groups.where("doc_id = component_id").groupBy("doc_id")
                   .agg(F.count("*").alias("n")), "simhash-heads")

    def rows_of(condition: str) -> DataFrame:
        ids = heads.where(condition).select(F.col("doc_id").alias("__head"))
        return docs.join(ids, docs[id_col].cast("long") == F.col("__head"), "left_semi")

    one = rows_of("n > 1").groupBy(id_col).agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row"))
    return (rows_of("n = 1").unionByName(one.select("__row.*"))
            .unionByName(docs.where(F.col(id_col).isNull())))
