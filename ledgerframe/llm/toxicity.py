"""Toxicity by a factorization machine over hashed terms (operator 7).

A text's terms are its lower-case words and the first letters of its longer words,
hashed; a term counts once however often it occurs, so that a passage weighs the
same in a short and in a long text. The machine scores
``w0 + sum w_i + sum_{i<j} <v_i, v_j>`` over the terms present: the pairwise part
learns what neither of two terms says alone. Training is proximal (soft
thresholds on weights and on whole factor rows), so terms without evidence stay
at exactly zero and long clean texts gather no noise.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_PER_CLASS``
documents of each class, smallest hashes first) in one task; the share of toxic
rows among *all* labelled training rows sets the intercept, so the score is a
probability on the labels' own mix. Every text is scored in full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import given_back, stored, text_or_empty

#: Documented bound of the training sample.
SAMPLE_PER_CLASS = 6000
TERM_SPACE = 1 << 18
RANK = 4
EPOCHS = 12
THRESHOLD = 0.7
PREFIXES = (4, 5)
WORD = re.compile(r"[^\W\d_]+")
MEMO_WORDS = 300_000


@lru_cache(maxsize=MEMO_WORDS)
def _terms_of_word(word: str) -> tuple[int, ...]:
    import xxhash

    names = [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)]
    return tuple(xxhash.xxh32_intdigest(n.encode("utf-8", "surrogatepass")) % TERM_SPACE
                 for n in names)


def terms(text: str) -> np.ndarray:
    """The sorted distinct hashed terms of one text."""
    found: set[int] = set()
    for word in set(WORD.findall(text.lower())):
        found.update(_terms_of_word(word))
    return np.array(sorted(found), np.int64)


def forget() -> None:
    """Ends a task: the worker's next one may be of another stage, which the memo would only burden."""
    _terms_of_word.cache_clear()
    given_back()


class FactorizationMachine:
    """Binary features given as index lists; logistic loss, AdaGrad, proximal L1."""

    def __init__(self, size: int = TERM_SPACE, rank: int = RANK, seed: int = 7):
        self.bias = 0.0
        self.weight = np.zeros(size)
        self.factor = np.random.default_rng(seed).normal(0, 0.02, (size, rank))

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for k, row in enumerate(rows):
            if len(row):
                v = self.factor[row]
                total = v.sum(axis=0)
                out[k] += self.weight[row].sum() + 0.5 * (total @ total - (v * v).sum())
        return out

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 64,
            rate: float = 0.3, thrift: float = 1.5e-3, min_rows: int = 4, seed: int = 7) -> None:
        """Terms that fewer than ``min_rows`` training rows hold take no part."""
        hits = np.zeros((2, len(self.weight)))
        for row, mark in zip(rows, y):
            hits[int(mark), row] += 1
        seen, many = hits.sum(axis=0), np.array([[np.sum(y == 0)], [np.sum(y == 1)]])
        rows = [row[seen[row] >= min_rows] for row in rows]
        self.factor[seen < min_rows] = 0
        # Adaptive penalty: little for terms whose share differs clearly between the classes.
        rate_0, rate_1 = hits / many
        ratio = np.abs(np.log((hits[1] + 0.5) / (many[1] + 1) / ((hits[0] + 0.5) / (many[0] + 1))))
        pooled = np.maximum(seen / len(y), 1 / len(y))
        z = np.abs(rate_1 - rate_0) / np.sqrt(pooled * (1 - pooled) * (1 / many).sum() + 1e-12)
        thrift = thrift * 8 / (ratio * z + 0.5)
        square_w, square_v = np.full(len(seen), 1e-2), np.full(len(seen), 1e-2)
        square_b, order = 1e-2, np.random.default_rng(seed)
        for _ in range(epochs):
            mix = order.permutation(len(rows))
            for at in range(0, len(mix), batch):
                some = [rows[k] for k in mix[at:at + batch]]
                off = y[mix[at:at + batch]] - 1 / (1 + np.exp(-np.clip(self.margins(some), -30, 30)))
                flat = np.concatenate(some)
                term, place = np.unique(flat, return_inverse=True)
                share = np.repeat(off, [len(r) for r in some])
                n = len(some)
                grad_w = -np.bincount(place, share, len(term)) / n
                grad_v = np.zeros((len(term), self.factor.shape[1]))
                sums = np.stack([self.factor[r].sum(axis=0) for r in some])
                pull = np.repeat(sums, [len(r) for r in some], axis=0) - self.factor[flat]
                np.add.at(grad_v, place, -share[:, None] * pull / n)
                square_w[term] += grad_w ** 2
                square_v[term] += (grad_v ** 2).mean(axis=1)
                step_w, step_v = rate / np.sqrt(square_w[term]), 0.3 * rate / np.sqrt(square_v[term])
                w = self.weight[term] - step_w * grad_w
                self.weight[term] = np.sign(w) * np.maximum(np.abs(w) - step_w * thrift[term], 0)
                v = self.factor[term] - step_v[:, None] * grad_v
                size = np.linalg.norm(v, axis=1) + 1e-12
                self.factor[term] = v * np.maximum(1 - step_v * thrift[term] / size, 0)[:, None]
                square_b += off.mean() ** 2
                self.bias += rate / np.sqrt(square_b) * off.mean()
        self.factor[(self.factor ** 2).sum(axis=1) < 1e-6] = 0


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column | None = None,
                  id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """``(doc_id, toxic)`` of labelled ids; an id with several labels is toxic if one says so.
    Null labels and ids are no labels. ``allowed`` is a condition on ``doc_id``."""
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"),
                          F.col(label_col).cast("int").alias("toxic")
                          ).where("doc_id is not null and toxic is not null")
    if allowed is not None:
        named = named.where(allowed)
    return named.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def fit_model(docs: DataFrame, labels: DataFrame, allowed: Column | None = None,
              per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "toxic") -> dict | None:
    """The model as arrays, or None without labelled documents of both classes.

    Its size is bounded by the terms of the bounded sample."""
    rated = stored(training_rows(docs, labels, allowed, id_col, label_col), "toxicity-labels")
    picks = [rated.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
             for c in (0, 1)]
    sample = stored(picks[0].unionByName(picks[1]), "toxicity-sample")  # 2 * per_class rows at most

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "doc_id": batch["doc_id"],
                                "terms": [terms(t).astype("<u4").tobytes() for t in batch["text"]]})
        forget()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        text_or_empty(text_col).alias("text"))
    rows = stored(texts.join(F.broadcast(sample), "doc_id")
                  .mapInPandas(featurise, "toxic int, doc_id long, terms binary")
                  .dropDuplicates(["doc_id"]), "toxicity-terms")
    share = {r["toxic"]: r["n"] for r in
             rated.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    had = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not had.get(0) or not had.get(1):
        return None
    # From the sample's mix of classes to that of all labelled rows.
    shift = float(np.log(share[1] / share[0]) - np.log(had[1] / had[0]))

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        given = [np.frombuffer(b, "<u4").astype(np.int64) for b in group["terms"]]
        model = FactorizationMachine()
        model.fit(given, group["toxic"].to_numpy(float))
        used = np.flatnonzero((model.weight != 0) | (model.factor != 0).any(axis=1))
        return pd.DataFrame([{"bias": model.bias, "used": used.astype("<u4").tobytes(),
                              "weight": model.weight[used].tobytes(),
                              "factor": model.factor[used].tobytes()}])

    # One task on the bounded sample.
    row = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(
        train, "bias double, used binary, weight binary, factor binary").first()
    return {"bias": row["bias"] + shift, "used": np.frombuffer(row["used"], "<u4"),
            "weight": np.frombuffer(row["weight"]),
            "factor": np.frombuffer(row["factor"]).reshape(-1, RANK)}


def score(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD,
          id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """``(doc_id, score double, predicted int)`` of every row, and the columns ``keep`` as a
    struct ``kept``. A null text is scored as the empty text, by the intercept alone;
    without a model every score is 0."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        text_or_empty(text_col).alias("text"),
                        *[F.struct(*keep).alias("kept")] * bool(keep))
    names = [c for c in given.columns if c != "text"] + ["score"]

    def rate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if model is not None:
            place = np.full(TERM_SPACE, -1, np.int32)
            place[model["used"]] = np.arange(len(model["used"]))
            weight, factor, bias = model["weight"], model["factor"], model["bias"]
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if model is not None:
                for k, text in enumerate(batch.column("text").to_pylist()):
                    row = place[terms(text)]
                    row = row[row >= 0]
                    v = factor[row]
                    total = v.sum(axis=0)
                    margin = bias + weight[row].sum() + 0.5 * (total @ total - (v * v).sum())
                    out[k] = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out) if n == "score" else batch.column(n) for n in names], names)
        batch = None
        forget()

    schema = ", ".join(f"`{c}` {t}" for c, t in given.drop("text").dtypes)
    return given.mapInArrow(rate, f"{schema}, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not predict toxic."""
    model = fit_model(docs, labels, ~held_out(), id_col=id_col, text_col=text_col)
    return score(docs, model, threshold, id_col, text_col, docs.columns).where(
        "predicted = 0").select("kept.*")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Labels of held-out ids are never read for training. Repeated rows get equal scores."""
    model = fit_model(docs, labels, ~held_out(), id_col=id_col, text_col=text_col)
    return score(docs, model, threshold, id_col, text_col).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted")
