"""Quality by a modified Kneser-Ney language model (operator 3).

Documents are scored by the word n-grams of :mod:`ledgerframe.llm.word_lm`: all
trusted text is counted into sharded tables, joined with the n-grams of every
document. A document's perplexity (per token) covers its whole text. Short texts
are drawn towards the trusted mean by ``PRIOR_TOKENS`` tokens of it, so that a few
rare words do not decide. The threshold of a language is a quantile of its trusted
documents' perplexities over all of them (fixed-width bins of the log perplexity,
at most ``BIN`` above it); no trusted document is scored by counts of its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored
from ledgerframe.llm.word_lm import row_key, word_costs

PRIOR_TOKENS = 40
QUANTILE = 0.99
BIN = 1e-3


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Ids that a label calls good and none calls bad; null ids and labels are none."""
    return labels.select(F.col(id_col).cast("long").alias("doc_id"),
                         F.col(label_col).cast("int").alias("good")
                         ).where("doc_id is not null and good is not null"
                                 ).groupBy("doc_id").agg(F.min("good").alias("good")
                                                         ).where("good > 0").select("doc_id")


def _quantiles(bins: DataFrame, quantile: float, by: list[str]) -> DataFrame:
    """The smallest bin with at least the share ``quantile`` of the rows below or in it."""
    counts = bins.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("bin")
    return counts.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "all", F.sum("n").over(whole)).where(F.col("upto") >= F.col("all") * quantile
                                             ).groupBy(*by).agg(F.min("bin").alias("bin"))


class Quality:
    """Costs of all rows by :func:`row_key`, the trusted mean, thresholds in nats."""

    def __init__(self, rated: DataFrame, mean: float, prior: int, by_lang: DataFrame, overall: float):
        self.rated, self.mean, self.prior = rated, mean, prior
        self.by_lang, self.overall = by_lang, overall

    def nats(self) -> Column:
        return (F.col("cost") + self.mean * self.prior) / (F.col("symbols") + self.prior) / 1e6


def fit(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE,
        prior: int = PRIOR_TOKENS, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Quality | None:
    """The costs of all ``docs`` and the thresholds of the trusted among them; None without any text."""
    good = stored(trusted_ids(labels, id_col), "quality-trusted")
    rated = word_costs(docs, good, id_col, text_col)
    if rated is None:
        return None
    known = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                               F.col(lang_col).cast("string").alias("lang"),
                               row_key(id_col, text_col).alias("at"))
                   .join(good, "doc_id", "left_semi").join(rated, "at"), "quality-costs")
    mean = known.agg(F.sum("cost") / F.sum("symbols")).first()[0]
    fitted = Quality(rated, mean, prior, None, 0.0)
    bins = known.select("lang", F.floor(fitted.nats() / BIN).alias("bin"))
    limit = (F.col("bin") + 1) * BIN
    fitted.by_lang = stored(_quantiles(bins.where("lang is not null"), quantile, ["lang"]).select(
        F.col("lang").alias("of_lang"), limit.alias("own")), "quality-thresholds")
    fitted.overall = float(_quantiles(bins.select(F.lit(1).alias("one"), "bin"), quantile, ["one"])
                           .select(limit).first()[0])
    return fitted


def judge(docs: DataFrame, fitted: Quality | None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", keep: list[str] = ()) -> DataFrame:
    """``(doc_id, lang, perplexity, threshold, keep)`` of every row, and ``kept``."""
    more = ["kept"] * bool(keep)
    if fitted is None:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                           F.col(lang_col).cast("string").alias("lang"),
                           F.lit(None).cast("double").alias("perplexity"),
                           F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"),
                           *[F.struct(*keep).alias("kept")] * bool(keep))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.col(lang_col).cast("string").alias("lang"),
                        row_key(id_col, text_col).alias("at"),
                        *[F.struct(*keep).alias("kept")] * bool(keep))
    rated = given.join(fitted.rated, "at")
    judged = rated.join(fitted.by_lang, F.col("lang") == F.col("of_lang"), "left").select(
        "doc_id", "lang", fitted.nats().alias("nats"),
        F.coalesce("own", F.lit(fitted.overall)).alias("limit"), *more)
    return judged.select("doc_id", "lang", F.exp("nats").alias("perplexity"),
                         F.exp("limit").alias("threshold"),
                         (F.col("nats") <= F.col("limit")).alias("keep"), *more)


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE,
            prior: int = PRIOR_TOKENS, id_col: str = "doc_id",
            text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, lang, perplexity, threshold, keep)`` for every row of ``docs``.

    ``keep`` is ``perplexity <= threshold`` of the row's language; a language
    without trusted documents (a null one too) uses the threshold of all
    languages. Without any trusted text every row is kept, with a null
    perplexity and threshold. Empty and null texts have the trusted mean
    perplexity. Repeated rows get equal results; other columns are not read."""
    fitted = fit(docs, labels, quantile, prior, id_col, text_col, lang_col)
    return judge(docs, fitted, id_col, text_col, lang_col)


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`quality` keeps."""
    judged = judge(docs, fit(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col),
                   id_col, text_col, lang_col, docs.columns)
    return judged.where("keep").select("kept.*")
