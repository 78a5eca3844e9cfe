"""Personal data by candidate gradient boosting (operator 8), in built-in functions only.

Base rules give the sure spans: the leftmost matches of each kind's pattern that
pass its check. Wider generators propose further candidates, overlapping ones too:
the base patterns' failing matches and looser spellings (numbers without a plus
sign, spelled-out addresses, short card numbers). Boosted trees, trained on a
bounded sample of candidates with the base rules' verdict as label, score each
candidate by its format and its context; a threshold per kind, calibrated for
precision on all base matches, selects the candidates that become redactions
besides the base spans.

Matching needs no Python: ``split`` gives the texts between matches,
``regexp_extract_all`` the matches, and running lengths of both give positions in
code points. The patterns find what the stated ones find, with possessive
repetition and look-behind at run starts, so that no text takes more than linear
time. The trained trees become one SQL expression, so scoring runs where the
candidates are, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored, text_or_empty

KINDS = ["email", "ip", "card", "phone"]

# The base patterns. Runs start where no character of the run precedes;
# \G admits a run that begins where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Further candidates, high recall before precision.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++"
             r"(?:(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3} ?\. ?[0-9]{1,3} ?\. ?[0-9]{1,3} ?\. ?[0-9]{1,3}(?![0-9.])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,12}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
# A cheap test that every text with a match of the kind passes.
NEEDS = {
    "email": lambda text: text.contains("@") | text.contains("at)") | text.contains("at]"),
    "ip": lambda text: text.rlike(r"[0-9] ?\. ?[0-9]"),
    "card": lambda text: text.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda text: text.rlike(r"[+(.0-9][0-9]"),
}
CUES = r"(?i)(mail|tel|phone|call|fax|card|visa|ip|host|address|contact)\W{0,4}$"
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

#: Documented bound of the training sample (candidates, smallest hashes first).
SAMPLE = 20_000
PRECISION = 0.995
FEATURES = ["kind", "length", "digits", "letters", "marks", "at", "points", "blanks", "luhn",
            "parts", "before_word", "after_word", "cue"]
CONTEXT = 16
SPAN = "struct<start:int,kind:int,stop:int>"
CANDIDATE = "struct<start:int,kind:int,stop:int,wide:boolean,base:boolean,f:struct<{}>>".format(
    ",".join(f"{n}:double" for n in FEATURES))


def _matches(text: Column, pattern: str) -> Column:
    """Structs ``(start, stop, match)`` of the pattern's matches, by running lengths.

    The text after the last match is paired with a null match and adds nothing."""
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    none = F.lit([]).cast("array<struct<start:int,stop:int,match:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.length(x["match"])
        more = F.struct(start.alias("start"), stop.alias("stop"), x["match"].alias("match"))
        return F.when(x["match"].isNull(), state).otherwise(F.struct(
            stop.alias("at"), F.concat(state["found"], F.array(more)).alias("found")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")),
                       step, lambda state: state["found"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """The Luhn sum of the digits is a multiple of ten."""
    values = F.transform(F.regexp_extract_all(F.reverse(match), F.lit("[0-9]"), F.lit(0)),
                         lambda d: d.cast("int"))
    worth = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d < 5, d * 2)
                        .otherwise(d * 2 - 9))
    return F.aggregate(worth, F.lit(0), lambda s, d: s + d) % 10 == 0


def _small_parts(match: Column) -> Column:
    """Every point-separated part is a number of at most 255."""
    return F.forall(F.split(match, r" ?\. ?"), lambda part: F.regexp_replace(
        part, "^0+(?=[0-9])", "").rlike("^([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def _passes(kind: str, match: Column) -> Column:
    digits = F.length(_digits(match))
    return {"email": F.lit(True), "ip": _small_parts(match),
            "card": digits.between(14, 19) & _luhn(match),
            "phone": digits.between(10, 15)}[kind]


def _features(text: Column, kind: int, x: Column) -> Column:
    """Format and context of a candidate, as doubles."""
    match = x["match"]
    before = F.substring(text, F.greatest(x["start"] + 1 - CONTEXT, F.lit(1)),
                         F.least(x["start"], F.lit(CONTEXT)))
    after = F.substring(text, x["stop"] + 1, F.lit(1))

    def count(characters: str) -> Column:
        return F.length(F.regexp_replace(match, f"[^{characters}]", ""))

    values = {
        "kind": F.lit(kind), "length": F.length(match), "digits": count("0-9"),
        "letters": count("A-Za-z"), "marks": count("():-"), "at": match.contains("@"),
        "points": count("."), "blanks": count(r"\x20"), "luhn": _luhn(match),
        "parts": _small_parts(match), "before_word": before.rlike("[A-Za-z0-9]$"),
        "after_word": after.rlike("[A-Za-z0-9]"), "cue": before.rlike(CUES)}
    return F.struct(*[values[n].cast("double").alias(n) for n in FEATURES])


def _candidates_of(text: Column, kind: str) -> Column:
    at = KINDS.index(kind)

    def rated(wide: bool):
        return lambda x: F.struct(
            x["start"].alias("start"), F.lit(at).alias("kind"), x["stop"].alias("stop"),
            F.lit(wide).alias("wide"), (F.lit(False) if wide else _passes(kind, x["match"])).alias("base"),
            _features(text, at, x).alias("f")).cast(CANDIDATE)

    both = F.concat(F.transform(_matches(text, BASE[kind]), rated(False)),
                    F.transform(_matches(text, WIDE[kind]), rated(True)))
    return F.when(NEEDS[kind](text), both).otherwise(F.lit([]).cast(f"array<{CANDIDATE}>"))


def candidates(text: Column) -> Column:
    """All candidates of a text: spans with their verdict by the base rules and features."""
    return F.concat(*[_candidates_of(text, k) for k in KINDS])


def _tree_sql(node) -> str:
    """A fitted regression tree as nested CASE expressions over the candidate ``c``."""
    if node.subtreeDepth() == 0:
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return (f"CASE WHEN c.f.{FEATURES[split.featureIndex()]} <= {float(split.threshold())!r}D "
            f"THEN {_tree_sql(node.leftChild())} ELSE {_tree_sql(node.rightChild())} END")


def _margin_sql(model: GBTClassificationModel) -> str:
    return "(" + " + ".join(f"{float(w)!r}D * ({_tree_sql(t._call_java('rootNode'))})"
                            for t, w in zip(model.trees, model.treeWeights)) + ")"


def _limits(found: DataFrame, margin: str, precision: float) -> dict[int, float]:
    """The lowest margin of each kind above which the share of sure spans reaches
    ``precision`` (infinity if none does), from a histogram of all base matches.

    A margin is a sum of leaf values of a fixed number of trees, and counted as it is: the
    histogram stays a table, and one row per kind leaves it."""
    bins = found.select(F.explode("candidates").alias("c")).where("not c.wide").select(
        F.col("c.kind").alias("kind"), F.expr(margin).alias("margin"), F.col("c.base").cast("long").alias("sure")
    ).groupBy("kind", "margin").agg(F.sum("sure").alias("sure"), F.count("*").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.col("margin").desc())
    share = F.sum("sure").over(above) / F.sum("n").over(above)
    fine = F.when((F.col("share") >= precision) & (F.col("margin") > 0), F.col("margin"))
    rows = bins.withColumn("share", share).groupBy("kind").agg(
        F.coalesce(F.min(fine), F.lit(float("inf"))).alias("limit"))
    return {r["kind"]: float(r["limit"]) for r in rows.collect()}


def fit_selector(found: DataFrame, sample: int = SAMPLE, precision: float = PRECISION,
                 seed: int = 7) -> str | None:
    """SQL that tells whether the candidate ``c`` is selected, from ``found(doc_id, candidates)``.

    Boosted trees learn the base rules' verdicts on matches of the base patterns from a
    bounded sample, an equal share of it for each kind; all matches give each kind the
    lowest margin above which the share of sure spans reaches ``precision``. A kind
    without any base match in all data takes the highest margin found for another. None if the sample holds no failing or no sure match."""
    rows = found.select("doc_id", F.explode("candidates").alias("c")).where("not c.wide").select(
        F.xxhash64("doc_id", "c.start", "c.kind").alias("place"), "c")
    share = sample // len(KINDS)
    parts = [rows.where(F.col("c.kind") == k).orderBy("place", "c").limit(share) for k in range(len(KINDS))]
    picked = stored(reduce(DataFrame.union, parts), "pii-sample")
    given = picked.select("c", F.col("c.base").cast("double").alias("label"), *[f"c.f.{n}" for n in FEATURES])
    given = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(given)
    if given.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=10, maxDepth=3, seed=seed, maxBins=64).fit(given.select("label", "features"))
    margin = _margin_sql(model)
    limits = _limits(found, margin, precision)
    finite = {k: v for k, v in limits.items() if v < float("inf")}
    if not finite:
        return None
    cases = " ".join(f"WHEN {k} THEN " + (f"{v!r}D" if k in finite else "double('infinity')")
                     for k, v in sorted(limits.items()))
    return f"{margin} >= CASE c.kind {cases} ELSE {max(finite.values())!r}D END"


def spans(selector: str | None) -> Column:
    """All spans of a row with the column ``candidates``: base spans and selected others
    that overlap neither them nor one kept before (by start, the longer first); by start, then kind."""
    base = "transform(filter(candidates, c -> c.base), c -> struct(c.start, c.kind, c.stop))"
    none = F.lit([]).cast(f"array<{SPAN}>")
    sure = F.expr(base).cast(f"array<{SPAN}>")
    if selector is None:
        return F.sort_array(F.coalesce(sure, none))
    chosen = F.filter(
        F.expr(f"filter(candidates, c -> NOT c.base AND {selector})"),
        lambda c: ~F.exists(F.col("candidates"), lambda b: b["base"] & (b["start"] < c["stop"])
                            & (c["start"] < b["stop"])))
    extra = F.array_sort(F.transform(chosen, lambda c: F.struct(
        c["start"].alias("start"), (-c["stop"]).alias("back"), c["kind"].alias("kind"))))

    def step(kept: Column, c: Column) -> Column:
        # By start: what is kept ends in order, so only the last can reach into the next.
        free = (F.size(kept) == 0) | (F.get(kept, F.size(kept) - 1)["stop"] <= c["start"])
        span = F.struct(c["start"].alias("start"), c["kind"].alias("kind"), (-c["back"]).alias("stop"))
        return F.when(free, F.concat(kept, F.array(span))).otherwise(kept)

    apart = F.aggregate(extra, none, step)
    return F.sort_array(F.concat(sure, apart))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, candidates, base_spans, spans)`` of every row, in one pass over the texts.

    Spans are structs ``(start, kind, stop)`` in code points, ``kind`` an index of
    ``KINDS``. A null text is empty and has none; a null id is kept. Repeated rows
    get equal spans. Texts of any length take linear time."""
    found = stored(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
                   .select("doc_id", candidates(F.col("text")).alias("candidates")), "pii-candidates")
    selector = fit_selector(found)
    return found.select("doc_id", "candidates", spans(None).alias("base_spans"),
                        spans(selector).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts per kind and digest of the base spans, and all spans written out."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"))


def redact(text: Column, found: Column) -> Column:
    """The text with a tag for each span; overlapping spans become one tag, the first's."""
    tags = F.array(*[F.lit(TAGS[k]) for k in KINDS])

    def step(state: Column, s: Column) -> Column:
        out = F.when(s["start"] >= state["at"], F.concat(
            state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]),
            F.element_at(tags, s["kind"] + 1))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], s["stop"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(found, start, step, lambda state: F.concat(
        state["out"], F.substring(text, state["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of its texts replaced by tags; all else as it was.
    Null texts stay null."""
    found = stored(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
                   .select("doc_id", candidates(F.col("text")).alias("candidates")), "pii-candidates")
    selector = fit_selector(found)
    rows = docs.withColumn("__row", F.struct(*docs.columns)).select(
        "__row", candidates(text_or_empty("__row." + text_col)).alias("candidates"))
    clean = F.when(F.size("candidates") == 0, F.col(f"__row.{text_col}")).otherwise(
        redact(text_or_empty(f"__row.{text_col}"), spans(selector)))
    return rows.select(*[clean.alias(c) if c == text_col else F.col(f"__row.{c}").alias(c)
                         for c in docs.columns])
