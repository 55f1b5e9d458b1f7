"""Personal data by candidate gradient boosting, in column expressions only.

Generators of high recall propose spans that may overlap.  The strict kinds (``BASE``) are what their pattern and check
say.  Every proposed span is described by its format and its surroundings, never by the checks: a boosted ensemble of
small trees learns from all candidates of the corpus how spans look that pass the checks.  Equal descriptions are added
up before learning, so the table that the trees see has one row for each description and outcome.  Per generator the
score is calibrated on the texts that were left out: the threshold is the lowest score from which on ``PRECISION`` of
the candidates pass the checks.  Candidates above it that no base span touches are added to the base spans.

The trees become a column expression, so scoring is one pass over the texts without a shuffle.

Defined cases: a null text is an empty one and has no spans; null ids, repeated rows and ties come out row by row; if no
candidate passes or none fails, or no threshold is precise enough, nothing is added; an empty table gives an empty
result; other columns are not read.  The patterns are written so that matching stays linear and does not recurse,
however long a run of digits or letters is.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import checkpointed

#: Base kinds in the order in which equal starts are listed, then generators of further candidates.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "likely_email": r"[A-Za-z0-9._%+-]{2,64}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{2,64}"
    r"\x20?(?:\[dot\]|\(dot\)|\x20dot\x20|\.)\x20?[A-Za-z]{2,24}",
    "likely_number": r"[0-9(][\x20().0-9-]{6,40}[0-9]",
    "likely_address": r"(?<![0-9.])[0-9]{1,3}(?:[.:][0-9]{1,3}){3,15}+",
}
KINDS = [*BASE, *MORE]
#: A text without any of these cannot hold a candidate.
ANY = r"[0-9@]|\x20at\x20|\[at\]|\(at\)"
CUES = r"(?i)(?:mail|phone|tel|call|mobile|fax|card|visa|account|iban|ssn|ip|host|server|address|contact|number)[^A-Za-z0-9]{0,3}$"
FEATURES = (
    "kind", "digits", "length", "separators", "plus", "zero", "groups", "first_group", "last_group", "before", "after",
    "cue",
)
#: Texts whose hash has this remainder by FOLDS calibrate, the others teach.
FOLDS = 5
PRECISION, SUPPORT = 0.95, 20
TREES, LEVELS, RATE = 12, 3, 0.3
#: Running sums add up this many lengths at a time, so that they stay cheap for any number of matches.
STRIDE = 128
#: Steps of a search by halves in an array, enough for any text's spans.
HALVES = [1 << k for k in range(26, -1, -1)]
#: Names of spans by number: base kinds, generators, and base-like spans that fail their check and are added all the same.
NAMES = [*BASE, *MORE, *(f"like_{k}" for k in BASE)]


def _passes(kind: str, word: Column) -> Column:
    digits = F.regexp_replace(word, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(word, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(False)


def _kind_of(char: Column) -> Column:
    """0: nothing or white space, 1: letter, 2: digit, 3: other."""
    return (
        F.when(F.coalesce(F.btrim(char, F.lit(" \t\n\x0b\f\r")), F.lit("")) == "", 0)
        .when(char.rlike(r"^\p{L}"), 1)
        .when(char.rlike("^[0-9]"), 2)
        .otherwise(3)
    )


def _described(kind: int, word: Column, gap: Column, after: Column) -> Column:
    groups = F.array_remove(F.split(word, "[^0-9]+"), "")
    digits = F.length(F.array_join(groups, ""))
    values = (
        F.lit(kind),
        F.least(digits, F.lit(24)),
        F.least(F.length(word), F.lit(40)),
        F.least(F.length(word) - digits, F.lit(12)),
        word.startswith("+").cast("int"),
        word.startswith("0").cast("int"),
        F.least(F.size(groups), F.lit(8)),
        F.coalesce(F.least(F.length(F.get(groups, F.lit(0))), F.lit(10)), F.lit(0)),
        F.coalesce(F.least(F.length(F.get(groups, F.size(groups) - 1)), F.lit(10)), F.lit(0)),
        _kind_of(F.right(gap, F.lit(1))),
        _kind_of(F.left(after, F.lit(1))),
        F.right(gap, F.lit(24)).rlike(CUES).cast("int"),
    )
    return F.struct(*[v.cast("int").alias(name) for name, v in zip(FEATURES, values)])


def candidates(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, fold, found): every proposed span as (start, end, kind, ok, f); ok says that it is a base span."""
    c = F.col
    df = docs.select(c(id_col).alias("id"), F.coalesce(c(text), F.lit("")).alias("t"))
    df = df.select("id", F.pmod(F.xxhash64("t"), F.lit(FOLDS)).alias("fold"), F.when(c("t").rlike(ANY), c("t")).alias("t"))
    patterns = {**BASE, **MORE}
    may = {"email": c("t").contains("@"), "phone": c("t").contains("+")}
    # Matches have no places in SQL: they follow from the lengths of the matches and of what lies between them.
    df = df.select(
        "id", "fold",
        *[F.when(may.get(k, F.lit(True)), F.split("t", p)).alias(f"gap_{k}") for k, p in patterns.items()],
        *[F.when(may.get(k, F.lit(True)), F.regexp_extract_all("t", F.lit(p), F.lit(0))).alias(f"word_{k}")
          for k, p in patterns.items()],
    )

    def steps(k: str) -> Column:
        return F.transform(
            c(f"word_{k}"),
            lambda _, i: F.length(F.get(c(f"gap_{k}"), i))
            + F.when(i > 0, F.length(F.get(c(f"word_{k}"), i - 1))).otherwise(0),
        )

    df = df.select("*", *[steps(k).alias(f"step_{k}") for k in KINDS])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def sums(k: str) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(f"step_{k}") / STRIDE).cast("int"))
        return F.transform(blocks, lambda b: total(F.slice(c(f"step_{k}"), b * STRIDE + 1, F.lit(STRIDE))))

    df = df.select("*", *[sums(k).alias(f"sum_{k}") for k in KINDS])
    # What lies before each block is added up once.
    upto = lambda k: F.transform(f"sum_{k}", lambda _, b: total(F.slice(c(f"sum_{k}"), F.lit(1), b)))
    df = df.select("*", *[upto(k).alias(f"upto_{k}") for k in KINDS])

    def spans(n: int, k: str) -> Column:
        def span(word: Column, i: Column) -> Column:
            block = F.floor(i / STRIDE).cast("int")
            start = F.get(c(f"upto_{k}"), block) + total(F.slice(c(f"step_{k}"), block * STRIDE + 1, i % STRIDE + 1))
            return F.struct(
                start.cast("long").alias("start"),
                (start + F.length(word)).cast("long").alias("end"),
                F.lit(n).alias("kind"),
                _passes(k, word).alias("ok"),
                _described(n, word, F.get(c(f"gap_{k}"), i), F.get(c(f"gap_{k}"), i + 1)).alias("f"),
            )

        return F.coalesce(F.transform(c(f"word_{k}"), span), F.array().cast(SPANS))

    df = df.select("id", "fold", *[spans(n, k).alias(f"spans_{k}") for n, k in enumerate(KINDS)])
    places = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    return df.select(
        "id", "fold", F.concat(*[f"spans_{k}" for k in KINDS]).alias("found"),
        *[F.transform(F.filter(f"spans_{k}", lambda x: x["ok"]), places).alias(f"base_{k}") for k in BASE],
    )


_F = ", ".join(f"{name}: int" for name in FEATURES)
SPANS = f"array<struct<start: bigint, end: bigint, kind: int, ok: boolean, f: struct<{_F}>>>"


def _touches_base(x: Column) -> Column:
    """Whether a span overlaps a base span.

    Base spans of one kind lie apart and in order, so of those that start before the span's end the last one reaches
    furthest.  It is found by halves.
    """

    def touches(k: str) -> Column:
        base = F.col(f"base_{k}")
        further = lambda n, p: (n + p <= F.size(base)) & (F.get(base, n + p - 1)["start"] < x["end"])
        n = F.aggregate(F.array(*map(F.lit, HALVES)), F.lit(0), lambda n, p: F.when(further(n, p), n + p).otherwise(n))
        return F.when(F.size(base) > 0, F.coalesce(F.get(base, n - 1)["end"] > x["start"], F.lit(False))).otherwise(F.lit(False))

    return reduce(or_, map(touches, BASE))


def _tree(node, f: Column) -> Column:
    """A fitted tree as nested conditions over the struct of features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    name, threshold = FEATURES[node.split().featureIndex()], float(node.split().threshold())
    return F.when(f[name] <= threshold, _tree(node.leftChild(), f)).otherwise(_tree(node.rightChild(), f))


class Ensemble:
    """Boosted trees and the thresholds by kind; ``score`` is a column expression."""

    def __init__(self, roots: list | None, weights: list[float], thresholds: dict[int, float]) -> None:
        self.roots, self.weights, self.thresholds = roots, weights, thresholds

    def score(self, f: Column) -> Column:
        margin = sum((_tree(r, f) * F.lit(float(w)) for r, w in zip(self.roots, self.weights)), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * -2.0))

    def selects(self, x: Column) -> Column:
        chosen = F.lit(False)
        for kind, threshold in self.thresholds.items():
            chosen = chosen | ((x["kind"] == kind) & (self.score(x["f"]) >= threshold))
        return chosen


def fit(found: DataFrame) -> Ensemble:
    """Learn from all candidates; a candidate counts as personal if it is or overlaps a base span."""
    outcome = F.transform(
        "found", lambda x: F.struct(_touches_base(x).cast("double").alias("label"), x["f"].alias("f"))
    )
    flat = found.select("fold", F.explode(outcome).alias("x")).select("fold", "x.label", "x.f.*")
    table = checkpointed(flat.groupBy((F.col("fold") == 0).alias("held"), "label", *FEATURES).agg(F.count("*").alias("n")))
    teach = table.where("not held")
    if teach.select("label").distinct().count() < 2:
        return Ensemble(None, [], {})
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(teach)
    rows = rows.select("label", "features", F.col("n").cast("double").alias("weight"))
    booster = GBTClassifier(
        maxIter=TREES, maxDepth=LEVELS, stepSize=RATE, weightCol="weight", maxBins=64, seed=7, minInstancesPerNode=1
    )
    model = booster.fit(rows)
    ensemble = Ensemble([t._call_java("rootNode") for t in model.trees], list(model.treeWeights), {})
    # From the highest score down: how many pass so far, of how many.
    scored = table.where("held").select(
        "kind", "label", "n", ensemble.score(F.struct(*[F.col(x) for x in FEATURES])).alias("score")
    )
    steps = scored.groupBy("kind", "score").agg(F.sum(F.col("n") * F.col("label")).alias("good"), F.sum("n").alias("n"))
    so_far = Window.partitionBy("kind").orderBy(F.desc("score"))
    summed = steps.select("kind", "score", F.sum("good").over(so_far).alias("good"), F.sum("n").over(so_far).alias("n"))
    precise = summed.where((F.col("n") >= SUPPORT) & (F.col("good") >= PRECISION * F.col("n")))
    lowest = precise.groupBy("kind").agg(F.min("score").alias("threshold")).collect()  # a row for each kind at most
    ensemble.thresholds = {r["kind"]: r["threshold"] for r in lowest}
    return ensemble


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, added, spans = both): arrays of (start, end, kind), by start and then kind as listed; kind is its number
    in NAMES, places count code points, the end is exclusive."""
    found = candidates(docs, id_col, text)
    ensemble = fit(found)
    names = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    base = F.transform(F.filter("found", lambda x: x["ok"]), names)
    if ensemble.thresholds:
        extra = F.filter("found", lambda x: ensemble.selects(x) & ~_touches_base(x))
        kind = lambda x: F.when(x["kind"] < len(BASE), x["kind"] + len(KINDS)).otherwise(x["kind"])
        added = F.transform(extra, lambda x: F.struct(x["start"].alias("start"), kind(x).alias("kind"), x["end"].alias("end")))
    else:
        added = F.filter(base, lambda x: F.lit(False))
    return found.select("id", base.alias("base"), added.alias("added")).select(
        "id", F.array_sort("base").alias("base"), "added", F.array_sort(F.concat("base", "added")).alias("spans")
    )
