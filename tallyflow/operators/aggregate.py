"""Aggregation across instances at one time, and routing into it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.text import from_posix
from tallyflow.model import TAGS

FUNCTIONS = {
    "num": lambda v: F.count(v).cast("double"),
    "sum": F.sum,
    "average": F.avg,
    "minimum": F.min,
    "maximum": F.max,
    "stddev": F.stddev_pop,
}

# Fixed value: placeholder for the function name in a given plugin instance.
FUNCTION_PLACEHOLDER = "%{aggregation}"


def matches(conditions: Mapping[str, str]) -> Column:
    """All identifier parts match.  ``/x/`` and ``^x`` style values are regexes."""
    tests = [F.col(part).rlike(from_posix(pattern)) for part, pattern in conditions.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


@dataclass(frozen=True)
class Aggregation:
    """Which points to bring together and which functions to apply."""

    plugin: str | None = None
    plugin_instance: str | None = None
    type: str | None = None
    by: tuple[str, ...] = ("host", "type_instance")
    functions: tuple[str, ...] = ("average",)
    set_plugin: str = "aggregation"
    set_plugin_instance: str | None = None

    def conditions(self) -> dict[str, str]:
        parts = {"plugin": self.plugin, "plugin_instance": self.plugin_instance, "type": self.type}
        return {k: self._pattern(v) for k, v in parts.items() if v is not None}

    @staticmethod
    def _pattern(value: str) -> str:
        if len(value) > 1 and value.startswith("/") and value.endswith("/"):
            return value[1:-1]
        return "^" + "".join("\\" + c if c in r".^$|?*+()[]{}\\" else c for c in value) + "$"

    def label(self, function: str) -> str:
        if self.set_plugin_instance is None:
            return f"{(self.plugin or '').strip('/^$')}-{function}"
        return self.set_plugin_instance.replace(FUNCTION_PLACEHOLDER, function)


def aggregate(points: DataFrame, spec: Aggregation, *, interval: int | None = None) -> DataFrame:
    """One point per group, time and function.

    Points of one time belong together; with ``interval`` times are first cut to
    collect intervals.
    """
    at = F.col("ts")
    if interval:
        at = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / F.lit(interval)) * F.lit(interval))
    chosen = points.where(matches(spec.conditions()))
    # The type is fixed by the specification, or one more thing to group by.
    fixed = spec.type is not None and spec.type == spec.type.strip("/")
    by = list(spec.by) if fixed or "type" in spec.by else [*spec.by, "type"]
    grouped = chosen.groupBy(*by, at.alias("ts")).agg(*[FUNCTIONS[f](F.col("value")).alias(f) for f in spec.functions])
    if fixed:
        grouped = grouped.withColumn("type", F.lit(spec.type))
    results = F.array(
        *[
            F.struct(F.lit(spec.label(f)).alias("plugin_instance"), F.lit(f).alias("function"), F.col(f).alias("value"))
            for f in spec.functions
        ]
    )
    kept = [k for k in spec.by if k not in ("plugin", "plugin_instance", "type")]
    listed = grouped.select(*kept, "ts", "type", results.alias("_results"))
    return listed.withColumn("r", F.explode("_results")).select(
        *kept,
        "ts",
        "type",
        F.lit(spec.set_plugin).alias("plugin"),
        "r.plugin_instance",
        F.col("r.function").alias("function"),
        F.col("r.value").alias("value"),
    )


# The two aggregations of server metrics.
CPU_AVERAGE = Aggregation(plugin="cpu", type="cpu", by=("host", "type_instance"), functions=("average",))
MAX_TEMPERATURE = Aggregation(plugin="sensors", type="temperature", by=("host",), functions=("maximum",))

# Job statistics of all metadata or all data targets of a server, brought together.
JOB_TARGETS = {"MDS": "^.+-MDT[0-9a-fA-F]+$", "OSS": "^.+-OST[0-9a-fA-F]+$"}
JOB_SUMS = {
    name: Aggregation(
        plugin=f"/{targets}/", plugin_instance="/^jobstat.*/", type="derive", functions=("sum", "average"),
        set_plugin=name, set_plugin_instance="jobstat-sum",
    )
    for name, targets in JOB_TARGETS.items()
}


@dataclass(frozen=True)
class RouteRule:
    """Points that match go to the aggregation; ``stop`` drops the originals."""

    match: Mapping[str, str]
    into: Aggregation
    stop: bool = False


@dataclass(frozen=True)
class Chain:
    rules: tuple[RouteRule, ...] = field(default_factory=tuple)


def job_sums(*, keep: bool = False) -> Chain:
    """Job statistics of all targets of a server as sum and average; the targets' own are dropped unless kept."""
    return Chain(tuple(
        RouteRule({"plugin": JOB_TARGETS[name], "plugin_instance": "jobstat.*"}, into, stop=not keep) for name, into in JOB_SUMS.items()
    ))


def route(points: DataFrame, chain: Chain | Sequence[RouteRule]) -> DataFrame:
    """Aggregated points together with the originals no rule stopped.

    Rules apply in order; a point stopped by one rule is not seen by later ones.
    What each rule takes is a bit of one number per point, so all rules share one
    scan, one fan-out to the rules that take a point and one grouped aggregate,
    which is partial before its shuffle.  Originals that stay pass by in a scan of
    their own and are never shuffled.
    """
    rules = chain.rules if isinstance(chain, Chain) else tuple(chain)
    stops = [F.when(F.coalesce(matches(r.match), F.lit(False)), i) for i, r in enumerate(rules) if r.stop]
    stopped_at = F.coalesce(*stops, F.lit(len(rules)))
    kept = points.where(stopped_at == len(rules))
    if not rules:
        return kept
    if len(rules) > 30:
        raise ValueError("a chain has at most 30 rules")
    bits = [F.when(matches(r.match) & matches(r.into.conditions()), 1 << i).otherwise(0) for i, r in enumerate(rules)]
    # Rules up to the one that stops the point see it.
    seen = F.array(*[F.lit((2 << min(i, 29)) - 1) for i in range(len(rules) + 1)])[stopped_at]
    taken = reduce(lambda a, b: a.bitwiseOR(b), bits).bitwiseAND(seen)
    return kept.unionByName(_aggregated(points, taken, [r.into for r in rules]), allowMissingColumns=True)


def _aggregated(points: DataFrame, taken: Column, specs: Sequence[Aggregation]) -> DataFrame:
    """Points aggregated by each specification whose bit they have in ``taken``."""
    fixed = [s.type is not None and s.type == s.type.strip("/") for s in specs]
    grouped_by = [list(s.by) if f or "type" in s.by else [*s.by, "type"] for s, f in zip(specs, fixed)]
    keys = sorted({k for by in grouped_by for k in by})
    functions = sorted({f for s in specs for f in s.functions})

    def copy(i: int) -> Column:
        shown = [F.col(k).cast("string") if k in grouped_by[i] else F.lit(None).cast("string") for k in keys]
        return F.struct(F.lit(i).alias("_rule"), *[c.alias(f"_{k}") for c, k in zip(shown, keys)])

    some = points.select("ts", "value", taken.alias("_taken"), *keys).where(F.col("_taken") != 0)
    copies = F.array_compact(F.array(*[F.when(F.col("_taken").bitwiseAND(F.lit(1 << i)) != 0, copy(i)) for i in range(len(specs))]))
    rows = some.select("ts", "value", F.explode(copies).alias("c")).select("ts", "value", "c.*")
    summed = rows.groupBy("_rule", *[f"_{k}" for k in keys], "ts").agg(*[FUNCTIONS[f](F.col("value")).alias(f) for f in functions])

    def results(s: Aggregation) -> Column:
        parts = [F.struct(F.lit(s.set_plugin).alias("plugin"), F.lit(s.label(f)).alias("plugin_instance"), F.lit(f).alias("function"), F.col(f).alias("value")) for f in s.functions]
        return F.array(*parts)

    listed, kind = F.lit(None), F.col("_type") if "type" in keys else F.lit(None).cast("string")
    for i, s in enumerate(specs):
        listed = F.when(F.col("_rule") == i, results(s)).otherwise(listed)
        if fixed[i]:
            kind = F.when(F.col("_rule") == i, F.lit(s.type)).otherwise(kind)
    shown = [k for k in keys if k not in ("plugin", "plugin_instance", "type")]
    out = summed.select(*[F.col(f"_{k}").alias(k) for k in shown], "ts", kind.alias("type"), F.explode(listed).alias("r"))
    return out.select(*shown, "ts", "type", "r.plugin", "r.plugin_instance", "r.function", "r.value")


def as_points(aggregated: DataFrame, measurement: Column) -> DataFrame:
    """Aggregates as storable points (identifier parts become the name)."""
    return aggregated.select(
        measurement.alias("measurement"),
        *(["host"] if "host" in aggregated.columns else []),
        F.create_map().cast(TAGS).alias("tags"),
        "ts",
        F.lit("gauge").alias("ds_type"),
        "value",
    )
