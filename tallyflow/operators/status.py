"""Host status, freshness and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.model import has_column, tag, tag_columns

GREEN, YELLOW, RED = "green", "yellow", "red"
MIB = 1024.0 * 1024.0
GIB = 1024.0 * MIB


@dataclass(frozen=True)
class StatusRule:
    """A metric is bad when it is below (or above) its limits.

    Points belong to it by their measurement, or by all parts of the identifier
    that ``match`` names, where points carry it.
    """

    metric: str
    warning: float
    critical: float
    above: bool = False
    match: tuple[tuple[str, str], ...] = ()

    def selects(self, points: DataFrame, metric: str) -> Column:
        named = tag(points, metric) == self.metric
        if not self.match or not all(has_column(points, part) for part, _ in self.match):
            return named
        return named | reduce(and_, [F.col(part) == wanted for part, wanted in self.match])


# Limits of the cluster status panel.
DEFAULT_RULES = (
    StatusRule("cpu_idle", warning=20.0, critical=5.0, match=(("plugin", "cpu"), ("type_instance", "idle"))),
    StatusRule("load", warning=5.0, critical=10.0, above=True,
               match=(("plugin", "load"), ("type_instance", "shortterm"))),
    StatusRule("memory_free", warning=1000 * MIB, critical=100 * MIB,
               match=(("plugin", "memory"), ("type_instance", "free"))),
    StatusRule("root_free", warning=10 * GIB, critical=1 * GIB,
               match=(("plugin", "df"), ("plugin_instance", "root"), ("type_instance", "free"))),
)


def host_status(
    points: DataFrame, rules: Sequence[StatusRule] = DEFAULT_RULES, *, metric: str = "measurement", host: str = "host"
) -> DataFrame:
    """Worst status of a host over its newest values.

    The newest value of every ruled metric is taken in one aggregate; a metric a
    host never reported does not count against it.
    """
    names = [r.metric for r in rules]
    chosen = [r.selects(points, metric) for r in rules]
    used = points.where(reduce(or_, chosen))
    newest = used.groupBy(F.col(host)).agg(
        *[F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col("ts"))).alias(r.metric)
          for r, mine in zip(rules, chosen)]
    )
    severities = []
    for r in rules:
        v = F.col(r.metric)
        bad, worse = (v > r.warning, v > r.critical) if r.above else (v < r.warning, v < r.critical)
        severities.append(F.when(worse, 2).when(bad, 1).otherwise(0))
    worst = F.greatest(*severities) if len(severities) > 1 else severities[0]
    status = F.when(worst == 2, RED).when(worst == 1, YELLOW).otherwise(GREEN)
    return newest.select(host, *names, status.alias("status"))


def newest_time(points: DataFrame, measurement: str, tags: Mapping[str, str] | None = None) -> DataFrame:
    """Time of the newest point of a measurement with the given tags (one row)."""
    found = points.where(F.col("measurement") == measurement)
    for name, wanted in (tags or {}).items():
        found = found.where(tag(found, name) == wanted)
    return found.agg(F.max("ts").alias("newest"))


def freshness(before: DataFrame, now: DataFrame, by: Sequence[str]) -> DataFrame:
    """Does the newest point of each series move forward between two looks?

    Both looks are put side by side in one aggregate, so nothing is joined.
    Series that only the first look saw are left out.
    """
    empty = F.lit(None).cast("timestamp")
    old = before.select(*tag_columns(before, by), F.col("ts").alias("before"), empty.alias("newest"))
    new = now.select(*tag_columns(now, by), empty.alias("before"), F.col("ts").alias("newest"))
    both = old.unionByName(new).groupBy(*by).agg(F.max("before").alias("before"), F.max("newest").alias("newest"))
    moved = F.col("before").isNull() | (F.col("newest") > F.col("before"))
    return both.where(F.col("newest").isNotNull()).select(*by, "before", "newest", moved.alias("fresh"))


# Capacity measurements every target must report.
EXPECTED = {
    "ost": (
        "ost_filesinfo_total", "ost_filesinfo_free", "ost_filesinfo_used",
        "ost_kbytesinfo_total", "ost_kbytesinfo_free", "ost_kbytesinfo_used",
    ),
    "mdt": ("mdt_filesinfo_total", "mdt_filesinfo_free", "mdt_filesinfo_used"),
}


def missing_series(points: DataFrame, targets: DataFrame, measurements: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Expected (target, measurement) pairs nothing was reported for.

    Each target is unfolded into its fixed list of measurements; what was seen is
    reduced to distinct pairs before the anti join, so neither side grows with
    the number of points.
    """
    expected = targets.select(*by, F.explode(F.array(*[F.lit(m) for m in measurements])).alias("measurement"))
    used = points.where(F.col("measurement").isin(*measurements))
    seen = used.select(*tag_columns(used, by), "measurement").distinct()
    return expected.join(seen, [*by, "measurement"], "left_anti")
