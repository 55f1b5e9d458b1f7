"""Time-and-tag rollups, one at a time or a whole catalog in one pass."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.model import TAGS, tag, tag_columns

# Fixed value: how the measurement of a rollup is named.
ROLLUP_PREFIX = "cqm_"

DEFAULT_INTERVAL = 60
DEFAULT_PERIODS = 4


def rollup_name(measurement: str, tags: Iterable[str]) -> str:
    """``cqm_<measurement>-<tag>-<tag>``, tags sorted so the name is unique."""
    return "-".join([ROLLUP_PREFIX + measurement, *sorted(tags)])


@dataclass(frozen=True)
class Rollup:
    """One standing query: sum over series, averaged over the periods."""

    measurement: str
    tags: tuple[str, ...]
    #: (tag, allowed values): only those points are summed
    only: tuple[str, tuple[str, ...]] | None = None
    #: tag that must be present
    present: str | None = None

    @property
    def name(self) -> str:
        return rollup_name(self.measurement, self.tags)

    def filter(self, points: DataFrame) -> Column:
        """The points of the measurement this rollup sums."""
        keep = F.lit(True)
        if self.only:
            keep &= tag(points, self.only[0]).isin(*self.only[1])
        if self.present:
            keep &= tag(points, self.present) != ""
        return keep


@dataclass
class RollupRegistry:
    """Rollups by name.  The name ignores the filter, so two rollups that differ
    only in their filter would write into each other; that is refused."""

    rollups: dict[str, Rollup] = field(default_factory=dict)

    def register(self, rollup: Rollup, *, replace: bool = False) -> Rollup:
        known = self.rollups.get(rollup.name)
        if known is not None and known != rollup and not replace:
            raise ValueError(f"{rollup.name} is already registered with another filter")
        self.rollups[rollup.name] = rollup
        return rollup

    def __iter__(self):
        return iter(self.rollups.values())

    def __len__(self) -> int:
        return len(self.rollups)


def rollup(
    points: DataFrame,
    measurement: str,
    tags: Sequence[str],
    *,
    interval: int = DEFAULT_INTERVAL,
    periods: int = DEFAULT_PERIODS,
    where: Column | None = None,
) -> DataFrame:
    """``sum(value) / periods`` per tag set and epoch-aligned window.

    With one point per collect interval this is the time average of the sum over
    series.  It divides by ``periods`` and not by the points seen, so missing
    points lower the result.  Partial sums are built before the shuffle, so a hot
    tag set costs no more than any other.
    """
    source = points.where(F.col("measurement") == measurement) if "measurement" in points.columns else points
    if where is not None:
        source = source.where(where)
    grouped = source.groupBy(
        F.window("ts", f"{interval * periods} seconds").alias("w"), *tag_columns(source, tags)
    )
    return grouped.agg((F.sum("value") / F.lit(periods)).alias("sum")).select(
        F.lit(rollup_name(measurement, tags)).alias("measurement"),
        *tags,
        F.col("w.start").alias("window_start"),
        "sum",
    )


def rollup_many(
    points: DataFrame,
    rollups: Iterable[Rollup],
    *,
    interval: int = DEFAULT_INTERVAL,
    periods: int = DEFAULT_PERIODS,
) -> DataFrame:
    """All rollups of a catalog from one scan and one shuffle.

    A point is repeated once per rollup that wants it, with the tags that rollup
    groups by; partial aggregation folds the copies before they are shuffled.
    """
    specs = list(rollups)
    measurements = sorted({r.measurement for r in specs})
    keys = sorted({t for r in specs for t in r.tags})
    source = points.where(F.col("measurement").isin(*measurements))

    shown = {k: tag(source, k).cast("string").alias(k) for k in keys}
    absent = {k: F.lit(None).cast("string").alias(k) for k in keys}

    def copy(number: int, r: Rollup) -> Column:
        made = F.struct(F.lit(number).alias("_rollup"), *[shown[k] if k in r.tags else absent[k] for k in keys])
        return F.when(r.filter(source), made) if r.only or r.present else made

    # Only the rollups of a point's own measurement are looked at.
    wanted = F.lit(None)
    for m in measurements:
        mine = [(i, r) for i, r in enumerate(specs) if r.measurement == m]
        listed = F.array(*[copy(i, r) for i, r in mine])
        if any(r.only or r.present for _, r in mine):
            listed = F.array_compact(listed)
        wanted = F.when(F.col("measurement") == m, listed).otherwise(wanted)
    copies = source.select("ts", "value", wanted.alias("_copies"))
    copies = copies.select("ts", "value", F.explode_outer("_copies").alias("c")).where(F.col("c").isNotNull())
    copies = copies.select("ts", "value", "c.*")
    window = F.window("ts", f"{interval * periods} seconds").alias("w")
    summed = copies.groupBy("_rollup", window, *keys).agg((F.sum("value") / F.lit(periods)).alias("sum"))
    names = F.array(*[F.lit(r.name) for r in specs])
    pairs: list[Column] = []
    for key in keys:
        pairs += [F.lit(key), F.col(key)]
    tags = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if keys else F.create_map().cast(TAGS)
    return summed.select(
        names[F.col("_rollup")].alias("measurement"),
        tags.alias("tags"),
        F.col("w.start").alias("window_start"),
        "sum",
    )
