"""The continuous forms of the operators, on Structured Streaming.

Where Spark allows the same plan on a stream, the batch function is reused as it
is; only rates need a state of their own, because ``lag`` does not exist there.
State and progress live in the query's checkpoint, so a lost executor or a
restarted driver goes on from the last finished batch.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyflow.definitions import Definition, MathEntry
from tallyflow.model import TAGS, epoch_seconds, has_column, series_hashes, tag_columns, with_series
from tallyflow.operators import extract as E
from tallyflow.operators.metric_math import apply_math
from tallyflow.operators.rates import RESET_POLICIES, counters_and_gauges, rate
from tallyflow.operators.rollup import DEFAULT_INTERVAL, DEFAULT_PERIODS, Rollup, rollup, rollup_many
from tallyflow.operators.summary import latest
from tallyflow.sources.keyed_table import BUCKET, KeyedTable, job_of
from tallyflow.sources.points import in_range, read_points, upsert_rollup, write_points

# The state function travels with the query, so workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_extract(snapshots: DataFrame, catalog: Definition | Mapping[str, Definition], **options) -> DataFrame:
    """Points from a stream of snapshots; extraction keeps no state."""
    return E.extract(snapshots, catalog, **options)


def stream_rollup(
    points: DataFrame,
    measurement: str,
    tags: Sequence[str],
    *,
    interval: int = DEFAULT_INTERVAL,
    periods: int = DEFAULT_PERIODS,
    where: Column | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """The standing rollup.  A window is emitted once, when the watermark has
    passed its end; points that come later than that are dropped.  The default
    delay is one window."""
    delay = watermark or f"{interval * periods} seconds"
    timed = points.withWatermark("ts", delay)
    return rollup(timed, measurement, tags, interval=interval, periods=periods, where=where)


def stream_math(
    points: DataFrame,
    entries: Sequence[MathEntry],
    by: Sequence[str] | None = None,
    *,
    interval: int = DEFAULT_INTERVAL,
    watermark: str | None = None,
) -> DataFrame:
    """Derived points; both operands must fall into the same collect interval."""
    timed = points.withWatermark("ts", watermark or f"{interval} seconds")
    return apply_math(timed, entries, by, window=f"{interval} seconds")


#: Hashes that stand for a series in tables and states of last readings.
_SERIES = ["_key", "_key_too"]
#: The last readings of a bucket's series, one element for each.
_LAST = {"_key": "int64", "_key_too": "int64", "last_value": "float64", "last_at": "float64"}
_RATE_STATE = T.StructType(
    [T.StructField(n, T.ArrayType(T.LongType() if kind == "int64" else T.DoubleType())) for n, kind in _LAST.items()]
)


def stream_rate(
    points: DataFrame,
    by: Sequence[str] | None = None,
    *,
    on_reset: str = "keep",
    first_value: float | None = None,
    interval: float = 60.0,
    watermark: str | None = None,
    ttl_seconds: int | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """Per-second rates of counters, with the last reading kept per series.

    Series are dealt to ``buckets`` by a hash, and a bucket's series go through Python together, so a batch costs what its
    rows cost and nothing for each series.  A bucket's state is the last readings of all its series; it is written anew
    in a batch that has points of any of them.  The number of buckets must stay the same for a checkpoint.

    As in ``rate``, only ``derive`` points that do not reset when read are
    counters; all others pass through, and a ``first_value`` column gives a new
    series its first rate.  With ``ttl_seconds`` a series that is silent for so
    long in event time is forgotten, so jobs that come and go do not pile up; if
    it returns it counts as new, which the batch form does not do.  Readings older
    than the last one seen, or than the watermark (by default ten collect intervals
    behind), are dropped.  A micro-batch holds at most what the source's trigger
    limit lets in, and that bounds what one series can bring at a time.
    """
    if on_reset not in RESET_POLICIES:
        raise ValueError(f"on_reset must be one of {RESET_POLICIES}")
    gauges = None
    counters = points
    if has_column(points, "ds_type"):
        is_counter = F.col("ds_type") == "derive"
        if has_column(points, "interval_gauge"):
            is_counter &= ~F.coalesce(F.col("interval_gauge"), F.lit(False))
        is_counter = F.coalesce(is_counter, F.lit(False))
        counters, gauges = points.where(is_counter), points.where(~is_counter)
    counters = counters.withWatermark("ts", watermark or f"{int(10 * interval)} seconds")
    known_first = F.col("first_value").cast("double") if has_column(points, "first_value") else F.lit(None).cast("double")
    if first_value is not None:
        known_first = F.lit(float(first_value))
    if by is not None:
        keyed = counters.select(*tag_columns(counters, by), "ts", "value", known_first.alias("first"))
        names = list(by)
    else:
        entries = F.array_sort(F.map_entries(F.coalesce("tags", F.create_map().cast(TAGS))))
        tags = F.to_json(F.map_from_entries(entries)).alias("_tags")
        keyed = counters.select("measurement", "host", tags, "ts", "value", known_first.alias("first"))
        names = ["measurement", "host", "_tags"]
    readings = keyed.select(
        *[F.col(n).cast("string").alias(n) for n in names], "ts", epoch_seconds("ts").alias("at"), "value", "first"
    )

    hashes = [c.alias(n) for c, n in zip(series_hashes(readings, names), _SERIES)]
    dealt = readings.select("*", *hashes).withColumn(BUCKET, F.pmod("_key", F.lit(buckets)))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.DataFrame(dict(zip(_LAST, state.get)) if state.exists else {n: [] for n in _LAST}).astype(_LAST)
        touched = last.iloc[:0]
        if not state.hasTimedOut:
            rows = pd.concat([b[[*names, *_SERIES, "at", "value", "first"]] for b in batches])
            touched = rows[_SERIES].drop_duplicates()
            rows = rows.merge(last.assign(seen=True), on=_SERIES, how="left")
            rows = rows[rows["seen"].isna() | (rows["at"] > rows["last_at"])].sort_values([*_SERIES, "at", "value"])
            if len(rows):
                rate = _rates(rows, on_reset, interval)
                newest = rows.drop_duplicates(_SERIES, keep="last")[[*_SERIES, "value", "at"]].set_axis([*_LAST], axis=1)
                last = pd.concat([last, newest]).drop_duplicates(_SERIES, keep="last").astype(_LAST)
                known = ~np.isnan(rate)
                yield rows.loc[known, [*names, "at"]].assign(value=rate[known])
        if ttl_seconds is not None:
            # A series with points in this batch stays; of the others those that were silent for too long go.
            now, until = state.getCurrentWatermarkMs(), (last["last_at"] + ttl_seconds) * 1000
            here = pd.MultiIndex.from_frame(last[_SERIES]).isin(pd.MultiIndex.from_frame(touched[_SERIES]))
            stays = here | ~(np.floor(until) < now)
            last, until = last[stays], until[stays]
        if len(last):
            state.update(tuple(last[n].tolist() for n in _LAST))
            if ttl_seconds is not None and until.notna().any():
                state.setTimeoutTimestamp(max(int(until.min()), now + 1))
        elif state.exists:
            state.remove()

    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names],
                           T.StructField("at", T.DoubleType()), T.StructField("value", T.DoubleType())])
    timeout = GroupStateTimeout.NoTimeout if ttl_seconds is None else GroupStateTimeout.EventTimeTimeout
    rated = dealt.groupBy(BUCKET).applyInPandasWithState(step, schema, _RATE_STATE, "append", timeout)
    ts = F.timestamp_micros(F.round(F.col("at") * F.lit(1e6)).cast("bigint")).alias("ts")
    if by is not None:
        rated = rated.select(*names, ts, "value")
        passed = None if gauges is None else gauges.select(*tag_columns(gauges, by), "ts", "value")
    else:
        rated = rated.select(
            "measurement", "host", F.from_json("_tags", TAGS).alias("tags"), ts, F.lit("derive").alias("ds_type"), "value"
        )
        passed = None if gauges is None else gauges.select(*rated.columns)
    return rated if passed is None else rated.unionByName(passed)


def _rates(rows: pd.DataFrame, on_reset: str, interval: float):
    """Rates of sorted readings of some series beside what was known of these before; nan where there is none."""
    one, two = (rows[n].to_numpy() for n in _SERIES)
    begins = np.ones(len(rows), dtype=bool)
    begins[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    at, value = rows["at"].to_numpy("float64"), rows["value"].to_numpy("float64")
    delta = value - np.where(begins, rows["last_value"], np.roll(value, 1))
    elapsed = at - np.where(begins, rows["last_at"], np.roll(at, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = np.where(elapsed == 0, np.nan, delta / elapsed)
        if on_reset == "null":
            rate = np.where(delta < 0, np.nan, rate)
        elif on_reset == "zero_base":
            rate = np.where(delta < 0, value / elapsed, rate)
    first = rows["first"].to_numpy("float64")
    return np.where(begins & rows["seen"].isna() & ~np.isnan(first), (value - first) / interval, rate)


def append_to_table(stream: DataFrame, path: str, checkpoint: str, *, partition_by: Sequence[str] = (), once: bool = False) -> StreamingQuery:
    """Append a stream to a Parquet table; ``once`` stops when the input is read."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_latest(
    points: DataFrame, by: Sequence[str], path: str, checkpoint: str, *, once: bool = False, buckets: int = 64
) -> StreamingQuery:
    """Keep a table with the newest point of every series (see ``KeyedTable``).

    Each batch is reduced to one row per series and merged into the buckets that it falls into, so a batch's cost follows
    the batch and not the table.  Several streams may keep one table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, keys = with_series(batch, list(by))
        fresh = latest(rows.select(*keys, "ts", "value"), keys)
        KeyedTable(spark, path, buckets).merge(fresh, keys, lambda both: latest(both, keys), job_of(spark, checkpoint), number)

    return _each_batch(points, merge, checkpoint, once)


def latest_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the table ``stream_latest`` keeps."""
    return KeyedTable(spark, path).read()


def _each_batch(stream: DataFrame, do, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_rollups(
    points: DataFrame,
    rollups: Iterable[Rollup],
    path: str,
    checkpoint: str,
    *,
    interval: int = DEFAULT_INTERVAL,
    periods: int = DEFAULT_PERIODS,
    watermark: str | None = None,
    once: bool = False,
) -> StreamingQuery:
    """All standing rollups of a catalog as one stream into the rollup table.

    One fan-out to all rollups, one shuffle and one state store.  A window is written when the watermark has passed its
    end (by default one window behind), in the shape that the panels read.  A batch whose windows the table does not have
    is appended; one that is repeated, after a failure or from a new checkpoint, takes the place of its windows.
    """
    timed = points.withWatermark("ts", watermark or f"{interval * periods} seconds")
    rolled = rollup_many(timed, rollups, interval=interval, periods=periods)

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # it is looked at more than once, and state must not be
        try:
            if not held.isEmpty():
                upsert_rollup(batch.sparkSession, held, path)
        finally:
            held.unpersist()

    return _each_batch(rolled, write, checkpoint, once)


def stream_points(
    points: DataFrame,
    path: str,
    rollups: Iterable[Rollup],
    rollup_path: str,
    clock: str,
    checkpoint: str,
    *,
    delay: int = DEFAULT_INTERVAL * DEFAULT_PERIODS,
    interval: int = DEFAULT_INTERVAL,
    periods: int = DEFAULT_PERIODS,
    once: bool = False,
) -> StreamingQuery:
    """Store points as they come, and keep their rollups right when some come late.

    A window is closed once a point has come that is ``delay`` seconds or more behind its end.  Each batch is stored
    first.  Then two kinds of windows are computed from the stored points and put in place in the rollup table: those that
    the batch closes, and those closed before in which it has points, its late ones.  So a late point costs a new
    computation of its window, and none is dropped; ``delay`` decides when a window is first shown, not what it holds.

    ``clock`` is a table with the newest time seen.  A repeated batch finds there what it knew, and writes the same files
    and windows again.
    """
    specs, width = list(rollups), interval * periods

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        job, held = job_of(spark, checkpoint), batch.persist()
        try:
            newest = held.agg(F.max(F.unix_seconds("ts"))).first()[0]
            if newest is None:
                return
            write_points(held, f"{path}/job={job}/batch={number}", mode="overwrite")
            before, now = _tick(KeyedTable(spark, clock, 1), newest, job, number)
            windows = _closed_windows(held, before, now, width, delay)
            first, last = windows.agg(F.min("_window"), F.max("_window")).first()
            if first is None:
                return
            stored = in_range(read_points(spark, path).drop("job", "batch"), "ts", _utc(first), _utc(last + width))
            of_windows = stored.withColumn("_window", _window(width)).join(windows, "_window", "left_semi").drop("_window")
            upsert_rollup(spark, rollup_many(of_windows, specs, interval=interval, periods=periods), rollup_path)
        finally:
            held.unpersist()

    return _each_batch(points, store, checkpoint, once)


def stored_points_table(spark: SparkSession, path: str) -> DataFrame:
    """The points that ``stream_points`` has stored."""
    return read_points(spark, path).drop("job", "batch")


def _window(width: int) -> Column:
    return F.floor(F.unix_seconds("ts") / F.lit(width)) * F.lit(width)


def _utc(seconds: int) -> str:
    return f"{dt.datetime.fromtimestamp(seconds, dt.timezone.utc):%Y-%m-%d %H:%M:%S}"


def _closed_windows(points: DataFrame, before: int | None, now: int, width: int, delay: int) -> DataFrame:
    """(_window) of closed windows that the points fall into, and of all that closed since ``before``."""
    closed_upto = (now - delay) // width * width - width  # start of the last closed window
    touched = points.select(_window(width).alias("_window")).where(F.col("_window") <= closed_upto)
    if before is None:
        return touched.distinct()
    since = (before - delay) // width * width
    closing = points.sparkSession.range(since, closed_upto + 1, width).select(F.col("id").alias("_window"))
    return touched.union(closing).distinct()


def _tick(clock: KeyedTable, newest: int, job: str, batch: int) -> tuple[int | None, int]:
    """The newest time seen before this batch and with it; a repeated batch gets what it got before."""
    spark = clock.spark
    rows = lambda *r: spark.createDataFrame([("clock", *r)], "name string, now bigint, before bigint")
    known = clock.read().first() if clock.manifest().folders else None
    if clock.manifest().jobs.get(job, -1) >= batch:
        return known["before"], known["now"]
    before = known["now"] if known else None
    now = max(newest, before) if before is not None else newest

    clock.merge(rows(now, before), ["name"], lambda both: rows(now, before), job, batch)
    return before, now


def stream_rates(
    points: DataFrame,
    path: str,
    state: str,
    checkpoint: str,
    by: Sequence[str] | None = None,
    *,
    on_reset: str = "keep",
    first_value: float | None = None,
    interval: float = 60.0,
    chunk: int | None = 3600,
    forget_after: float | None = None,
    once: bool = False,
    buckets: int = 64,
) -> StreamingQuery:
    """Per-second rates of counters, written to a table with all columns that the points have.

    The last reading of every series is kept in a table (see ``KeyedTable``) that can be read at any time.  A batch meets
    the last readings of its own series there and is then rated as a table is, so a hot series is split over tasks and no
    series goes through Python.  Readings not after the last one are dropped; other points pass through.  ``forget_after``
    makes a series that was silent for so many seconds a new one; so jobs that come and go can be forgotten.

    A batch's rates are one folder that a repeated batch writes anew, before the last readings are committed; so every
    reading is rated once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table, job = KeyedTable(spark, state, buckets), job_of(spark, checkpoint)
        manifest = table.manifest()
        if manifest.jobs.get(job, -1) >= number:
            return
        counters, gauges = counters_and_gauges(batch)
        rows = counters.select("*", *[c.alias(n) for c, n in zip(series_hashes(counters, by), _SERIES)])
        rows = table.bucketed(rows, _SERIES, manifest).persist()
        try:
            touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # at most one row for each bucket
            known = table.rows_of(manifest, touched)
            rows = rows.drop(BUCKET)
            if known is not None:
                last = known.select(*_SERIES, F.col("ts").alias("_last"))
                rows = rows.join(last, _SERIES, "left").where("_last IS NULL OR ts > _last").drop("_last")
            given = rows.withColumn("_known", F.lit(False))
            if known is not None:
                given = given.unionByName(known.withColumn("_known", F.lit(True)))
            rated = rate(
                given, _SERIES, on_reset=on_reset, first_value=first_value, interval=interval, chunk=chunk, forget_after=forget_after
            )
            out = rated.where(~F.col("_known")).select(*batch.columns)
            out = out if gauges is None else out.unionByName(gauges)
            out.write.mode("overwrite").parquet(f"{path}/job={job}/batch={number}")
            table.merge(_last_readings(rows), _SERIES, _last_readings, job, number)
        finally:
            rows.unpersist()

    return _each_batch(points, merge, checkpoint, once)


def _last_readings(rows: DataFrame) -> DataFrame:
    """Each series' last row; of several at one time the one of greatest value."""
    newest = F.max_by(F.struct(*[c for c in rows.columns if c not in _SERIES]), F.struct("ts", "value")).alias("r")
    return rows.groupBy(*_SERIES).agg(newest).select("r.*", *_SERIES)


def rated_table(spark: SparkSession, path: str) -> DataFrame:
    """What ``stream_rates`` has written."""
    return spark.read.parquet(path).drop("job", "batch")
