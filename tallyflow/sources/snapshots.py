"""Text snapshots from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.definitions import Definition
from tallyflow.functions.text import quoted
from tallyflow.model import SNAPSHOT_SCHEMA, TAGS


def read_snapshots(
    spark: SparkSession,
    root: str,
    *,
    host: str | None = None,
    at: str | None = None,
    definition: Definition | None = None,
    extra_tags: dict[str, str] | None = None,
    layout: str | None = None,
) -> DataFrame:
    """Every file under ``root`` as one snapshot row.

    The path is the file's path below the root, as the definition names it.
    ``layout`` is a regex over that path with named groups ``host`` and ``path``
    for trees that hold many hosts.  The collection time is the file's own
    unless ``at`` is given.  With a definition, files whose names it never uses
    are not listed, let alone read.
    """
    files = _reader(spark.read, definition).text(root).select(
        F.col("value").alias("content"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_modification_time").alias("_modified"),
    )
    return _named(files, root, host=host, at=at, extra_tags=extra_tags, layout=layout)


def stream_snapshots(
    spark: SparkSession,
    root: str,
    *,
    host: str | None = None,
    definition: Definition | None = None,
    extra_tags: dict[str, str] | None = None,
    layout: str | None = None,
    max_files: int = 10000,
) -> DataFrame:
    """The same rows, continuously, as new files appear below the root; with a definition only files it uses."""
    files = _reader(spark.readStream, definition).option("maxFilesPerTrigger", max_files).text(root).select(
        F.col("value").alias("content"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_modification_time").alias("_modified"),
    )
    return _named(files, root, host=host, at=None, extra_tags=extra_tags, layout=layout)


def _reader(reader, definition: Definition | None):
    """A reader of whole files that lists only names which the definition uses."""
    reader = reader.option("wholetext", True).option("recursiveFileLookup", True)
    names = [] if definition is None else definition.file_names()
    if names and all("/" not in n and "\n" not in n and "|" not in n for n in names):
        reader = reader.option("pathGlobFilter", "{" + ",".join(names) + "}")
    return reader


def _named(files: DataFrame, root: str, *, host, at, extra_tags, layout) -> DataFrame:
    base = root.rstrip("/").split("://", 1)[-1]
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("_file", r"\+", "%2B")), r"^[a-z0-9]+:/*", "/")
    below = F.regexp_replace(plain, "^.*?" + quoted("/" + base.strip("/")), "")
    path = below if layout is None else F.regexp_extract(below, layout, 2)
    name = F.lit(host) if host is not None or layout is None else F.regexp_extract(below, layout, 1)
    tags = F.create_map(*[F.lit(x) for kv in (extra_tags or {}).items() for x in kv]).cast(TAGS)
    return files.select(
        name.cast("string").alias("host"),
        path.alias("path"),
        (F.lit(at).cast("timestamp") if at is not None else F.col("_modified")).alias("collected_at"),
        "content",
        tags.alias("extra_tags"),
    )


def as_snapshots(table: DataFrame) -> DataFrame:
    """A table of snapshots with its columns in the expected types."""
    have = set(table.columns)
    missing = {"path", "content"} - have
    if missing:
        raise ValueError(f"snapshot table lacks {sorted(missing)}")
    columns = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SNAPSHOT_SCHEMA
    ]
    extra = [F.col(c) for c in table.columns if c not in SNAPSHOT_SCHEMA.fieldNames()]
    return table.select(*columns, *extra)
