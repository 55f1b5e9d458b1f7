"""Tag strings, size suffixes and user ids as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyflow.functions.text import literal
from tallyflow.model import TAGS


def parse_tags(text: Column) -> Column:
    """``"a=1 b=2"`` to a map; empty text and ``NA`` mean no tags."""
    clean = F.trim(text)
    none = F.create_map().cast(TAGS)
    return F.when(clean.isNull() | clean.isin("", "NA"), none).otherwise(
        F.str_to_map(clean, F.lit(" +"), F.lit("="))
    )


def size_order(bucket: Column) -> Column:
    """Number a bucket label stands for: ``64K`` is 65536, ``16`` is 16."""
    digits = F.regexp_extract(bucket, r"^([0-9]+)([KM]?)", 1)
    unit = F.regexp_extract(bucket, r"^([0-9]+)([KM]?)", 2)
    scale = F.when(unit == "K", F.lit(1024.0)).when(unit == "M", F.lit(1048576.0)).otherwise(F.lit(1.0))
    return digits.try_cast("double") * scale


def extended_fields(text: str, pattern: str, names: Sequence[str]) -> str:
    """Named groups of a second regex over an extracted field, as a SQL map.

    A field that does not match adds nothing.
    """
    rx = literal(pattern)
    pairs = ", ".join(f"{literal(name)}, regexp_extract({text}, {rx}, {i})" for i, name in enumerate(names, start=1))
    return f"CASE WHEN {text} RLIKE {rx} THEN map({pairs}) ELSE CAST(map() AS map<string,string>) END"


def job_owner(job_id: str = "job_id") -> Column:
    """``procname`` and ``uid`` of a job id column written as ``procname.uid``."""
    return F.expr(extended_fields(job_id, PROCNAME_UID, ["procname", "uid"]))


# Fixed value: how a job id is written when jobs are named by process and user.
PROCNAME_UID = r"^(.+)[.]([0-9]+)$"
