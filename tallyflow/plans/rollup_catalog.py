"""The standing rollups the panels read."""

from __future__ import annotations

from tallyflow.operators.rollup import Rollup, RollupRegistry

# Which measurements are rolled up by which tags.
OWNER_ROLLUPS = [(f"{target}_acct{kind}_samples", ("fs_name", "optype", f"{kind}_id"))
                 for target in ("mdt", "ost") for kind in ("user", "group", "project")]
BULK_ROLLUPS = [
    (f"ost_brw_stats_{kind}_samples", ("field", "fs_name", "size"))
    for kind in (
        "rpc_bulk", "page_discontiguous_rpc", "block_discontiguous_rpc", "fragmented_io",
        "io_in_flight", "io_time", "io_size",
    )
]
PLAIN_ROLLUPS = [
    ("exp_md_stats", ("exp_client", "fs_name")),
    ("mdt_jobstats_samples", ("fs_name", "job_id")),
    ("ost_stats_bytes", ("fqdn", "fs_name", "optype")),
    ("ost_stats_bytes", ("fs_name", "ost_index")),
    ("ost_stats_bytes", ("fqdn", "fs_name")),
    ("ost_stats_bytes", ("fs_name", "optype")),
    ("ost_kbytesinfo_used", ("fs_name", "optype")),
    ("ost_jobstats_bytes", ("fs_name", "job_id", "optype")),
    ("exp_ost_stats_bytes", ("exp_client", "fs_name", "optype")),
    ("md_stats", ("fs_name",)),
    ("md_stats", ("fs_name", "mdt_index")),
    ("md_stats", ("fs_name", "optype")),
    ("mdt_filesinfo_free", ("fs_name",)),
    ("mdt_filesinfo_used", ("fs_name",)),
    ("ost_kbytesinfo_free", ("fs_name",)),
    ("ost_kbytesinfo_used", ("fs_name",)),
]
TOTAL_BYTES = ("optype", ("sum_read_bytes", "sum_write_bytes"))
TOTAL_BYTES_ROLLUPS = [
    ("ost_jobstats_bytes", ("fs_name", "job_id")),
    ("ost_jobstats_bytes", ("fs_name", "job_id", "ost_index")),
]
#: These need a job id that names its user.
USER_ROLLUPS = [
    ("mdt_jobstats_samples", ("fs_name", "uid"), None),
    ("ost_jobstats_bytes", ("fs_name", "optype", "uid"), None),
    ("ost_jobstats_bytes", ("fs_name", "uid"), TOTAL_BYTES),
    ("ost_jobstats_bytes", ("fs_name", "ost_index", "uid"), TOTAL_BYTES),
]


def catalog(*, jobs_name_users: bool = True) -> RollupRegistry:
    """All standing rollups; the per-user ones only when job ids name users."""
    registry = RollupRegistry()
    for measurement, tags in OWNER_ROLLUPS + PLAIN_ROLLUPS + BULK_ROLLUPS:
        registry.register(Rollup(measurement, tags))
    for measurement, tags in TOTAL_BYTES_ROLLUPS:
        registry.register(Rollup(measurement, tags, only=TOTAL_BYTES))
    if jobs_name_users:
        for measurement, tags, only in USER_ROLLUPS:
            registry.register(Rollup(measurement, tags, only=only, present="uid"))
    return registry
