"""Small statistics texts in the layouts the systems print."""


def counter_file(counts: dict[str, int], unit: str = "reqs") -> str:
    lines = ["snapshot_time             1420966209.227519 secs.usecs"]
    lines += [f"{name:<25} {n} samples [{unit}]" for name, n in counts.items()]
    return "\n".join(lines) + "\n"


def timed_file(counts: dict[str, tuple], unit: str = "usecs") -> str:
    lines = ["snapshot_time             1420966209.227519 secs.usecs"]
    lines += [f"{name:<25} {v[0]} samples [{unit}] " + " ".join(map(str, v[1:])) for name, v in counts.items()]
    return "\n".join(lines) + "\n"


def quota_file(usage: dict[str, tuple[int, int]], kind: str = "usr") -> str:
    out = [f"{kind}_accounting:"]
    for who, (inodes, kbytes) in usage.items():
        out.append(f"- id:      {who}")
        out.append(f"  usage:   {{ inodes: {inodes:>20}, kbytes: {kbytes:>20} }}")
    return "\n".join(out) + "\n"


def mdt_jobs(jobs: dict[str, dict[str, int]]) -> str:
    out = ["job_stats:"]
    for job, ops in jobs.items():
        out += [f"- job_id:          {job}", "  snapshot_time:   1496031338"]
        out += [f"  {op + ':':<16} {{ samples: {n:>11}, unit:  reqs }}" for op, n in ops.items()]
    return "\n".join(out) + "\n"


def ost_jobs(jobs: dict[str, dict]) -> str:
    out = ["job_stats:"]
    for job, ops in jobs.items():
        out += [f"- job_id:          {job}", "  snapshot_time:   1495525343"]
        for op, v in ops.items():
            if isinstance(v, tuple):
                n, low, high, total = v
                body = f"samples: {n:>11}, unit: bytes, min:{low:>8}, max:{high:>8}, sum:{total:>16}"
            else:
                body = f"samples: {v:>11}, unit:  reqs"
            out.append(f"  {op + ':':<16} {{ {body} }}")
    return "\n".join(out) + "\n"


def bulk_file(sections: dict[str, dict[str, tuple]]) -> str:
    out = ["snapshot_time:         1420966209.2 (secs.usecs)", ""]
    out += ["                           read      |     write"]
    for header, rows in sections.items():
        out.append(f"{header}        rpcs  % cum % |  rpcs        % cum %")
        for b, (r, rp, rc, w, wp, wc) in rows.items():
            out.append(f"{b}:\t\t {r} {rp:>3} {rc:>3}   | {w:>4} {wp:>3} {wc:>3}")
        out.append("")
    return "\n".join(out) + "\n"


def disk_report(title: str, rates: dict, latencies: dict, sizes: dict, depths=(), unmap: dict | None = None) -> str:
    """``rates``: disk -> (cells of controller 0, cells of controller 1)."""
    out = [f"{title} Disk Counters:  Elapsed time = 1.244 seconds", "  Idx  IOs/sec  KiB/sec ...", "-" * 40]
    for disk, (a, b) in rates.items():
        out.append(f"{disk:>5}" + "".join(f"{x:>9}" for x in a) + "|" + "".join(f"{x:>8}" for x in b) + "|")
    for rw in ("Read", "Write"):
        out += ["", f"{title} Disk {rw} Latency:  Elapsed time = 1.245 seconds", "  Idx      Avg ...", "-" * 40]
        out += [f"{disk:>5}" + "".join(f"{x:>9}" for x in row) + " " for disk, row in latencies[rw].items()]
    for rw in ("Read", "Write"):
        out += ["", f"{title} Disk {rw} IO Size:  Elapsed time = 1.245 seconds", "  Idx   <=4KiB ...", "-" * 40]
        out += [f"{disk:>5}" + "".join(f"{x:>9}" for x in row) + " " for disk, row in sizes[rw].items()]
    for table in depths:
        out += ["", "Virtual Disk Qdepth:  Elapsed time = 1.245 seconds", "  Idx       [1] ...", "-" * 40]
        out += [f"{disk:>5}" + "".join(f"{x:>9}" for x in row) + " " for disk, row in table.items()]
    if unmap:
        out += ["", f"{title} Disk Unmap:", "  Idx  Unmap Count Unmap Blocks| Unmap Count Unmap Blocks|", "-" * 40]
        for disk, (a, b) in unmap.items():
            out.append(f"{disk:>5} {a[0]:>12} {a[1]:>12}| {b[0]:>11} {b[1]:>12}|")
    return "\n".join(out) + "\n"
