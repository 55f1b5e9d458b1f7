"""Infiniband port counters, one number per file."""

from __future__ import annotations

from tallyflow.definitions import Definition, Entry, Field, Item

# Counter files of a port.
COUNTERS = (
    "excessive_buffer_overrun_errors", "link_downed", "link_error_recovery", "local_link_integrity_errors",
    "port_rcv_constraint_errors", "port_rcv_data", "port_rcv_errors", "port_rcv_packets",
    "port_rcv_remote_physical_errors", "port_xmit_constraint_errors", "port_xmit_data", "port_xmit_discards",
    "port_xmit_packets", "symbol_error", "VL15_dropped", "port_rcv_switch_relay_errors",
)
UNTYPED = "port_rcv_switch_relay_errors"
FOLDER = "/sys/class/infiniband/{driver_type}_{driver_index}/ports/{port_number}/counters"


def definition() -> Definition:
    place = "driver_index=${subpath:driver_index} port_number=${subpath:port_number}"
    typed = "driver_type=${subpath:driver_type} " + place
    entries = []
    for counter in COUNTERS:
        item = Item(
            name=counter,
            pattern="(.+)",
            captures=("number",),
            fields=(Field(1, counter, ds_type="derive"),),
            measurement=counter,
            tags=place if counter == UNTYPED else typed,
            plugin="${subpath:driver_type}-${subpath:driver_index}-${subpath:port_number}",
            plugin_instance="countersinfo",
        )
        entries.append(Entry(f"{FOLDER}/{counter}", (item,)))
    return Definition("infiniband-0.1", tuple(entries))
