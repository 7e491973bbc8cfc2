"""Words and units for the catalog: what each measurement and field holds.

A field's text is put together from the words of its name, so that a table of a few dozen words covers all fields;
what a name does not say is given in full. Fixed values: the units.
"""

from __future__ import annotations

#: What a measurement holds, and how often it changes.
MEASUREMENT_TEXTS = {
    "system_identity": ("Model, serial number, software and management addresses of a device", "rarely"),
    "system_uptime": ("Time since the device last started", "each collection"),
    "content_versions": ("Versions of installed content packages", "with content updates"),
    "mac_count": ("Hardware addresses that a device has been assigned", "rarely"),
    "cpu_usage": ("Share of management processor time by what it was spent on", "each collection"),
    "memory_usage": ("Main memory of the management plane by use", "each collection"),
    "swap_usage": ("Swap space of the management plane by use", "each collection"),
    "load_average": ("Mean number of runnable tasks over three spans", "each collection"),
    "task_stats": ("Number of tasks by state", "each collection"),
    "disk_usage": ("Size and fill of each mounted file system", "each collection"),
    "ha_status": ("State of a high-availability pair and whether its members match", "each collection"),
    "cpu_dataplane_tasks": ("Load of each dataplane by kind of task, and of its buffers", "each collection"),
    "cpu_dataplane_cores": ("Load of each core of a dataplane", "each collection"),
    "env_thermal": ("Temperature sensors with their limits", "each collection"),
    "env_fan": ("Fan speeds with their limits", "each collection"),
    "env_power": ("Voltage rails with their limits", "each collection"),
    "env_power_supply": ("Power supply units and whether they are in place", "each collection"),
    "interface_info": ("Link state and settings of physical ports", "each collection"),
    "interface_logical": ("Zone, address and forwarding of logical interfaces", "each collection"),
    "interface_counters_hw": ("Counters of physical ports since they were last reset", "each collection"),
    "interface_counters_logical": ("Counters of logical interfaces since they were last reset", "each collection"),
    "bgp_summary": ("Number of BGP peers and prefixes of a router", "each collection"),
    "bgp_peer": ("State and message counts of each BGP peer", "each collection"),
    "bgp_path_monitor": ("Monitored static paths and the targets they are tested with", "each collection"),
    "gp_gateway": ("Users and tunnels of remote-access gateways", "each collection"),
    "gp_portal": ("Connections to remote-access portals", "each collection"),
    "vpn_flows": ("Number of VPN flows by kind", "each collection"),
    "ipsec_flow": ("State and end points of each IPsec flow", "each collection"),
    "vpn_tunnel": ("Configured IPsec tunnels and their proposals", "rarely"),
    "vpn_gateway": ("Configured IKE gateways and their proposals", "rarely"),
    "ipsec_sa": ("Security associations and how long they still hold", "each collection"),
    "routing_table_counts": ("Number of routes by protocol", "each collection"),
    "static_routes": ("Configured static routes", "rarely"),
}
#: Words of names that are not said as they are written.
WORDS = {
    "sw": "software", "vm": "virtual machine", "mem": "memory", "ip": "IP", "ipv6": "IPv6", "mac": "hardware address", "vsys": "virtual system",
    "dhcp": "DHCP", "dhcp6": "DHCPv6", "app": "application", "av": "antivirus", "wf": "private WildFire", "rt": "real time", "url": "URL",
    "db": "database", "logdb": "log database", "cpu": "processor", "iowait": "waiting for disks", "buff": "buffer", "cnt": "count",
    "preempt": "preemption", "nonfunc": "not functional", "dlp": "data loss prevention", "nd": "network discovery", "oc": "OpenConfig",
    "iot": "IoT", "vpnclient": "VPN client", "gpclient": "remote-access client", "conn": "connection", "ha1": "HA1", "ha2": "HA2", "ha": "HA",
    "mgmt": "management", "ctrl": "control", "nac": "access control", "np": "network processor", "dfa": "pattern matching", "aho": "string matching",
    "pktlog": "packet log", "fpga": "FPGA", "avg": "mean", "num": "number of", "temp": "temperature", "min": "lowest allowed",
    "max": "highest allowed", "rpm": "revolutions", "fec": "forward error correction", "fwd": "forwarding", "rx": "received", "tx": "sent",
    "ibytes": "received bytes", "obytes": "sent bytes", "ipackets": "received packets", "opackets": "sent packets", "ierrors": "receive errors",
    "idrops": "dropped received packets", "ifwderrors": "forwarding errors", "flowstate": "packets without a flow", "noroute": "packets without a route",
    "noarp": "packets without an ARP entry", "noneigh": "packets without a neighbour", "neighpend": "packets waiting for a neighbour",
    "nomac": "packets without a hardware address", "zonechange": "packets that changed the zone", "land": "land attacks", "pod": "pings of death",
    "teardrop": "teardrop attacks", "ipspoof": "forged IP addresses", "macspoof": "forged hardware addresses", "icmp": "ICMP", "frag": "fragments",
    "l2": "layer 2", "encap": "encapsulations", "decap": "decapsulations", "tcp": "TCP", "udp": "UDP", "sctp": "SCTP", "bgp": "BGP", "as": "AS",
    "gp": "remote access", "ipsec": "IPsec", "sslvpn": "SSL VPN", "dh": "key exchange", "kb": "kilobyte", "nat": "NAT", "t": "traversal",
    "ike": "IKE", "prf": "pseudorandom function", "spi": "SPI", "id": "number", "mib": "", "gb": "", "mb": "", "dp": "dataplane",
    "1min": "over 1 minute", "5min": "over 5 minutes", "15min": "over 15 minutes", "state_up": "1 if up", "vrf": "routing instance",
}
#: Fields whose names say too little.
FIELD_TEXTS = {
    "enabled": "whether it is switched on", "inserted": "1 if the unit is in place", "alarm": "1 while the alarm is on", "state_up": "1 while the state is up",
    "path_up": "1 while the path is up", "metric": "cost of the route", "min_required": "1 if the unit is needed", "kb_limit": "traffic after which keys are renewed",
    "lifetime": "time after which keys are renewed", "cpu_total_used": "processor time that was not idle", "is_dhcp": "1 if the IPv4 address comes from DHCP",
    "mac_address": "hardware address of the management port", "ip_address": "IPv4 address of the management port", "mac_count": "number of hardware addresses",
    "cpu_user": "processor time of programs", "cpu_system": "processor time of the kernel", "cpu_nice": "processor time of programs with low priority",
    "cpu_steal": "processor time taken by the hypervisor", "cpu_idle": "idle processor time", "speed": "speed of the link", "fwd": "where the interface forwards to",
    "temperature_c": "temperature", "min_temp_c": "lowest allowed temperature", "max_temp_c": "highest allowed temperature", "max_flaps": "most changes of state allowed",
    "link_down_count": "how often the link went down", "vm_mem_mb": "memory of the virtual machine", "remote_ip": "IP address of the other end",
    "is_dhcp6": "1 if the IPv6 address comes from DHCP", "build_compat": "whether the software builds of the pair match", "owner": "dataplane that owns the flow",
}
#: Units by field, and by the end of a field's name where it is in no list.
UNIT_OF = {
    "cores": ("vm_cores", "cpu_cores"), "addresses": ("mac_count",), "Mbps": ("speed",), "KB": ("kb_limit",), "RPM": ("rpm", "min_rpm", "max_rpm"),
    "V": ("volts", "min_volts", "max_volts"), "MiB": ("vm_mem_mb",), "boolean": ("state_up", "path_up"),
    "s": ("local_state_duration", "peer_state_duration", "status_time", "lifetime", "uptime_seconds", "lifetime_seconds", "remaining_seconds"),
    "%": ("cpu_user", "cpu_system", "cpu_nice", "cpu_idle", "cpu_iowait", "cpu_hardware_interrupt", "cpu_software_interrupt", "cpu_steal", "cpu_total_used",
          "cpu_utilization_avg"),
    "packets": ("rx_unicast", "rx_multicast", "rx_broadcast", "rx_error", "rx_discards", "tx_unicast", "tx_multicast", "tx_broadcast", "tx_error",
                "tx_discards", "ipackets", "opackets", "ierrors", "idrops", "flowstate", "ifwderrors", "noroute", "noarp", "noneigh", "neighpend", "nomac",
                "zonechange", "land", "pod", "teardrop", "ipspoof", "macspoof", "icmp_frag", "l2_encap", "l2_decap"),
    "connections": ("tcp_conn", "udp_conn", "sctp_conn", "other_conn"), "routes": ("routes_total", "static_routes", "bgp_routes"),
}
UNIT_BY_END = (
    ("_mib", "MiB"), ("_gb", "GB"), ("bytes", "bytes"), ("_percent", "%"), ("_seconds", "s"), ("_days", "days"), ("temp_c", "°C"),
    ("temperature_c", "°C"), ("_bps", "bits/s"), ("_pps", "packets/s"),
)
UNIT_BY_START = (("task_flow", "%"), ("task_", "%"), ("resource_", "%"))
#: Measurements whose lists of one name mean something else: tasks that are counted, not loads of a dataplane.
COUNTED = ("task_stats",)


def unit(measurement: str, name: str) -> str | None:
    """Unit of a field; null where it has none."""
    for found, names in UNIT_OF.items():
        if name in names:
            return found
    if measurement not in COUNTED:
        for start, found in UNIT_BY_START:
            if name.startswith(start) and not name.endswith("_total"):
                return found
    return next((found for end, found in UNIT_BY_END if name.endswith(end)), None)


def text(name: str) -> str:
    """What a field or tag holds, in words."""
    if name in FIELD_TEXTS:
        return FIELD_TEXTS[name]
    if name.endswith("_compat"):
        return f"whether the {text(name.removesuffix('_compat'))} versions of the pair match"
    parts = [WORDS.get(part, part) for part in name.replace("-", "_").split("_")]
    return " ".join(" ".join(parts).split())
