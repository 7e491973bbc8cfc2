"""Measurement definitions: what is read from which collection, and under which names.

A definition is data. ``shape`` says how entries are found inside the collection body:

``one``      the object at ``path``
``many``     the object or list of objects at ``path``
``map``      the values of an object whose keys are data; the key becomes the ``key_tag``
``slots``    objects by slot name, each with a one-or-many ``entry``; alternative paths allowed
``plane``    the per-second record of the first dataplane, its name as ``key_tag``
``cores``    the per-core entries of that record
``summary``  the object itself, or one object per router when it is keyed by router

Field kinds: ``int``, ``float`` (two digits, ``float1``/``float4`` for others), ``raw:<type>`` (value
as it came; the type is used in wide tables), ``yesno``, ``truthy``, ``size``, ``percent``,
``mean`` (of packed samples). Anything else is SQL text over ``entry`` in ``computed``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from fleetlens.functions import casts
from fleetlens.functions.netaddr import identity_ip

MONITOR_SLOTS = 10


@dataclass(frozen=True)
class Measurement:
    name: str
    module: str
    collection: str
    shape: str
    path: tuple[str, ...] = ()
    key_tag: str | None = None
    tags: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple, ...] = ()
    computed: dict[str, tuple[str, str]] = field(default_factory=dict, hash=False)
    computed_tags: dict[str, str] = field(default_factory=dict, hash=False)
    filled_tags: tuple[str, ...] = ()

    def reading(self) -> tuple[str, str, str, tuple[str, ...]]:
        """What has to be exploded; measurements with equal readings share one pass."""
        return self.module, self.collection, self.shape, self.path


def _text(*keys: str) -> str:
    return casts.leaf_text("entry", *keys)


def _int(*keys: str) -> str:
    return casts.int_of_leaf(casts.leaf("entry", *keys))


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1L ELSE 0L END"


# ---- computed values (SQL text over ``entry``) ----------------------------------------------


def _rounded(key: str, divisor: str) -> str:
    """A number divided and rounded, nothing for a missing one or zero."""
    return casts.bound(
        casts.double_of_leaf(casts.leaf("entry", key)),
        f"CASE WHEN q <> 0 THEN {casts.exact_round(f'q / {divisor}', 2)} END",
        "q",
    )


def _first_set(first: str, second: str) -> str:
    """The first leaf when it is set to something, else the second."""
    one = casts.leaf("entry", first)
    return f"CASE WHEN {casts.truthy_leaf(one)} = 1 THEN {_int(first)} ELSE {_int(second)} END"


def _defaulted_float(key: str) -> str:
    found = casts.leaf("entry", key)
    return f"CASE WHEN {found} IS NULL THEN 0D ELSE {casts.double_of_leaf(found, 2)} END"


def _defaulted_count(key: str) -> str:
    return f"CASE WHEN {casts.leaf('entry', key)} IS NULL THEN 0L ELSE {_int(key)} END"


def _ha_text(*keys: str) -> tuple[str, str]:
    return "string", f"CASE WHEN {_text('enabled')} = 'yes' THEN {_text('group', *keys)} END"


def _ha_int(*keys: str) -> tuple[str, str]:
    return "bigint", f"CASE WHEN {_text('enabled')} = 'yes' THEN {_int('group', *keys)} END"


def _task(name: str) -> tuple[str, str]:
    return "double", casts.percent_of_text(_text("task", name))


def _resource(name: str) -> tuple[str, str]:
    entries = casts.objects_of(casts.leaf("entry", "resource-utilization", "entry"))
    named = f"filter({entries}, r -> lower({casts.leaf_text('r', 'name')}) = '{name}')"
    means = f"transform({named}, r -> {casts.mean_of_csv(casts.leaf_text('r', 'value'))})"
    return "double", f"try_element_at(filter({means}, m -> m IS NOT NULL), -1)"


def _message(newer: str, older: str | None) -> tuple[str, str]:
    old = "cast(null as bigint)" if older is None else _int(older)
    stats = casts.leaf("entry", "detail", "messageStats")
    return "bigint", f"CASE WHEN {stats} IS NOT NULL THEN {_int('detail', 'messageStats', newer)} ELSE {old} END"


PEER_STATE = f"coalesce({casts.leaf_text('entry', 'state')}, 'Unknown')"
PATH_STATE = f"coalesce({casts.leaf_text('entry', 'pathmonitor-status')}, 'Unknown')"
IKE = f"CASE WHEN {casts.present(casts.leaf('entry', 'v2'))} THEN {casts.leaf('entry', 'v2')} ELSE {casts.leaf('entry', 'v1')} END"


def _monitor(index: int, source: str) -> tuple[str, str]:
    reached = " AND ".join(f"{casts.leaf('entry', f'monitordst-{i}')} IS NOT NULL" for i in range(index + 1))
    return "string", f"CASE WHEN {reached} THEN {_text(f'{source}-{index}')} END"


def _monitors() -> dict:
    out = {}
    for i in range(MONITOR_SLOTS):
        out[f"monitor_{i}_destination"] = _monitor(i, "monitordst")
        out[f"monitor_{i}_status"] = _monitor(i, "monitorstatus")
        out[f"monitor_{i}_interval_count"] = _monitor(i, "interval-count")
    return out


def _ike_text(key: str) -> tuple[str, str]:
    return "string", casts.leaf_text(f"({IKE})", key)


def _ike_ip(key: str) -> tuple[str, str]:
    return "string", casts.bound(_ike_text(key)[1], f"coalesce({identity_ip('i')}, '')", "i")


def _prefixes(older: str, newer: str) -> tuple[str, str]:
    return "bigint", (
        f"coalesce({_int('prefix-counter', 'entry', older)}, "
        f"{_int('detail', 'addressFamilyInfo', 'ipv4Unicast', newer)}, 0L)"
    )


# ---- fixed values: modules in output order, measurements, tag and field names, source keys ----

MODULES = ("system", "interfaces", "routing", "counters", "global_protect", "vpn")

SYSTEM = (
    Measurement(
        "system_identity", "system", "system_info", "one", ("system",),
        tags=(("model", "model"), ("family", "family"), ("serial", "serial")),
        fields=(
            ("sw_version", "sw-version", "raw:string"),
            ("vm_cores", "vm-cores", "int"),
            ("operational_mode", "operational-mode", "raw:string"),
            ("advanced_routing", "advanced-routing", "raw:string"),
            ("multi_vsys", "multi-vsys", "raw:string"),
            ("ip_address", "ip-address", "raw:string"),
            ("mac_address", "mac-address", "raw:string"),
            ("ipv6_address", "ipv6-address", "raw:string"),
            ("is_dhcp", "is-dhcp", "yesno"),
            ("is_dhcp6", "is-dhcp6", "yesno"),
        ),
        computed={"vm_mem_mb": ("double", _rounded("vm-mem", "1024"))},
    ),
    Measurement(
        "system_uptime", "system", "system_info", "one", ("system",),
        fields=(("uptime_seconds", "_uptime_seconds", "raw:bigint"),),
        computed={"uptime_days": ("double", _rounded("_uptime_seconds", "86400D"))},
    ),
    Measurement(
        "content_versions", "system", "system_info", "one", ("system",),
        fields=(
            ("app_version", "app-version", "raw:string"),
            ("av_version", "av-version", "int"),
            ("threat_version", "threat-version", "int"),
            ("wf_private_version", "wf-private-version", "int"),
            ("wildfire_version", "wildfire-version", "int"),
            ("wildfire_rt", "wildfire-rt", "raw:string"),
            ("url_filtering_version", "url-filtering-version", "int"),
            ("url_db", "url-db", "raw:string"),
            ("logdb_version", "logdb-version", "raw:string"),
            ("device_dictionary_version", "device-dictionary-version", "raw:string"),
            ("global_protect_client_package_version", "global-protect-client-package-version", "raw:string"),
        ),
    ),
    Measurement(
        "mac_count", "system", "system_info", "one", ("system",),
        tags=(("model", "model"), ("family", "family")),
        computed={"mac_count": ("bigint", _first_set("vm-mac-count", "mac_count"))},
    ),
    Measurement(
        "cpu_usage", "system", "resource_usage", "one",
        fields=(
            ("cpu_user", "cpu_user", "float"),
            ("cpu_system", "cpu_system", "float"),
            ("cpu_nice", "cpu_nice", "float"),
            ("cpu_iowait", "cpu_iowait", "float"),
            ("cpu_hardware_interrupt", "cpu_hardware_interrupt", "float"),
            ("cpu_software_interrupt", "cpu_software_interrupt", "float"),
            ("cpu_steal", "cpu_steal", "float"),
        ),
        computed={
            "cpu_idle": ("double", _defaulted_float("cpu_idle")),
            "cpu_total_used": ("double", casts.exact_round(f"100D - {_defaulted_float('cpu_idle')}", 2)),
        },
    ),
    Measurement(
        "memory_usage", "system", "resource_usage", "one",
        fields=(
            ("memory_total_mib", "memory_total_mib", "raw:double"),
            ("memory_free_mib", "memory_free_mib", "raw:double"),
            ("memory_used_mib", "memory_used_mib", "raw:double"),
            ("memory_buff_cache_mib", "memory_buff_cache_mib", "raw:double"),
            ("memory_available_mib", "memory_available_mib", "raw:double"),
        ),
        computed={"memory_usage_percent": ("double", _defaulted_float("memory_usage_percent"))},
    ),
    Measurement(
        "swap_usage", "system", "resource_usage", "one",
        fields=(
            ("swap_total_mib", "swap_total_mib", "raw:double"),
            ("swap_free_mib", "swap_free_mib", "raw:double"),
            ("swap_used_mib", "swap_used_mib", "raw:double"),
        ),
        computed={"swap_usage_percent": ("double", _defaulted_float("swap_usage_percent"))},
    ),
    Measurement(
        "load_average", "system", "resource_usage", "one",
        fields=(
            ("load_1min", "load_average_1min", "float"),
            ("load_5min", "load_average_5min", "float"),
            ("load_15min", "load_average_15min", "float"),
        ),
    ),
    Measurement(
        "task_stats", "system", "resource_usage", "one",
        fields=(
            ("tasks_total", "tasks_total", "raw:bigint"),
            ("tasks_running", "tasks_running", "raw:bigint"),
            ("tasks_sleeping", "tasks_sleeping", "raw:bigint"),
            ("tasks_stopped", "tasks_stopped", "raw:bigint"),
            ("tasks_zombie", "tasks_zombie", "raw:bigint"),
        ),
    ),
    Measurement(
        "disk_usage", "system", "disk_usage", "map", key_tag="mount_point",
        tags=(("device", "device"),),
        fields=(
            ("use_percent", "use_percent", "float"),
            ("size_gb", "size", "size"),
            ("used_gb", "used", "size"),
            ("available_gb", "available", "size"),
        ),
    ),
    Measurement(
        "ha_status", "system", "ha_status", "one",
        fields=(("enabled", "enabled", "raw:string"),),
        computed={
            "ha_mode": _ha_text("mode"),
            "local_state": _ha_text("local-info", "state"),
            "local_state_duration": _ha_int("local-info", "state-duration"),
            "local_priority": _ha_int("local-info", "priority"),
            "preempt_flap_cnt": _ha_int("local-info", "preempt-flap-cnt"),
            "nonfunc_flap_cnt": _ha_int("local-info", "nonfunc-flap-cnt"),
            "max_flaps": _ha_int("local-info", "max-flaps"),
            "state_sync": _ha_text("local-info", "state-sync"),
            "state_sync_type": _ha_text("local-info", "state-sync-type"),
            "dlp_compat": _ha_text("local-info", "DLP"),
            "nd_compat": _ha_text("local-info", "ND"),
            "oc_compat": _ha_text("local-info", "OC"),
            "build_compat": _ha_text("local-info", "build-compat"),
            "url_compat": _ha_text("local-info", "url-compat"),
            "app_compat": _ha_text("local-info", "app-compat"),
            "iot_compat": _ha_text("local-info", "iot-compat"),
            "av_compat": _ha_text("local-info", "av-compat"),
            "threat_compat": _ha_text("local-info", "threat-compat"),
            "vpnclient_compat": _ha_text("local-info", "vpnclient-compat"),
            "gpclient_compat": _ha_text("local-info", "gpclient-compat"),
            "peer_state": _ha_text("peer-info", "state"),
            "peer_state_duration": _ha_int("peer-info", "state-duration"),
            "peer_priority": _ha_int("peer-info", "priority"),
            "peer_conn_status": _ha_text("peer-info", "conn-status"),
            "peer_conn_ha1_status": _ha_text("peer-info", "conn-ha1", "conn-status"),
            "peer_conn_ha2_status": _ha_text("peer-info", "conn-ha2", "conn-status"),
            "running_sync": _ha_text("running-sync"),
            "running_sync_enabled": _ha_text("running-sync-enabled"),
        },
    ),
    Measurement(
        "cpu_dataplane_tasks", "system", "extended_cpu", "plane", key_tag="dp_id",
        computed={
            "task_flow_lookup": _task("flow_lookup"),
            "task_flow_fastpath": _task("flow_fastpath"),
            "task_flow_slowpath": _task("flow_slowpath"),
            "task_flow_forwarding": _task("flow_forwarding"),
            "task_flow_mgmt": _task("flow_mgmt"),
            "task_flow_ctrl": _task("flow_ctrl"),
            "task_nac_result": _task("nac_result"),
            "task_flow_np": _task("flow_np"),
            "task_dfa_result": _task("dfa_result"),
            "task_module_internal": _task("module_internal"),
            "task_aho_result": _task("aho_result"),
            "task_zip_result": _task("zip_result"),
            "task_pktlog_forwarding": _task("pktlog_forwarding"),
            "task_send_out": _task("send_out"),
            "task_flow_host": _task("flow_host"),
            "task_send_host": _task("send_host"),
            "task_fpga_result": _task("fpga_result"),
            "resource_session_avg": _resource("session"),
            "resource_packet_buffer_avg": _resource("packet buffer"),
            "resource_packet_descriptor_avg": _resource("packet descriptor"),
            "resource_sw_tags_descriptor_avg": _resource("sw tags descriptor"),
            "cpu_cores": ("bigint", f"cast(size({casts.one_or_many(casts.leaf('entry', 'cpu-load-average', 'entry'))}) as bigint)"),
        },
    ),
    Measurement(
        "cpu_dataplane_cores", "system", "extended_cpu", "cores", key_tag="dp_id",
        tags=(("core_id", "coreid"),),
        fields=(("cpu_utilization_avg", "value", "mean"),),
    ),
)

ENVIRONMENT = (
    Measurement(
        "env_thermal", "system", "environmental", "slots", ("thermal",),
        tags=(("slot", "slot"), ("description", "description")),
        fields=(
            ("temperature_c", "DegreesC", "float"),
            ("min_temp_c", "min", "float"),
            ("max_temp_c", "max", "float"),
            ("alarm", "alarm", "truthy"),
        ),
    ),
    Measurement(
        "env_fan", "system", "environmental", "slots", ("fans|fan",),
        tags=(("slot", "slot"), ("description", "description")),
        fields=(("rpm", "RPMs", "int"), ("min_rpm", "min", "int"), ("alarm", "alarm", "truthy")),
    ),
    Measurement(
        "env_power", "system", "environmental", "slots", ("power",),
        tags=(("slot", "slot"), ("description", "description")),
        fields=(
            ("volts", "Volts", "float4"),
            ("min_volts", "min", "float4"),
            ("max_volts", "max", "float4"),
            ("alarm", "alarm", "truthy"),
        ),
    ),
    Measurement(
        "env_power_supply", "system", "environmental", "slots", ("power-supply",),
        tags=(("slot", "slot"), ("description", "description")),
        fields=(
            ("inserted", "Inserted", "truthy"),
            ("min_required", "min", "truthy"),
            ("alarm", "alarm", "truthy"),
        ),
    ),
)

INTERFACES = (
    Measurement(
        "interface_info", "interfaces", "interface_info", "many", ("hw", "entry"),
        tags=(("interface", "name"), ("type", "type")),
        filled_tags=("type",),
        fields=(
            ("state", "state", "raw:string"),
            ("speed", "speed", "int"),
            ("duplex", "duplex", "raw:string"),
            ("mac", "mac", "raw:string"),
            ("mode", "mode", "raw:string"),
            ("fec", "fec", "raw:string"),
        ),
    ),
    Measurement(
        "interface_logical", "interfaces", "interface_info", "many", ("ifnet", "entry"),
        tags=(("interface", "name"), ("zone", "zone"), ("vsys", "vsys")),
        filled_tags=("vsys",),
        fields=(("ip", "ip", "raw:string"), ("fwd", "fwd", "raw:string"), ("tag", "tag", "raw:string")),
    ),
    Measurement(
        "interface_counters_hw", "interfaces", "interface_counters", "many", ("hw", "entry"),
        tags=(("interface", "name"),),
        fields=(
            ("rx_bytes", "port/rx-bytes", "raw:bigint"),
            ("rx_unicast", "port/rx-unicast", "raw:bigint"),
            ("rx_multicast", "port/rx-multicast", "raw:bigint"),
            ("rx_broadcast", "port/rx-broadcast", "raw:bigint"),
            ("rx_error", "port/rx-error", "raw:bigint"),
            ("rx_discards", "port/rx-discards", "raw:bigint"),
            ("tx_bytes", "port/tx-bytes", "raw:bigint"),
            ("tx_unicast", "port/tx-unicast", "raw:bigint"),
            ("tx_multicast", "port/tx-multicast", "raw:bigint"),
            ("tx_broadcast", "port/tx-broadcast", "raw:bigint"),
            ("tx_error", "port/tx-error", "raw:bigint"),
            ("tx_discards", "port/tx-discards", "raw:bigint"),
            ("link_down_count", "port/link-down", "raw:bigint"),
            ("ibytes", "ibytes", "raw:bigint"),
            ("obytes", "obytes", "raw:bigint"),
            ("ipackets", "ipackets", "raw:bigint"),
            ("opackets", "opackets", "raw:bigint"),
            ("ierrors", "ierrors", "raw:bigint"),
            ("idrops", "idrops", "raw:bigint"),
        ),
    ),
    Measurement(
        "interface_counters_logical", "interfaces", "interface_counters", "many", ("ifnet", "ifnet", "entry"),
        tags=(("interface", "name"),),
        fields=tuple(
            (name, name, "raw:bigint")
            for name in (
                "ibytes obytes ipackets opackets ierrors idrops flowstate ifwderrors noroute noarp noneigh "
                "neighpend nomac zonechange land pod teardrop ipspoof macspoof icmp_frag l2_encap l2_decap "
                "tcp_conn udp_conn sctp_conn other_conn"
            ).split()
        ),
    ),
)

ROUTING = (
    Measurement(
        "bgp_summary", "routing", "bgp_summary", "summary", key_tag="vrf",
        tags=(("router_id", "router_id"),),
        computed_tags={"local_as": f"CASE WHEN {casts.truthy_leaf(casts.leaf('entry', 'local_as'))} = 1 THEN {_text('local_as')} END"},
        fields=(
            ("total_peers", "total_peers", "raw:bigint"),
            ("peers_established", "peers_established", "raw:bigint"),
            ("peers_down", "peers_down", "raw:bigint"),
            ("total_prefixes", "total_prefixes", "raw:bigint"),
        ),
    ),
    Measurement(
        "bgp_peer", "routing", "bgp_peer_status", "map", key_tag="peer_name",
        tags=(("peer_ip", "peer-ip"), ("peer_group", "peer-group-name")),
        computed_tags={"state": PEER_STATE},
        fields=(
            ("remote_as", "remote-as", "raw:bigint"),
            ("local_as", "local-as", "raw:bigint"),
            ("status_time", "status-time", "float1"),
        ),
        computed={
            "state_up": ("bigint", _flag(f"{PEER_STATE} = 'Established'")),
            "messages_sent": _message("totalSent", "msg-total-out"),
            "messages_received": _message("totalRecv", "msg-total-in"),
            "updates_sent": _message("updatesSent", "msg-update-out"),
            "updates_received": _message("updatesRecv", "msg-update-in"),
            "keepalives_sent": _message("keepalivesSent", None),
            "keepalives_received": _message("keepalivesRecv", None),
            "notifications_sent": _message("notificationsSent", None),
            "notifications_received": _message("notificationsRecv", None),
        },
    ),
    Measurement(
        "bgp_path_monitor", "routing", "bgp_path_monitor", "many", ("entry",),
        tags=(("destination", "destination"), ("nexthop", "nexthop"), ("interface", "interface")),
        computed_tags={"pathmonitor_status": PATH_STATE},
        fields=(
            ("metric", "metric", "raw:bigint"),
            ("pathmonitor_condition", "pathmonitor-cond", "raw:string"),
        ),
        computed={"path_up": ("bigint", _flag(f"{PATH_STATE} = 'Up'")), **_monitors()},
    ),
)

REMOTE_ACCESS = (
    Measurement(
        "gp_gateway", "global_protect", "gateway_summary", "many", ("entry",),
        tags=(("gateway_name", "name"),),
        fields=(
            ("max_concurrent_tunnels", "gateway_max_concurrent_tunnel", "raw:bigint"),
            ("successful_ipsec_connections", "gateway_successful_ip_sec_connections", "raw:bigint"),
            ("total_tunnel_count", "record_gateway_tunnel_count", "raw:bigint"),
        ),
        computed={
            "current_users": ("bigint", _defaulted_count("CurrentUsers")),
            "previous_users": ("bigint", _defaulted_count("PreviousUsers")),
        },
    ),
    Measurement(
        "gp_portal", "global_protect", "portal_summary", "many", ("entry",),
        tags=(("portal_name", "name"),),
        computed={"successful_connections": ("bigint", _defaulted_count("successful_connections"))},
    ),
)

VPN = (
    Measurement(
        "vpn_flows", "vpn", "vpn_flows", "one",
        computed={
            "num_ipsec": ("bigint", _defaulted_count("num_ipsec")),
            "num_sslvpn": ("bigint", _defaulted_count("num_sslvpn")),
            "total_flows": ("bigint", _defaulted_count("total")),
        },
    ),
    Measurement(
        "ipsec_flow", "vpn", "vpn_flows", "many", ("IPSec", "entry"),
        tags=(("flow_name", "name"),),
        fields=(
            ("flow_id", "id", "int"),
            ("gateway_id", "gwid", "int"),
            ("inner_interface", "inner-if", "raw:string"),
            ("outer_interface", "outer-if", "raw:string"),
            ("state", "state", "raw:string"),
            ("ipsec_mode", "ipsec-mode", "raw:string"),
            ("local_ip", "localip", "raw:string"),
            ("peer_ip", "peerip", "raw:string"),
            ("monitoring", "mon", "raw:string"),
            ("owner", "owner", "int"),
        ),
        computed={"state_up": ("bigint", _flag(f"{_text('state')} = 'active'"))},
    ),
    Measurement(
        "vpn_tunnel", "vpn", "vpn_tunnels", "many", ("entries", "entry"),
        tags=(("tunnel_name", "name"), ("gateway", "gw")),
        fields=(
            ("tunnel_id", "id", "int"),
            ("protocol", "proto", "raw:string"),
            ("mode", "mode", "raw:string"),
            ("dh_group", "dh", "raw:string"),
            ("encryption", "enc", "raw:string"),
            ("hash", "hash", "raw:string"),
            ("lifetime", "life", "int"),
            ("kb_limit", "kb", "int"),
        ),
    ),
    Measurement(
        "vpn_gateway", "vpn", "vpn_gateways", "many", ("entries", "entry"),
        tags=(("gateway_name", "name"),),
        fields=(("gateway_id", "id", "int"), ("socket", "sock", "int"), ("nat_t", "natt", "int")),
        computed={
            "peer_ip": _ike_ip("peer-id"),
            "local_ip": _ike_ip("local-id"),
            "ike_version": ("bigint", f"CASE WHEN {casts.present(casts.leaf('entry', 'v2'))} THEN 2L ELSE 1L END"),
            "authentication": _ike_text("auth"),
            "dh_group": _ike_text("dh"),
            "encryption": _ike_text("enc"),
            "hash": _ike_text("hash"),
            "prf": _ike_text("prf"),
            "lifetime": ("bigint", casts.int_of_leaf(casts.leaf(f"({IKE})", "life"))),
        },
    ),
    Measurement(
        "ipsec_sa", "vpn", "ipsec_sa", "many", ("entries", "entry"),
        tags=(("tunnel_name", "name"), ("gateway", "gateway")),
        fields=(
            ("gateway_id", "gwid", "int"),
            ("tunnel_id", "tid", "int"),
            ("remote_ip", "remote", "raw:string"),
            ("protocol", "proto", "raw:string"),
            ("encryption", "enc", "raw:string"),
            ("hash", "hash", "raw:string"),
            ("inbound_spi", "i_spi", "int"),
            ("outbound_spi", "o_spi", "int"),
            ("lifetime_seconds", "life", "int"),
            ("remaining_seconds", "remain", "int"),
        ),
        computed={"remaining_percent": ("double", casts.share_left(_int("remain"), _int("life")))},
    ),
)

# Collected documents shown in reports that are not points of their own.
REPORTS = (
    Measurement(
        "session_info", "counters", "session_info", "one",
        computed={
            name: ("bigint", _defaulted_count(key))
            for name, key in (
                ("active", "num-active"),
                ("maximum", "num-max"),
                ("tcp", "num-tcp"),
                ("udp", "num-udp"),
                ("icmp", "num-icmp"),
                ("connections_per_second", "cps"),
                ("packets_per_second", "pps"),
                ("kbits_per_second", "kbps"),
            )
        },
        fields=(("utilization_percent", "pct-utilization", "raw:bigint"),),
    ),
    Measurement(
        "management_counters", "counters", "management_server_counters", "map", key_tag="counter",
        computed={"value": ("bigint", casts.int_of_leaf("entry"))},
    ),
    Measurement(
        "portal_messages", "global_protect", "portal_statistics", "one",
        fields=tuple(
            (name, name, "raw:bigint")
            for name in (
                "total_messages_dp_to_mp",
                "total_invalid_messages_dp_to_mp",
                "failed_to_read_messages_dp_to_mp",
            )
        ),
    ),
    Measurement(
        "gateway_users", "global_protect", "gateway_statistics", "many", ("Gateway",),
        tags=(("gateway_name", "name"),),
        fields=(("current_users", "CurrentUsers", "int"), ("previous_users", "PreviousUsers", "int")),
    ),
    Measurement(
        "bgp_config", "routing", "bgp_summary", "map", key_tag="vrf",
        computed={
            "router_id": ("string", f"coalesce({_text('router-id')}, 'N/A')"),
            "local_as": ("string", f"coalesce({_text('local-as')}, 'N/A')"),
            "graceful_restart": ("string", f"coalesce({_text('graceful-restart')}, 'N/A')"),
            "status": ("string", f"upper(coalesce({_text('enabled')}, 'no'))"),
        },
    ),
    Measurement(
        "bgp_prefixes", "routing", "bgp_peer_status", "map", key_tag="peer_name",
        computed={
            "prefixes_in": _prefixes("incoming-accepted", "acceptedPrefixCounter"),
            "prefixes_out": _prefixes("outgoing-advertised", "sentPrefixCounter"),
        },
    ),
)

MEASUREMENTS = {m.name: m for m in (*SYSTEM, *ENVIRONMENT, *INTERFACES, *ROUTING, *REMOTE_ACCESS, *VPN)}
REPORT_VIEWS = {m.name: m for m in REPORTS}
# Collections used only when the first choice of the same device is absent or empty.
FALLBACKS = {"static_routes": "routing_table", "bgp_routes": "routing_table", "vpn_tunnels": "active_tunnels"}
# Every collection that some measurement or summary reads.
KNOWN_COLLECTIONS = frozenset(m.collection for m in MEASUREMENTS.values()) | {*FALLBACKS, *FALLBACKS.values(), "global_counters"}
