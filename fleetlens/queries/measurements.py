"""Every measurement, built from device documents derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import project
from fleetlens.operators.specs import MEASUREMENTS, REPORT_VIEWS
from fleetlens.plans.fleet import Plan, collection_rows, expected_sql, real, text, whole, word
from fleetlens.plans.ticks import table
from fleetlens.queries import query
from fleetlens.sources import snapshots

M = MEASUREMENTS | REPORT_VIEWS


def _same(names: dict[str, str], make=whole) -> tuple[dict[str, str], dict[str, str]]:
    """Leaves and expected values of fields that are passed through: field name → source path."""
    leaves = {path: make(20 + i) for i, path in enumerate(names.values())}
    expected = {name: make(20 + i) for i, name in enumerate(names)}
    return leaves, expected


def _ha() -> Plan:
    texts = {
        "ha_mode": "group/mode", "local_state": "group/local-info/state", "state_sync": "group/local-info/state-sync",
        "state_sync_type": "group/local-info/state-sync-type", "dlp_compat": "group/local-info/DLP",
        "nd_compat": "group/local-info/ND", "oc_compat": "group/local-info/OC",
        "build_compat": "group/local-info/build-compat", "url_compat": "group/local-info/url-compat",
        "app_compat": "group/local-info/app-compat", "iot_compat": "group/local-info/iot-compat",
        "av_compat": "group/local-info/av-compat", "threat_compat": "group/local-info/threat-compat",
        "vpnclient_compat": "group/local-info/vpnclient-compat", "gpclient_compat": "group/local-info/gpclient-compat",
        "peer_state": "group/peer-info/state", "peer_conn_status": "group/peer-info/conn-status",
        "peer_conn_ha1_status": "group/peer-info/conn-ha1/conn-status",
        "peer_conn_ha2_status": "group/peer-info/conn-ha2/conn-status", "running_sync": "group/running-sync",
        "running_sync_enabled": "group/running-sync-enabled",
    }
    numbers = {
        "local_state_duration": "group/local-info/state-duration", "local_priority": "group/local-info/priority",
        "preempt_flap_cnt": "group/local-info/preempt-flap-cnt", "nonfunc_flap_cnt": "group/local-info/nonfunc-flap-cnt",
        "max_flaps": "group/local-info/max-flaps", "peer_state_duration": "group/peer-info/state-duration",
        "peer_priority": "group/peer-info/priority",
    }
    enabled = "case when n % 3 = 0 then 'no' else 'yes' end"
    text_leaves, text_values = _same(texts, word)
    leaves, values = _same(numbers)
    gated = {k: f"case when n % 3 <> 0 then {v} end" for k, v in (text_values | values).items()}
    return Plan(M["ha_status"], leaves={"enabled": enabled} | text_leaves | leaves, expected={"enabled": enabled} | gated)


TASKS = (
    "flow_lookup flow_fastpath flow_slowpath flow_forwarding flow_mgmt flow_ctrl nac_result flow_np dfa_result "
    "module_internal aho_result zip_result pktlog_forwarding send_out flow_host send_host fpga_result"
).split()


def _dataplane() -> Plan:
    leaves = {f"task/{t}": f"{text(real(i))} || '%'" for i, t in enumerate(TASKS)}
    values = {f"task_{t}": real(i) for i, t in enumerate(TASKS)}
    packed = f"{text('n % 40')} || ',' || {text('n % 40 + 1')}"
    named = ", ".join(
        f"named_struct('name', '{title}', 'value', {packed if i else "'1,x'"})"
        for i, title in enumerate(("Session", "packet buffer", "Packet Descriptor", "sw tags descriptor"))
    )
    leaves["resource-utilization/entry"] = f"array({named})"
    leaves["cpu-load-average/entry"] = (
        "array(named_struct('coreid', '0', 'value', '1'), named_struct('coreid', '1', 'value', '2'))"
    )
    mean = "cast(n % 40 as double) + 0.5"
    values |= {
        "resource_session_avg": "cast(null as double)",
        "resource_packet_buffer_avg": mean,
        "resource_packet_descriptor_avg": mean,
        "resource_sw_tags_descriptor_avg": mean,
        "cpu_cores": "cast(2 as bigint)",
    }
    return Plan(M["cpu_dataplane_tasks"], leaves=leaves, expected=values)


def _monitor() -> Plan:
    # Monitor 0 is always there, 1 for half of the entries, 2 never, 3 behind the gap.
    leaves = {
        "pathmonitor-status": "case n % 3 when 0 then 'Up' when 1 then 'Down' end",
        "monitordst-0": word(30).replace("null", "'-'"), "monitorstatus-0": word(31), "interval-count-0": "'5/3'",
        "monitordst-1": "case when n % 2 = 0 then '10.0.0.1' end", "monitorstatus-1": word(32),
        "interval-count-1": "'3/3'", "monitordst-3": "'10.0.0.3'", "monitorstatus-3": "'up'",
    }
    state = "coalesce(case n % 3 when 0 then 'Up' when 1 then 'Down' end, 'Unknown')"
    values = {
        "pathmonitor_status": state,
        "path_up": f"cast(case when {state} = 'Up' then 1 else 0 end as bigint)",
        "monitor_0_destination": leaves["monitordst-0"], "monitor_0_status": leaves["monitorstatus-0"],
        "monitor_0_interval_count": "'5/3'", "monitor_1_destination": leaves["monitordst-1"],
        "monitor_1_status": f"case when n % 2 = 0 then {word(32)} end",
        "monitor_1_interval_count": "case when n % 2 = 0 then '3/3' end",
    }
    for i in range(2, 10):
        for name in ("destination", "status", "interval_count"):
            values[f"monitor_{i}_{name}"] = "cast(null as string)"
    return Plan(M["bgp_path_monitor"], leaves=leaves, expected=values)


def _peer() -> Plan:
    newer = {"messages_sent": "totalSent", "messages_received": "totalRecv", "updates_sent": "updatesSent",
             "updates_received": "updatesRecv", "keepalives_sent": "keepalivesSent",
             "keepalives_received": "keepalivesRecv", "notifications_sent": "notificationsSent",
             "notifications_received": "notificationsRecv"}
    older = {"messages_sent": "msg-total-out", "messages_received": "msg-total-in",
             "updates_sent": "msg-update-out", "updates_received": "msg-update-in"}
    state = "case n % 4 when 0 then 'Established' when 1 then 'Active' when 2 then 'Idle' end"
    stats = ", ".join(f"'{s}', {whole(30 + i)}" for i, s in enumerate(newer.values()))
    leaves = {
        "state": state,
        "detail": f"case when n % 2 = 0 then named_struct('messageStats', named_struct({stats})) end",
    } | {s: whole(40 + i) for i, s in enumerate(older.values())}
    values = {"state": f"coalesce({state}, 'Unknown')", "state_up": "cast(case when n % 4 = 0 then 1 else 0 end as bigint)"}
    for i, name in enumerate(newer):
        old = whole(40 + list(older).index(name)) if name in older else "cast(null as bigint)"
        values[name] = f"case when n % 2 = 0 then {whole(30 + i)} else {old} end"
    return Plan(M["bgp_peer"], leaves=leaves, expected=values)


def _gateway() -> Plan:
    def ike(shift: int) -> str:
        return (
            f"named_struct('peer-id', 'a(ipaddr:10.0.{shift}.' || {text('n % 250')} || ')', 'local-id', 'plain-' || {text('n')}, "
            f"'auth', {word(shift)}, 'dh', {word(shift + 1)}, 'enc', {word(shift + 2)}, 'hash', {word(shift + 3)}, "
            f"'prf', {word(shift + 4)}, 'life', {text(whole(shift))})"
        )

    def either(make) -> str:
        return f"case when n % 2 = 0 then {make(10)} else {make(20)} end"

    values = {
        "peer_ip": either(lambda s: f"'10.0.{s}.' || {text('n % 250')}"),
        "local_ip": f"'plain-' || {text('n')}",
        "ike_version": "cast(case when n % 2 = 0 then 2 else 1 end as bigint)",
        "authentication": either(lambda s: word(s)), "dh_group": either(lambda s: word(s + 1)),
        "encryption": either(lambda s: word(s + 2)), "hash": either(lambda s: word(s + 3)),
        "prf": either(lambda s: word(s + 4)), "lifetime": either(lambda s: whole(s)),
    }
    return Plan(M["vpn_gateway"], leaves={"v2": f"case when n % 2 = 0 then {ike(10)} end", "v1": ike(20)}, expected=values)


def _plans() -> dict[str, Plan]:
    idle = "case when n % 5 = 0 then null else cast(n % 400 as double) / 4 end"
    idle_value = "case when n % 5 = 0 then cast(0 as double) else cast(n % 400 as double) / 4 end"
    percent = "case when n % 5 = 0 then null else cast(n % 400 as double) / 4 end"
    life, remain = "(n % 5) * 1000", "(n % 5) * 250"
    users = {"current_users": "CurrentUsers", "previous_users": "PreviousUsers"}
    session = {"active": "num-active", "maximum": "num-max", "tcp": "num-tcp", "udp": "num-udp", "icmp": "num-icmp",
               "connections_per_second": "cps", "packets_per_second": "pps", "kbits_per_second": "kbps"}

    def plan(name: str, fields: dict[str, str] | None = None, leaves=None, expected=None, table="customer") -> Plan:
        same_leaves, same_values = _same(fields or {})
        return Plan(M[name], table, same_leaves | (leaves or {}), same_values | (expected or {}))

    return {
        "pj01_system_identity": plan(
            "system_identity", leaves={"vm-mem": "cast(n % 7 * 2048 as bigint)"},
            expected={"vm_mem_mb": "case when n % 7 <> 0 then cast(n % 7 * 2 as double) end"},
        ),
        "pj02_system_uptime": plan(
            "system_uptime", leaves={"_uptime_seconds": "cast(n * 21600 as bigint)"},
            expected={"uptime_seconds": "cast(n * 21600 as bigint)", "uptime_days": "case when n <> 0 then cast(n as double) / 4 end"},
        ),
        "pj03_content_versions": plan("content_versions"),
        "pj04_mac_count": plan(
            "mac_count", leaves={"vm-mac-count": "n % 3", "mac_count": text("n % 50")},
            expected={"mac_count": "cast(case when n % 3 <> 0 then n % 3 else n % 50 end as bigint)"},
        ),
        "pj05_cpu_usage": plan(
            "cpu_usage", leaves={"cpu_idle": idle}, expected={"cpu_idle": idle_value, "cpu_total_used": f"100.0 - ({idle_value})"},
        ),
        "pj06_memory_usage": plan(
            "memory_usage", leaves={"memory_usage_percent": percent}, expected={"memory_usage_percent": idle_value},
        ),
        "pj07_swap_usage": plan(
            "swap_usage", leaves={"swap_usage_percent": percent}, expected={"swap_usage_percent": idle_value},
        ),
        "pj08_load_average": plan("load_average"),
        "pj09_task_stats": plan("task_stats"),
        "pj10_disk_usage": plan("disk_usage"),
        "pj11_ha_status": _ha(),
        "pj12_cpu_dataplane_tasks": _dataplane(),
        "pj13_cpu_dataplane_cores": plan("cpu_dataplane_cores"),
        "pj14_env_thermal": plan("env_thermal"),
        "pj15_env_fan": plan("env_fan"),
        "pj16_env_power": plan("env_power"),
        "pj17_env_power_supply": plan("env_power_supply"),
        "pj18_interface_info": plan("interface_info", table="orders"),
        "pj19_interface_logical": plan("interface_logical", table="orders"),
        "pj20_interface_counters_hw": plan("interface_counters_hw", table="orders"),
        "pj21_interface_counters_logical": plan("interface_counters_logical", table="orders"),
        "pj22_bgp_summary": plan(
            "bgp_summary", leaves={"local_as": "n % 4 * 1000"},
            expected={"local_as": f"case when n % 4 <> 0 then {text('n % 4 * 1000')} end"},
        ),
        "pj23_bgp_peer": _peer(),
        "pj24_bgp_path_monitor": _monitor(),
        "pj38_gp_gateway": plan("gp_gateway", users),
        "pj39_gp_portal": plan("gp_portal", {"successful_connections": "successful_connections"}),
        "pj40_vpn_flows": plan("vpn_flows", {"num_ipsec": "num_ipsec", "num_sslvpn": "num_sslvpn", "total_flows": "total"}),
        "pj41_ipsec_flow": plan(
            "ipsec_flow", leaves={"state": "case when n % 2 = 0 then 'active' else 'init' end"},
            expected={"state": "case when n % 2 = 0 then 'active' else 'init' end", "state_up": "cast((n + 1) % 2 as bigint)"},
        ),
        "pj42_vpn_tunnel": plan("vpn_tunnel"),
        "pj43_vpn_gateway": _gateway(),
        "pj44_ipsec_sa": plan(
            "ipsec_sa", leaves={"life": life, "remain": text(remain)},
            expected={
                "lifetime_seconds": f"cast({life} as bigint)", "remaining_seconds": f"cast({remain} as bigint)",
                "remaining_percent": "case when n % 5 <> 0 then cast(25 as double) end",
            },
        ),
        "pj46_session_info": plan("session_info", session),
        "pj47_portal_messages": plan("portal_messages"),
        "pj47_gateway_users": plan("gateway_users"),
        "pj48_bgp_config": plan(
            "bgp_config", leaves={"router-id": word(1), "local-as": whole(2), "graceful-restart": "'yes'", "enabled": "case when n % 2 = 0 then 'yes' end"},
            expected={
                "router_id": f"coalesce({word(1)}, 'N/A')", "local_as": text(whole(2)), "graceful_restart": "'yes'",
                "status": "case when n % 2 = 0 then 'YES' else 'NO' end",
            },
        ),
        "p26_peer_prefixes": plan(
            "bgp_prefixes",
            leaves={
                "prefix-counter": f"case when n % 2 = 0 then named_struct('entry', named_struct('incoming-accepted', {whole(1)}, 'outgoing-advertised', {whole(2)})) end",
                "detail": f"case when n % 2 = 1 then named_struct('addressFamilyInfo', named_struct('ipv4Unicast', named_struct('acceptedPrefixCounter', {whole(3)}, 'sentPrefixCounter', {whole(4)}))) end",
            },
            expected={
                "prefixes_in": f"case when n % 2 = 0 then {whole(1)} else {whole(3)} end",
                "prefixes_out": f"case when n % 2 = 0 then {whole(2)} else {whole(4)} end",
            },
        ),
    }


def _register(name: str, plan: Plan) -> None:
    @query(name, expected_sql(plan))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = project.wide(collection_rows(spark, sf_dir, plan), plan.spec)
        return rows.drop("collected_at", "hostname", "data_hostname")


for _name, _plan in _plans().items():
    _register(_name, _plan)


# ---- measurements against SQL written by hand, with documents written out ---------------------


def _written_out() -> str:
    """A document for each supplier, in the layouts that devices send; values are columns of the table."""
    return """concat('{"system":{"', s_name, '":{"success":true,"hostname":"h","data":{
        "extended_cpu":{"resource-monitor":{"dp0":{"second":{"task":{"flow_lookup":"', s_nationkey, '%","send_out":"7%"},
            "resource-utilization":{"entry":[{"name":"session","value":"', s_nationkey, ',', s_nationkey + 2, '"},{"name":"Packet Buffer","value":"4"}]},
            "cpu-load-average":{"entry":{"coreid":0,"value":"', s_nationkey, '"}}}}}},
        "ha_status":{"enabled":"yes","group":{"mode":"Active-Passive","local-info":{"state":"s', s_nationkey, '","priority":', s_suppkey, ',"preempt-flap-cnt":2}}}}}},
      "interfaces":{"', s_name, '":{"success":true,"data":{"interface_counters":{
        "hw":{"entry":[{"name":"eth1","port":{"rx-bytes":', s_suppkey * 10, ',"tx-error":', s_nationkey, ',"link-down":3},"ibytes":', s_suppkey, '}]},
        "ifnet":{"ifnet":{"entry":{"name":"eth1.1","obytes":', s_suppkey * 7, ',"icmp_frag":', s_nationkey, ',"neighpend":1}}}}}}},
      "routing":{"', s_name, '":{"success":true,"data":{"routing_mode":"advanced",
        "bgp_summary":{"r1":{"router_id":"1.1.1.1","local_as":65000,"total_peers":', s_nationkey, ',"peers_down":1}},
        "bgp_peer_status":{"p1":{"state":"Established","peer-ip":"10.0.0.1","remote-as":', s_suppkey, ',"status-time":12.25,"detail":{"messageStats":{"totalSent":', s_nationkey, ',"updatesRecv":5}}}},
        "bgp_path_monitor":{"entry":[{"destination":"d","nexthop":"n","pathmonitor-status":"Up","metric":', s_nationkey, ',"monitordst-0":"8.8.8.8","monitorstatus-0":"st', s_nationkey, '"}]}}}},
      "vpn":{"', s_name, '":{"success":true,"data":{
        "vpn_gateways":{"entries":{"entry":[{"name":"g","id":"', s_nationkey, '","sock":4,"v2":{"peer-id":"x(ipaddr:10.1.0.', s_nationkey, ')","auth":"psk","life":"', s_suppkey, '"}}]}},
        "ipsec_sa":{"entries":{"entry":{"name":"t","gateway":"g","gwid":', s_nationkey, ',"remote":"192.0.2.', s_nationkey, '","life":"200","remain":"', s_nationkey, '"}}}}}}}')"""


INDEPENDENT = (
    ("cpu_dataplane_tasks", "task_flow_lookup", "s_nationkey"), ("cpu_dataplane_tasks", "task_send_out", "7"),
    ("cpu_dataplane_tasks", "resource_session_avg", "s_nationkey + 1"), ("cpu_dataplane_tasks", "resource_packet_buffer_avg", "4"),
    ("cpu_dataplane_tasks", "cpu_cores", "1"), ("cpu_dataplane_cores", "cpu_utilization_avg", "s_nationkey"),
    ("ha_status", "local_priority", "s_suppkey"), ("ha_status", "preempt_flap_cnt", "2"),
    ("interface_counters_hw", "rx_bytes", "s_suppkey * 10"), ("interface_counters_hw", "tx_error", "s_nationkey"),
    ("interface_counters_hw", "link_down_count", "3"), ("interface_counters_hw", "ibytes", "s_suppkey"),
    ("interface_counters_logical", "obytes", "s_suppkey * 7"), ("interface_counters_logical", "icmp_frag", "s_nationkey"),
    ("interface_counters_logical", "neighpend", "1"),
    ("bgp_summary", "total_peers", "s_nationkey"), ("bgp_summary", "peers_down", "1"),
    ("bgp_peer", "remote_as", "s_suppkey"), ("bgp_peer", "state_up", "1"), ("bgp_peer", "messages_sent", "s_nationkey"),
    ("bgp_peer", "updates_received", "5"), ("bgp_path_monitor", "metric", "s_nationkey"), ("bgp_path_monitor", "path_up", "1"),
    ("vpn_gateway", "gateway_id", "s_nationkey"), ("vpn_gateway", "socket", "4"), ("vpn_gateway", "ike_version", "2"),
    ("vpn_gateway", "lifetime", "s_suppkey"), ("ipsec_sa", "gateway_id", "s_nationkey"), ("ipsec_sa", "lifetime_seconds", "200"),
    ("ipsec_sa", "remaining_seconds", "s_nationkey"),
)
INDEPENDENT_TEXT = (
    ("ha_status", "local_state", "'s' || cast(s_nationkey as varchar)"), ("ha_status", "ha_mode", "'Active-Passive'"),
    ("bgp_path_monitor", "monitor_0_destination", "'8.8.8.8'"),
    ("bgp_path_monitor", "monitor_0_status", "'st' || cast(s_nationkey as varchar)"),
    ("vpn_gateway", "peer_ip", "'10.1.0.' || cast(s_nationkey as varchar)"), ("vpn_gateway", "authentication", "'psk'"),
    ("ipsec_sa", "remote_ip", "'192.0.2.' || cast(s_nationkey as varchar)"),
)


@query(
    "pj_written_out",
    " union all ".join(
        [f"select s_name as device, '{m}' as measurement, '{f}' as field, cast({v} as double) as number, cast(null as varchar) as text from supplier" for m, f, v in INDEPENDENT]
        + [f"select s_name, '{m}', '{f}', null, {v} from supplier" for m, f, v in INDEPENDENT_TEXT]
        + ["select s_name, 'ipsec_sa', 'remaining_percent', cast(s_nationkey as double) / 2, null from supplier where s_nationkey > 0",
           "select s_name, 'bgp_peer', 'status_time', 12.2::double, null from supplier"]
    ),
)
def pj_written_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measurements that few other queries reach, from whole documents; of their fields those that the documents set."""
    raw = table(spark, sf_dir, "supplier").select(
        F.expr(_written_out()).alias("payload"), F.lit("2024-01-01").cast("timestamp").alias("collected_at")
    )
    good, _ = snapshots.parsed(raw)
    names = {"extended_cpu", "ha_status", "interface_counters", "bgp_summary", "bgp_peer_status", "bgp_path_monitor", "vpn_gateways", "ipsec_sa"}
    points = project.points(snapshots.collections(snapshots.envelopes(good)), present=names)
    metrics = project.long_metrics(points).filter(
        "field not in ('enabled', 'monitor_0_interval_count', 'local_ip', 'pathmonitor_condition')"
    )
    number = F.coalesce(F.col("v_dbl"), F.col("v_int").cast("double"))
    return metrics.select("device", "measurement", "field", number.alias("number"), F.col("v_str").alias("text"))
