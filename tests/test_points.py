"""Snapshots to points, with expected values written out."""

import json

import pytest

SYSTEM = {
    "system_info": {
        "system": {
            "hostname": "edge-1", "model": "VM-50", "family": "vm", "serial": "007200001", "sw-version": "11.1.2",
            "vm-cores": 4, "vm-mem": 16777216, "operational-mode": "normal", "is-dhcp": "no", "is-dhcp6": "yes",
            "_uptime_seconds": 2616376, "app-version": "8800", "av-version": "0", "threat-version": 8801,
            "vm-mac-count": "256",
        }
    },
    "resource_usage": {
        "cpu_user": 9.0, "cpu_system": "16.4", "cpu_idle": 62.7, "memory_total_mib": 16030.8, "memory_free_mib": 919,
        "memory_usage_percent": 31.216, "swap_total_mib": 4000.0, "load_average_1min": 0.81, "tasks_total": 247,
        "tasks_zombie": 1,
    },
    "disk_usage": {"/": {"device": "/dev/root", "size": "12G", "used": "6.9G", "available": "2T", "use_percent": "61"}},
    "ha_status": {"enabled": "no", "group": {"mode": "Active-Passive"}},
}


def envelope(data, **extra):
    return {"success": True, "hostname": None, "error": None, "data": data, **extra}


def one(points, name):
    found = [p for p in points if p["measurement"] == name]
    assert len(found) == 1, found
    return found[0]


def test_system_module(points_of):
    points = points_of({"system": {"fw1": envelope(SYSTEM)}})
    names = sorted(p["measurement"] for p in points)
    assert names == [
        "content_versions", "cpu_usage", "disk_usage", "ha_status", "load_average", "mac_count", "memory_usage",
        "swap_usage", "system_identity", "system_uptime", "task_stats",
    ]
    identity = one(points, "system_identity")
    assert identity["tags"] == {"hostname": "edge-1", "model": "VM-50", "family": "vm", "serial": "007200001"}
    assert identity["fields"]["is_dhcp"] is False and identity["fields"]["is_dhcp6"] is True
    assert identity["fields"]["vm_cores"] == 4 and identity["fields"]["vm_mem_mb"] == 16384.0
    assert one(points, "system_uptime")["fields"] == {"uptime_seconds": 2616376, "uptime_days": 30.28}
    cpu = one(points, "cpu_usage")["fields"]
    assert (cpu["cpu_user"], cpu["cpu_system"], cpu["cpu_idle"], cpu["cpu_total_used"]) == (9.0, 16.4, 62.7, 37.3)
    memory = one(points, "memory_usage")["fields"]
    assert memory["memory_usage_percent"] == 31.22
    assert memory["memory_free_mib"] == 919 and isinstance(memory["memory_free_mib"], int)
    assert one(points, "swap_usage")["fields"] == {"swap_total_mib": 4000.0, "swap_usage_percent": 0.0}
    disk = one(points, "disk_usage")
    assert disk["tags"]["mount_point"] == "/" and disk["fields"] == {
        "use_percent": 61.0, "size_gb": 12.0, "used_gb": 6.9, "available_gb": 2048.0,
    }
    assert one(points, "ha_status")["fields"] == {"enabled": "no"}
    assert one(points, "content_versions")["fields"] == {"app_version": "8800", "av_version": 0, "threat_version": 8801}
    assert one(points, "mac_count")["fields"] == {"mac_count": 256}


def test_interfaces_single_entry_is_kept(points_of):
    data = {
        "interface_info": {
            "hw": {"entry": {"name": "ethernet1/1", "state": "up", "speed": "1000"}},
            "ifnet": {"entry": [{"name": "ethernet1/1", "zone": "lan", "vsys": 1, "ip": "10.0.0.1/24"}]},
        },
        "interface_counters": {
            "hw": {"entry": [{"name": "ethernet1/1", "port": {"rx-bytes": 1024000, "tx-bytes": 2048000, "rx-unicast": 1000}, "ibytes": 5}]},
            "ifnet": {"ifnet": {"entry": {"name": "ethernet1/1", "ibytes": 7, "tcp_conn": 2}}},
        },
    }
    points = points_of({"interfaces": {"fw1": envelope(data)}})
    info = one(points, "interface_info")
    assert info["tags"] == {"hostname": "fw1", "interface": "ethernet1/1"} and info["fields"]["speed"] == 1000
    assert one(points, "interface_logical")["tags"]["vsys"] == "1"
    hw = one(points, "interface_counters_hw")["fields"]
    assert (hw["rx_bytes"], hw["tx_bytes"], hw["rx_unicast"], hw["ibytes"]) == (1024000, 2048000, 1000, 5)
    assert one(points, "interface_counters_logical")["fields"] == {"ibytes": 7, "tcp_conn": 2}
    with_text = points_of({"interfaces": {"fw1": envelope(data)}}, none_text=True)
    assert one(with_text, "interface_info")["tags"]["type"] == "None"


ROUTES = {"vr1": {"0.0.0.0/0": [{"protocol": "static"}], "10.0.0.0/8": [{"protocol": "BGP "}, {"flags": "A C"}], "x": "text"}}


def test_routing_table_wins_over_its_fallbacks(points_of):
    data = {"routing_mode": "advanced", "routing_table": ROUTES, "static_routes": ROUTES, "bgp_routes": ROUTES}
    points = points_of({"routing": {"fw1": envelope(data)}})
    counts = one(points, "routing_table_counts")
    assert counts["fields"] == {"routes_static": 1, "routes_bgp": 1, "routes_connected": 1, "routes_total": 3}
    assert counts["tags"] == {"hostname": "fw1", "vrf": "vr1"}
    assert len(points) == 1


def test_fallbacks_count_when_the_routing_table_is_empty(points_of):
    data = {"routing_table": {}, "static_routes": ROUTES, "bgp_routes": {"vr1": {"p": [{}, {}]}}}
    points = points_of({"routing": {"fw1": envelope(data)}})
    assert one(points, "static_routes_count")["fields"] == {"static_routes": 3}
    assert one(points, "bgp_routes_count")["fields"] == {"bgp_routes": 2}


def test_older_routing_layout(points_of):
    data = {
        "routing_mode": "legacy",
        "routing_table": {"entry": [
            {"virtual-router": "vr1", "destination": "d1", "flags": "A S"}, {"destination": "d1", "flags": "A B"},
        ]},
    }
    points = points_of({"routing": {"fw1": envelope(data)}})
    by_vrf = {p["tags"]["vrf"]: p["fields"] for p in points}
    assert by_vrf == {
        "vr1": {"routes_static": 1, "routes_total": 1}, "default": {"routes_bgp": 1, "routes_total": 1},
    }


def test_older_peer_layout_becomes_peer_points(points_of):
    data = {
        "routing_mode": "legacy",
        "bgp_peer_status": {"entry": {
            "@peer": "isp", "status": "Established", "peer-address": "192.0.2.1", "peer-group": "up", "status-duration": "12.34",
            "msg-total-in": 5, "msg-update-in": 4,
        }},
        "bgp_summary": {"entry": {"@virtual-router": "vr9", "router_id": "1.1.1.1", "total_peers": 2}},
    }
    points = points_of({"routing": {"fw1": envelope(data)}})
    peer = one(points, "bgp_peer")
    assert peer["tags"] == {
        "hostname": "fw1", "peer_name": "isp", "peer_ip": "192.0.2.1", "peer_group": "up", "state": "Established",
    }
    assert peer["fields"] == {"status_time": 12.3, "state_up": 1, "messages_received": 5, "updates_received": 4}
    summary = one(points, "bgp_summary")
    assert summary["tags"]["vrf"] == "vr9" and summary["fields"] == {"total_peers": 2}


def test_peers_and_flat_summary(points_of):
    data = {
        "bgp_summary": {"router_id": "1.1.1.1", "local_as": 65000, "total_peers": 2, "peers_down": 0},
        "bgp_peer_status": {"isp": {"peer-ip": "192.0.2.1", "state": "Idle", "remote-as": 65001,
                                    "detail": {"messageStats": {"totalSent": 7, "keepalivesRecv": 3}}}},
    }
    points = points_of({"routing": {"fw1": envelope(data)}})
    summary = one(points, "bgp_summary")
    assert summary["tags"] == {"hostname": "fw1", "router_id": "1.1.1.1", "local_as": "65000"}
    assert summary["fields"]["total_peers"] == 2
    peer = one(points, "bgp_peer")["fields"]
    assert peer == {"remote_as": 65001, "state_up": 0, "messages_sent": 7, "keepalives_received": 3}


def counters(entries):
    return {"counters": {"fw1": envelope({"global_counters": {"global": {"counters": {"entry": entries}}}})}}


def test_counter_categories_need_five_entries(points_of):
    entries = [{"name": f"pkt_{i}", "value": 24821070 + i, "rate": i, "category": "packet"} for i in range(5)]
    entries += [{"name": f"s{i}", "value": i, "category": "session"} for i in range(4)]
    points = points_of(counters(entries))
    assert [p["measurement"] for p in points] == ["counters_packet"]
    assert points[0]["fields"]["pkt_4"] == 24821074 and points[0]["fields"]["pkt_3_rate"] == 3


def test_thousand_counters_are_kept(points_of):
    entries = [{"name": f"counter_{i}", "value": i, "category": "flow"} for i in range(1000)]
    assert len(one(points_of(counters(entries)), "counters_flow")["fields"]) == 1000


def test_remote_access_and_vpn(points_of):
    document = {
        "global_protect": {"fw1": envelope({
            "gateway_summary": {"entry": [{"name": "gw", "CurrentUsers": 15, "gateway_max_concurrent_tunnel": 100}]},
            "portal_summary": {"entry": [{"name": "portal", "successful_connections": 1000}]},
        })},
        "vpn": {"fw1": envelope({
            "vpn_flows": {"num_ipsec": 5, "num_sslvpn": 3, "total": 8, "IPSec": {"entry": {"name": "f", "state": "active", "id": "7"}}},
            "active_tunnels": {"entries": {"entry": {"name": "t", "gw": "g", "life": "3600"}}},
            "vpn_tunnels": {"entries": {"entry": {"name": "old"}}},
            "vpn_gateways": {"entries": {"entry": [{"name": "g", "v1": {"peer-id": "x(ipaddr:192.0.2.9)", "life": 28800}}]}},
            "ipsec_sa": {"entries": {"entry": [{"name": "t", "life": 3600, "remain": 2344}]}},
        })},
    }
    points = points_of(document)
    gateway = one(points, "gp_gateway")["fields"]
    assert gateway == {"current_users": 15, "previous_users": 0, "max_concurrent_tunnels": 100}
    assert one(points, "gp_portal")["fields"] == {"successful_connections": 1000}
    assert one(points, "vpn_flows")["fields"] == {"num_ipsec": 5, "num_sslvpn": 3, "total_flows": 8}
    assert one(points, "ipsec_flow")["fields"]["state_up"] == 1
    assert one(points, "vpn_tunnel")["tags"]["tunnel_name"] == "t"
    ike = one(points, "vpn_gateway")["fields"]
    assert (ike["peer_ip"], ike["local_ip"], ike["ike_version"], ike["lifetime"]) == ("192.0.2.9", "", 1, 28800)
    assert one(points, "ipsec_sa")["fields"]["remaining_percent"] == 65.11


def test_environment_and_dataplane(points_of):
    data = {
        "environmental": {
            "thermal": {"Slot1": {"entry": [{"slot": 1, "description": "CPU", "DegreesC": "41.55", "max": "80", "alarm": False}]}},
            "fan": {"Slot1": {"entry": {"slot": 1, "description": "Fan 1", "RPMs": "7000", "alarm": True}}},
            "power-supply": {"Slot1": {"entry": {"slot": 1, "Inserted": True, "min": True, "alarm": False}}},
        },
        "extended_cpu": {"resource-monitor": {"s1dp0": {"second": {
            "task": {"flow_lookup": "12%", "zip_result": "0%"},
            "resource-utilization": {"entry": [{"name": "Packet Buffer", "value": "1,2,4"}, {"name": "session", "value": "1,x"}]},
            "cpu-load-average": {"entry": [{"coreid": 0, "value": "0,1"}, {"coreid": 1, "value": "3"}]},
        }}}},
    }
    points = points_of({"system": {"fw1": envelope(data)}})
    assert one(points, "env_thermal")["fields"] == {"temperature_c": 41.55, "max_temp_c": 80.0, "alarm": 0}
    assert one(points, "env_fan")["fields"] == {"rpm": 7000, "alarm": 1}
    assert one(points, "env_power_supply")["fields"] == {"inserted": 1, "min_required": 1, "alarm": 0}
    tasks = one(points, "cpu_dataplane_tasks")
    assert tasks["tags"]["dp_id"] == "s1dp0"
    assert tasks["fields"] == {"task_flow_lookup": 12.0, "task_zip_result": 0.0, "resource_packet_buffer_avg": 2.33, "cpu_cores": 2}
    cores = {p["tags"]["core_id"]: p["fields"]["cpu_utilization_avg"] for p in points if p["measurement"] == "cpu_dataplane_cores"}
    assert cores == {"0": 0.5, "1": 3.0}


def test_failed_and_several_devices(points_of, collections_of):
    document = {"system": {
        "fw1": envelope({"resource_usage": {"cpu_idle": 80}}), "fw2": envelope({"resource_usage": {"cpu_idle": 85}}, hostname="two"),
        "fw3": {"success": False, "data": None, "error": "Connection failed"},
    }}
    cpu = {p["tags"]["hostname"]: p["fields"]["cpu_idle"] for p in points_of(document) if p["measurement"] == "cpu_usage"}
    assert cpu == {"fw1": 80.0, "two": 85.0}
    _, failed = collections_of(document)
    assert [(r.device, r.error) for r in failed.collect()] == [("fw3", "Connection failed")]


@pytest.mark.parametrize("document", [{}, {"system": {}}, {"system": {"fw1": envelope({"system_info": None, "disk_usage": []})}}])
def test_empty_documents(points_of, document):
    assert points_of(document) == []


def test_malformed_snapshot_goes_to_quarantine(spark):
    from fleetlens.sources import snapshots

    raw = spark.createDataFrame([('{"system": {"a"',), (json.dumps({"system": {}}),)], "payload string")
    good, bad = snapshots.parsed(raw)
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(Exception):
        snapshots.parsed(raw, strict=True)[0].collect()


def test_known_collections_give_the_same_points(collections_of):
    from fleetlens.operators import project

    rows, _ = collections_of({"counters": {"fw1": envelope({})}, "routing": {"fw1": envelope({"routing_table": ROUTES})}})
    present = {r[0] for r in rows.select("collection").distinct().collect()}
    as_json = lambda df: sorted(df.select("measurement", "tags", "fields").toJSON().collect())
    assert as_json(project.points(rows, present=present)) == as_json(project.points(rows))


def test_landed_collections_give_the_same_points(spark, collections_of, tmp_path):
    from fleetlens.operators import project
    from fleetlens.sources import store

    rows, _ = collections_of({"routing": {"fw1": envelope({"routing_table": ROUTES, "bgp_routes": ROUTES})}})
    store.write_collections(rows, str(tmp_path / "bronze"))
    landed = store.read_collections(spark, str(tmp_path / "bronze"))
    as_json = lambda df: sorted(df.select("measurement", "tags", "fields").toJSON().collect())
    expected = as_json(project.points(rows, present={"routing_table"}))
    assert expected and as_json(project.points(landed, present={"routing_table"})) == expected
