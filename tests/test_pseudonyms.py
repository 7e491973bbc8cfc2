"""Two-pass pseudonyms on documents."""

import json

from pyspark.sql import functions as F

from fleetlens.operators import pseudonyms

DOCUMENT = {
    "system": {"branch-fw": {"success": True, "data": {"system_info": {"system": {
        "hostname": "branch-fw", "serial": "012345678901", "mac-address": "aa:bb:cc:dd:ee:ff", "ip-address": "10.1.2.3/24",
        "public-ip-address": "8.8.4.4", "default-gateway": "unknown", "note": "peer 8.8.4.4(ipaddr:10.1.2.3) and 127.0.0.1",
    }}}}},
    "routing": {"branch-fw": {"data": {
        "bgp_peer_status": {"isp-a": {"peer-group-name": "uplinks", "remote-as": 65010, "serial": 42, "peer-ip": "999.1.1.1"}},
        "routing_table": {"LR-WAN": {"0.0.0.0/0": [{"nexthop": "8.8.4.4"}]}},
    }}},
    "vpn": {"branch-fw": {"data": {"ipsec_sa": {"entries": {"entry": [{"name": "to-hq", "gateway": "hq-gw"}]}}}}},
    "interfaces": {"branch-fw": {"data": {"fwd": "vlan:office", "ok": True, "none": None}}},
}


def run(spark, level, previous=None, document=DOCUMENT):
    docs = spark.createDataFrame([(0, json.dumps(document))], "position bigint, doc string")
    out, mapping = pseudonyms.pseudonymised(docs, "doc", level, previous=previous)
    return json.loads(out.first().text), mapping


def test_standard(spark):
    out, mapping = run(spark, "standard")
    info = out["system"]["firewall-01"]["data"]["system_info"]["system"]
    assert info == {
        "hostname": "firewall-01", "serial": "10000000001", "mac-address": "00:00:5e:00:01:01", "ip-address": "10.0.1.7/24",
        "public-ip-address": "192.0.2.1", "default-gateway": "unknown", "note": "peer 192.0.2.1(ipaddr:10.0.1.7) and 127.0.0.1",
    }
    peer = out["routing"]["firewall-01"]["data"]["bgp_peer_status"]["bgp-peer-01"]
    assert peer == {"peer-group-name": "peer-group-01", "remote-as": 65010, "serial": "10000000002", "peer-ip": "999.1.1.1"}
    assert out["routing"]["firewall-01"]["data"]["routing_table"] == {"vr-01": {"0.0.0.0/0": [{"nexthop": "192.0.2.1"}]}}
    assert out["vpn"]["firewall-01"]["data"]["ipsec_sa"]["entries"]["entry"] == [{"name": "vpn-tunnel-01", "gateway": "ike-gateway-01"}]
    assert out["interfaces"]["firewall-01"]["data"] == {"fwd": "vlan:vlan-01", "ok": True, "none": None}


def test_levels(spark):
    out, _ = run(spark, "minimal")
    info = out["system"]["firewall-01"]["data"]["system_info"]["system"]
    assert info["mac-address"] == "aa:bb:cc:dd:ee:ff" and info["ip-address"] == "10.1.2.3/24" and info["public-ip-address"] == "192.0.2.1"
    assert "LR-WAN" in out["routing"]["firewall-01"]["data"]["routing_table"]
    out, _ = run(spark, "paranoid")
    assert out["routing"]["firewall-01"]["data"]["bgp_peer_status"]["bgp-peer-01"]["remote-as"] == 64513


def test_known_values_keep_their_surrogates(spark):
    _, first = run(spark, "standard")
    first = first.cache()
    document = {"system": {"new-fw": {"hostname": "branch-fw", "public-ip-address": "8.8.8.8"}}}
    out, mapping = run(spark, "standard", first, document)
    assert out == {"system": {"firewall-02": {"hostname": "firewall-01", "public-ip-address": "192.0.2.2"}}}
    assert mapping.count() == first.count() + 2


def test_surrogates_never_repeat(spark):
    numbers = spark.range(1, 200_001).select(F.col("id").alias("n"))
    for kind in ("public_ip", "private_ip", "mac", "serial", "hostname", "asn"):
        made = numbers.select(pseudonyms.surrogate(F.lit(kind), F.col("n")).alias("s"))
        assert made.distinct().count() == 200_000, kind
