import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def collections_of(spark):
    """Collection rows of a snapshot given as a Python dict."""
    import json

    from pyspark.sql import functions as F

    from fleetlens.sources import snapshots

    def build(document, at="2024-01-01 00:00:00"):
        raw = spark.createDataFrame([(json.dumps(document),)], "payload string").withColumn(
            "collected_at", F.lit(at).cast("timestamp")
        )
        good, bad = snapshots.parsed(raw)
        assert bad.count() == 0
        rows = snapshots.envelopes(good)
        return snapshots.collections(rows), snapshots.failed(rows)

    return build


@pytest.fixture(scope="session")
def points_of(collections_of):
    """Points with host names of a snapshot, as dicts."""
    from fleetlens.operators import joins, project

    def build(document, **options):
        rows, _ = collections_of(document)
        parts = [e.get("data") or {} for devices in document.values() for e in devices.values()]
        options.setdefault("present", {name for part in parts for name in part})
        points = project.with_hostname(project.points(rows, **options), joins.host_names(rows))
        out = []
        for row in points.collect():
            fields = {}
            for name, value in row["fields"].items():
                fields[name] = next(v for v in value if v is not None)
            out.append({"measurement": row["measurement"], "tags": dict(row["tags"]), "fields": fields})
        return out

    return build
