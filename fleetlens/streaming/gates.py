"""Expectations that a stream has to meet, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CLOSED = "gate closed"


class GateClosed(RuntimeError):
    """A batch in which too few rows keep a rule."""

    def __init__(self, batch_id: int, shares: Mapping[str, float]):
        said = ", ".join(f"{rule} {share:.4f}" for rule, share in sorted(shares.items()))
        super().__init__(f"{CLOSED} at batch {batch_id}: {said}")


def gated(
    rules: Mapping[str, Column], least: Mapping[str, float], write: Callable[[DataFrame, int], None], held: str,
    divert: Callable[[DataFrame, int], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Writer of micro-batches that passes a batch on only if, for every rule, the share of its rows that keep it is
    ``least`` or more.

    A batch is landed once below ``held`` in the shared folder, which counts its rows on the way; what is passed on is read
    from there, so the stream's work is done once. A batch below a limit goes to ``divert``, and the stream goes on; without
    ``divert`` the stream stops: batches before it stay, and it comes again first when the stream is started anew. A
    rule that is null for a row is not kept; an empty batch keeps all.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        seen, names = Observation(), sorted(rules)
        kept = [F.count_if(F.coalesce(rules[name], F.lit(False))).alias(name) for name in names]
        path = f"{held}/batch_id={batch_id}"
        batch.observe(seen, F.count(F.lit(1)).alias("rows of the batch"), *kept).write.mode("overwrite").parquet(path)
        counts = seen.get
        total = counts["rows of the batch"]
        shares = {name: counts[name] / total for name in names if total and counts[name] < least[name] * total}
        landed = batch.sparkSession.read.schema(batch.schema).parquet(path)
        if not shares:
            write(landed, batch_id)
        elif divert:
            divert(landed, batch_id)
        else:
            raise GateClosed(batch_id, shares)

    return run


def ended_at_gate(query: StreamingQuery) -> bool:
    """Waits for a query and tells whether a gate stopped it; any other error is raised."""
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if CLOSED not in str(e):
            raise
        return True
    return False
