"""Exact dedup by Grace hashing over complete texts.

Every partition of the input first merges the copies it holds itself, so a text that makes up a third of all rows
travels once per partition and not once per row. What is left is dealt out by the text's digest, and each
receiving task runs a Grace hash table: distinct texts sit in an open-addressing table that compares complete
contents; once they outgrow the task's budget they are partitioned to spill files by the next digit of the digest, and
each file is treated the same way until its texts fit. Spill files live in the task's own temporary folder, are read
only by that task and are gone when it ends, so a lost executor costs its tasks and nothing else.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.columns import text_of, unpacked, whole_row
from fleetlens.llm.shared import ids_side, written

#: Bytes of distinct texts that one task keeps in memory.
BUDGET = 12 << 20
#: Texts with copies (about 200 bytes each) that may be sent to every executor.
BROADCAST_GROUPS = 150_000
#: Spill files for each level of partitioning: one for each hexadecimal digit.
DIGITS = "0123456789abcdef"


def _winners(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stay, and how many input rows each stands for.

    Open addressing with linear probing on the first 64 bits of the digest; two rows are one text only if their
    complete contents are equal. Of equal texts the largest doc_id stays, null being the smallest; among rows equal
    in both, the first.
    """
    n = table.num_rows
    digests, texts = table["digest"].to_pylist(), table["text"]
    ids, counts = table["id"].to_pylist(), table["n"].to_pylist()
    slots = [-1] * (1 << max(4, (2 * n).bit_length()))
    mask, best, total = len(slots) - 1, {}, {}
    for i in range(n):
        at = int(digests[i][:16], 16) & mask
        while (k := slots[at]) >= 0 and digests[k] != digests[i]:
            at = (at + 1) & mask
        if k >= 0 and texts[k] != texts[i]:
            raise ValueError(f"two texts share the digest {digests[i]}")
        if k < 0:
            slots[at] = best[i] = i
            total[i] = counts[i]
        else:
            total[k] += counts[i]
            if ids[i] is not None and (ids[best[k]] is None or ids[i] > ids[best[k]]):
                best[k] = i
    return np.fromiter(best.values(), "int64", len(best)), np.fromiter(total.values(), "int64", len(total))


def _merged(batches: list[pa.RecordBatch]) -> pa.Table:
    table = pa.Table.from_batches(batches).combine_chunks()
    rows, total = _winners(table)
    kept = table.take(pa.array(rows))
    at = kept.column_names.index("n")
    return kept.set_column(at, kept.schema.field(at), pa.array(total))


def _sized(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes at most, or single rows."""
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in piece.columns], schema=piece.schema)


def combined(budget: int):
    """Merges the copies a task meets, a memory budget at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in _sized(batches, budget // 4):
            held.append(piece)
            size += piece.nbytes
            if size > budget:
                yield from _merged(held).to_batches()
                held, size = [], 0
        if held:
            yield from _merged(held).to_batches()

    return run


def grace(batches: Iterator[pa.RecordBatch], budget: int, folder: str, level: int = 0) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text; spills by digit ``level`` of the digest when the texts outgrow ``budget``."""
    held, size, files, names = [], 0, {}, {}

    def spill(batch: pa.RecordBatch | pa.Table) -> None:
        digit = pc.utf8_slice_codeunits(batch["digest"], 16 + level, 17 + level)
        for d in DIGITS:
            part = batch.filter(pc.equal(digit, d))
            if part.num_rows:
                if d not in files:
                    names[d] = os.path.join(folder, f"{level}-{len(os.listdir(folder))}-{d}.arrow")
                    files[d] = pa.ipc.new_file(names[d], part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                files[d].write(part)

    for piece in _sized(batches, budget // 4):
        if files:
            spill(piece)
            continue
        held.append(piece)
        size += piece.nbytes
        if size > budget:
            table = _merged(held)
            held, size = table.to_batches(), table.nbytes
            if size > budget // 2 and table.num_rows > 1 and 17 + level < 64:
                spill(table)
                held = []
    if held:
        yield from _merged(held).to_batches()
    for d, writer in files.items():
        writer.close()
    for d in list(files):
        with pa.ipc.open_file(names[d]) as reader:
            yield from grace((reader.get_batch(i) for i in range(reader.num_record_batches)), budget, folder, level + 1)
        os.remove(names[d])


def _reduced(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            yield from grace(batches, budget, folder)

    return run


def _distinct(df: DataFrame, budget: int) -> DataFrame:
    """df: digest, text, id, n and what else a row carries."""
    once = df.mapInArrow(combined(budget), df.schema)
    return once.repartition("digest").mapInArrow(_reduced(budget), df.schema)


def dedup(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the largest doc_id.

    A null text counts as empty, a null doc_id as the smallest. Of rows equal in text and doc_id one stays. An empty
    table gives an empty table. Other columns are carried along, whatever their names.
    """
    text = text_of(docs)
    base = [F.sha2(text, 256).alias("digest"), text.alias("text"), docs["doc_id"].cast("long").alias("id"), F.lit(1).cast("long").alias("n")]
    if dict(docs.dtypes).get("text") != "string":
        return unpacked(_distinct(docs.select(*base, whole_row(docs).alias("row")), budget), "row")
    # a text that is a string travels once, beside the rest of its row
    rest = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"])
    found = _distinct(docs.select(*base, docs["text"].isNull().alias("missing"), rest.alias("row")), budget)
    own = F.when(~F.col("missing"), F.col("text")).alias("text", metadata=docs.schema["text"].metadata)
    return found.select(*[own if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def copies(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Nulls and ties as in ``dedup``: of rows equal in text and doc_id exactly one is marked as kept. keep_id is null
    only where all rows of a text have a null doc_id; then one of them is kept. The texts that have copies are written
    as a small table of digests; rows look their digest up there, without a shuffle while that table is small, and else
    in a join in which Spark can split the rows of a large group.
    """
    text = text_of(docs)
    slim = docs.select(F.sha2(text, 256).alias("digest"), docs["doc_id"].cast("long").alias("id"))
    rows = docs.select(
        F.sha2(text, 256).alias("digest"), text.alias("text"), docs["doc_id"].cast("long").alias("id"),
        F.lit(1).cast("long").alias("n"),
    )
    groups = written(_distinct(rows, budget).filter("n > 1").select("digest", F.col("id").alias("keep"), "n"), "copied")
    joined = slim.join(ids_side(groups, BROADCAST_GROUPS), "digest", "left")
    # only rows that have copies can be equal in doc_id as well; all others are numbered where they are
    single = joined.filter("n is null").select("id", "digest", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("nth"))
    several = joined.filter("n is not null").selectExpr(
        "id", "digest", "keep", "n", "row_number() over (partition by digest, id order by n) as nth"
    )
    numbered = single.unionByName(several)
    return numbered.select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep")) & (F.col("nth") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
