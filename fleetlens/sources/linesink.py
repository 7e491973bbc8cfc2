"""Line text with a commit: what a task writes counts only once the whole job, or micro-batch, has ended well.

Each attempt of a task writes a file of its own below ``_pending``. A commit moves the files that the successful attempts
report to their names, which are made of batch and partition, lists them in a manifest and removes what other attempts
left behind; an abort removes everything. A micro-batch that is written again after its commit is seen by its manifest
and thrown away. Paths may be of any store that Arrow reaches (local, HDFS, object stores).

    spark.dataSource.register(linesink.LineSink)
    lines.write.format("line_sink").mode("append").save(path)
    stream.writeStream.format("line_sink").option("checkpointLocation", c).start(path)
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

PENDING, MANIFEST = "_pending", "_manifest"

# the workers that plan and commit get no files sent to the executors, so the classes go by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Written(WriterCommitMessage):
    """A pending file, its partition and its lines."""

    file: str
    partition: int
    lines: int


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Committing:
    """Files of one job or stream: written as pending, then moved together."""

    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        partition, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        store, root = _store(self.path)
        folder = f"{root}/{PENDING}/{self.job}"
        store.create_dir(folder, recursive=True)
        file, count = f"{folder}/{partition}-{attempt}-{uuid.uuid4().hex}.txt", 0
        with store.open_output_stream(file) as out:
            for row in iterator:
                if row[0] is not None:
                    out.write(row[0].encode() + b"\n")
                    count += 1
        return Written(file, partition, count)

    def commit_as(self, messages: list, name: str) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        manifest = f"{root}/{MANIFEST}/{name}.json"
        if store.get_file_info(manifest).type == fs.FileType.NotFound:
            listed = []
            for m in messages:
                if m is None or not m.lines:
                    continue
                final = f"{root}/part-{name}-{m.partition:05d}.txt"
                if store.get_file_info(m.file).type != fs.FileType.NotFound:
                    store.move(m.file, final)
                listed.append({"file": final.rsplit("/", 1)[1], "lines": m.lines})
            store.create_dir(f"{root}/{MANIFEST}", recursive=True)
            draft = f"{manifest}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(json.dumps(listed).encode())
            store.move(draft, manifest)
        for m in messages:
            if m is not None and store.get_file_info(m.file).type != fs.FileType.NotFound:
                store.delete_file(m.file)

    def clear(self) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        folder = f"{root}/{PENDING}/{self.job}"
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class BatchWriter(_Committing, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self.commit_as(messages, self.job)
        self.clear()

    def abort(self, messages: list) -> None:
        self.clear()


class StreamWriter(_Committing, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.commit_as(messages, f"{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        from pyarrow import fs

        store, _ = _store(self.path)
        for m in messages:
            if m is not None and store.get_file_info(m.file).type != fs.FileType.NotFound:
                store.delete_file(m.file)


class LineSink(DataSource):
    """Text files of the first column; appends only."""

    @classmethod
    def name(cls) -> str:
        return "line_sink"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("line_sink appends; choose an empty folder to begin anew")
        return BatchWriter(self.options["path"], uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], uuid.uuid4().hex)
