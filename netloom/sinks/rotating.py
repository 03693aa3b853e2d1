"""Lines into files of bounded size of which the newest stay, as a stream's sink (`writeStream.format("rotating-lines")`).

A folder belongs to one stream.

Options: `path`, `maxBytes` of a file, `keep`, how many files stay (0: all).
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import datasource as ds
from pyspark.sql.streaming import DataStreamWriter

from ..sources.files import Staging, opened, visible

PREFIX = "alerts-"


class Lines(ds.WriterCommitMessage):
    """Staged files of one task, with the parts of their names that follow the batch's."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class RotatingWriter(ds.DataSourceStreamArrowWriter):
    """Each task writes files of up to `maxBytes`, or one line where that is longer; a batch's files appear when all its tasks are done.

    Names begin with the batch's number, so a batch that runs again replaces
    what it had left, and names in order are files from old to new.
    """

    def __init__(self, options):
        self.max_bytes, self.keep = int(options.get("maxBytes", 64 << 20)), int(options.get("keep", 0))
        if self.max_bytes < 1 or self.keep < 0:
            raise ValueError("maxBytes must be above 0, keep not below")
        self.staging = Staging(options["path"], "stream")

    def write(self, iterator):
        files, stream, held = [], None, 0
        for batch in iterator:
            for value in batch.column("value").to_pylist():
                line = (value or "").encode() + b"\n"
                if stream is not None and held + len(line) > self.max_bytes:
                    stream.close()
                    stream = None
                if stream is None:
                    staged, stream = self.staging.create()
                    files.append((staged, f"{TaskContext.get().partitionId():06d}-{len(files):06d}.jsonl"))
                    held = 0
                stream.write(line)
                held += len(line)
        if stream is not None:
            stream.close()
        return Lines(files)

    def commit(self, messages, batchId):
        batch = f"{PREFIX}{batchId:012d}-"
        self.staging.publish([(staged, batch + name) for m in messages if m for staged, name in m.files], batch)
        if self.keep:
            store, _ = opened(self.staging.path)
            for f in [f for f in visible(self.staging.path) if f.base_name.startswith(PREFIX)][: -self.keep]:
                store.delete_file(f.path)

    def abort(self, messages, batchId):
        self.staging.discard()


class RotatingSink(ds.DataSource):
    @classmethod
    def name(cls):
        return "rotating-lines"

    def streamWriter(self, schema, overwrite):
        return RotatingWriter(self.options)


def writer(lines: DataFrame, path: str, max_bytes: int = 64 << 20, keep: int = 0) -> DataStreamWriter:
    """A stream with a column `value`, such as alerts.json_lines gives, on its way into `path`; needs a checkpointLocation to start."""
    lines.sparkSession.dataSource.register(RotatingSink)
    return lines.select("value").writeStream.format("rotating-lines").options(path=path, maxBytes=max_bytes, keep=keep)
