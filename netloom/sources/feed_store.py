"""Feeds that change: versions of each feed's prefixes, the last good one kept while others move on, and batches pinned to what they saw."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import quote

from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookups
from .feeds import feed_stats, parse_feed
from .files import opened

#: A feed with more bytes is refused.
MOST_BYTES = 64 << 20


class FeedStore:
    """A shared folder with a table for each good state of a feed and a manifest for each version.

    A manifest tells of each feed which of its states holds, how many of its
    lines are good and not, and why its newest state was refused, if it was.
    It is written after the tables, and by one refresh at a time, so a refresh
    that dies leaves the version before.
    """

    def __init__(self, spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES):
        self.spark, self.folder, self.most_bytes = spark, folder.rstrip("/"), most_bytes

    def _read(self, name: str) -> dict | None:
        store, at = opened(f"{self.folder}/{name}")
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(at) as f:
            return json.loads(f.read())

    def _write(self, name: str, value: dict) -> None:
        store, at = opened(f"{self.folder}/{name}")
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at + ".next") as f:
            f.write(json.dumps(value, sort_keys=True).encode())
        store.move(at + ".next", at)

    def version(self) -> int:
        """The newest version, 0 before the first."""
        newest = self._read("newest.json")
        return newest["version"] if newest else 0

    def manifest(self, version: int | None = None) -> dict:
        """{source: {state, valid, invalid, error}} of a version, the newest if none is told."""
        version = self.version() if version is None else version
        return self._read(f"manifests/{version}.json") or {} if version else {}

    def _table(self, source: str, state: int) -> str:
        return f"{self.folder}/states/{quote(source, safe='')}/{state}"

    def _take(self, source: str, path: str, state: int) -> dict:
        lines = self.spark.read.text(path)
        size = lines.agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
        if size > self.most_bytes:
            raise ValueError(f"{size} bytes, more than {self.most_bytes}")
        stats = feed_stats(lines).first()
        if not stats.valid:
            raise ValueError("no good line")
        parse_feed(lines, source).write.mode("overwrite").parquet(self._table(source, state))
        return {"state": state, "valid": stats.valid, "invalid": stats.invalid, "error": None}

    def refresh(self, paths: dict[str, str]) -> dict:
        """A new version of these feeds.  One that can't be read, is too large or has no good line keeps its last state and tells why.

        Feeds that are not among `paths` are left out of the version; a feed
        that has never been good has no state.
        """
        version, last, new = self.version() + 1, self.manifest(), {}
        for source, path in paths.items():
            try:
                new[source] = self._take(source, path, version)
            except (PySparkException, ValueError) as e:
                held = last.get(source, {"state": None, "valid": 0, "invalid": 0})
                new[source] = held | {"error": str(e).splitlines()[0][:200]}
        self._write(f"manifests/{version}.json", new)
        self._write("newest.json", {"version": version})
        return new

    def prefixes(self, version: int | None = None) -> DataFrame:
        """The prefix table of a version; where feeds share a prefix, the one that comes last by name tells its source."""
        held = [(source, m["state"]) for source, m in sorted(self.manifest(version).items()) if m["state"] is not None]
        if not held:
            return self.spark.createDataFrame([], lookups.PREFIXES)
        return lookups.merge_prefixes([self.spark.read.parquet(self._table(*h)) for h in held])

    def pinned(self, query: str, batch: int) -> int:
        """The version that a query's batch sees: the newest when it runs first, and the same when it runs again."""
        pin = self._read(f"pins/{quote(query, safe='')}.json")
        if pin is None or pin["batch"] < batch:
            pin = {"batch": batch, "version": self.version()}
            self._write(f"pins/{quote(query, safe='')}.json", pin)
        elif pin["batch"] > batch:
            raise ValueError(f"batch {batch} of {query} is before {pin['batch']}, which has run")
        return pin["version"]

    def each_batch(self, query: str, use: Callable[[DataFrame, DataFrame, int, int], None]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: `use(rows, prefixes, version, batch)` with the prefixes of the batch's version."""

        def run(rows: DataFrame, batch: int) -> None:
            version = self.pinned(query, batch)
            use(rows, self.prefixes(version), version, batch)

        return run
