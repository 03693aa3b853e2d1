"""Token-id output: documents as separately compressed frames over one shared dictionary.

A folder holds `dictionary` (zstandard, trained on serialised id arrays),
`manifest.json` and shards.  A shard is a header (magic, bytes per id, hash of
the dictionary), one zstandard frame per document, and an index (doc_id, byte
offset and tokens of each document) whose place its last 16 bytes tell.  One
short document is read with one seek; a reader with another dictionary fails at
once.  Shards are in ascending doc_id order, and the manifest tells how many
tokens stand before each.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .encode import encoder

MAGIC = b"NLTOKENS"
#: Documents and bytes, at most, that the dictionary is trained on, and its size.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 16 << 20, 64 << 10
#: Documents of a shard.
SHARD_DOCUMENTS = 50_000


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else fs.FileSystem.from_uri("file:///" + uri.removeprefix("file:").lstrip("/"))


def _ids(batch: pa.RecordBatch, path: str, end_id: int | None) -> Iterator[np.ndarray]:
    counts, (flat, *_) = encoder(path).encode(batch.column("text"))
    at = np.concatenate([[0], np.cumsum(counts)])
    tail = np.array([end_id] if end_id is not None else [], np.uint32)
    for i in range(batch.num_rows):
        yield np.concatenate([flat[at[i] : at[i + 1]], tail])


def _sampler(path: str, end_id: int | None, kind: str):
    def run(batches):
        for batch in T.slices(batches):
            yield pa.RecordBatch.from_pydict({"b": pa.array([x.astype(kind).tobytes() for x in _ids(batch, path, end_id)], pa.binary())})

    return run


def _writer(folder: str, path: str, end_id: int | None, kind: str, dictionary: bytes, level: int):
    digest = hashlib.sha256(dictionary).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        task = TaskContext.get()
        shard, name = task.partitionId(), f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out, doc_ids, offsets, tokens, at = None, [], [], [], 0
        for batch in T.slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), _ids(batch, path, end_id)):
                if out is None:  # an empty partition leaves no file
                    out = files.open_output_stream(f"{root}/{name}.part")
                    out.write(MAGIC + struct.pack("<H", np.dtype(kind).itemsize) + digest)
                    at = len(MAGIC) + 2 + len(digest)
                frame = pack.compress(ids.astype(kind).tobytes())
                out.write(frame)
                doc_ids.append(doc_id)
                offsets.append(at)
                tokens.append(len(ids))
                at += len(frame)
        if out is None:
            return
        null = np.array([d is None for d in doc_ids])
        out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null.astype("u1").tobytes() + np.array([*offsets, at], "<i8").tobytes() + np.array(tokens, "<u4").tobytes())
        out.write(struct.pack("<qq", at, len(doc_ids)))
        out.close()
        files.move(f"{root}/{name}.part", f"{root}/{name}")  # whole or not there: a retry writes a file of its own
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "documents": pa.array([len(doc_ids)], pa.int64()), "tokens": pa.array([sum(tokens)], pa.int64())})

    return run


def write_tokens(documents: DataFrame, path: str, folder: str | None = None, end_id: int | None = 2, level: int = 3) -> str:
    """Encode every whole text and write the folder; returns its URI.

    Null and empty texts are documents of the end id alone.  Repeated rows are
    documents of their own, next to each other; rows without a doc_id come
    first.  An empty table gives a manifest without shards.  Other columns are
    ignored.  The dictionary is trained on at most SAMPLE_DOCUMENTS documents
    and SAMPLE_BYTES bytes, chosen by a hash of doc_id; without enough of them
    there is none.
    """
    spark = T.prepare(documents.sparkSession)
    folder = folder or f"{T.shared_folder(spark).rstrip('/')}/netloom-tokens/{uuid.uuid4().hex}"
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    kind = "<u2" if encoder(path).size <= 1 << 16 else "<u4"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = documents.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, total))
    chosen = texts.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    samples, held = [], 0
    for row in chosen.mapInArrow(_sampler(path, end_id, kind), "b binary").toLocalIterator(prefetchPartitions=True):
        samples.append(bytes(row.b))
        held += len(row.b)
        if held >= SAMPLE_BYTES or len(samples) >= SAMPLE_DOCUMENTS:
            break
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform
        dictionary = b""
    with files.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)
    shards = T.pieces_of(spark, total, SHARD_DOCUMENTS)
    written = (
        texts.repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(_writer(folder, path, end_id, kind, dictionary, level), "shard int, name string, documents long, tokens long")
        .collect()  # a row for each shard
    )
    start, listed = 0, []
    for row in sorted(written, key=lambda r: r.shard):
        listed.append({"name": row.name, "documents": row.documents, "tokens": row.tokens, "start": start})
        start += row.tokens
    with files.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"dictionary": hashlib.sha256(dictionary).hexdigest(), "shards": listed}).encode())
    return folder


class Shard:
    """Reader of one shard: any document by its place, without the others."""

    def __init__(self, folder: str, name: str):
        files, root = _filesystem(folder)
        with files.open_input_file(f"{root}/dictionary") as f:
            dictionary = f.read()
        self.file = files.open_input_file(f"{root}/{name}")
        head = self.file.read_at(len(MAGIC) + 34, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is not a token shard")
        if head[len(MAGIC) + 2 :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.kind = {2: "<u2", 4: "<u4"}[struct.unpack_from("<H", head, len(MAGIC))[0]]
        size = self.file.size()
        at, n = struct.unpack("<qq", self.file.read_at(16, size - 16))
        index = self.file.read_at(size - 16 - at, at)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.null = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.offsets = np.frombuffer(index, "<i8", n + 1, 9 * n)
        self.tokens = np.frombuffer(index, "<u4", n, 17 * n + 8)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        raw = self.unpack.decompress(self.file.read_at(b - a, a), max_output_size=int(self.tokens[i]) * 4)
        return np.frombuffer(raw, self.kind).astype("<u4")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the folder: doc_id, start, n_tokens, ids_crc32 and, unless told otherwise, ids."""
    T.prepare(spark)
    files, root = _filesystem(folder)
    with files.open_input_file(f"{root}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (i for batch in batches for i in batch.column("id").to_pylist()):
            shard = Shard(folder, shards[number]["name"])
            starts = shards[number]["start"] + np.cumsum(shard.tokens, dtype=np.int64) - shard.tokens
            for a in range(0, len(shard), 500):
                b = min(len(shard), a + 500)
                ids = [shard.ids(i) for i in range(a, b)]
                columns = [
                    pa.array(shard.doc_ids[a:b], pa.int64(), mask=shard.null[a:b]),
                    pa.array(starts[a:b], pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, schema)
