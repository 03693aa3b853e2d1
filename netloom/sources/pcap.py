"""Classic pcap files as a Spark data source (`spark.read.format("pcap")`), for batch and streams, to read and to write.

Options of the reader: `path`, a file or a folder; `decoded`, true for the
fields of decode.RAW instead of frames.  Streams also take `maxBytesPerTrigger`,
`growing`, for a newest file that is still written to, and `placeFile`.
"""

from __future__ import annotations

import io
import json
import operator
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from . import decode
from .files import Staging, opened, visible, whole_path

SCHEMA = "seq long, ts_ns long, frame binary, linktype int"
#: Frames of a file number from its place in the order of files times this.
FILE_STRIDE = 1 << 40
#: Longer records mean a broken file.
MOST_BYTES = 268_435_456
#: A batch ends at so many records, or bytes.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
HEAD = 24
# Magic numbers, with byte order and nanoseconds of a fraction's unit.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}


class PcapError(ValueError):
    pass


class Truncated(PcapError):
    pass


def _exactly(stream, n: int) -> bytes:
    """n bytes, or b'' at the end of the stream."""
    data = stream.read(n)
    while 0 < len(data) < n and (more := stream.read(n - len(data))):
        data += more
    if data and len(data) < n:
        raise Truncated("record is cut off")
    return data


def _head(stream) -> tuple[str, int, int]:
    """Byte order, nanoseconds of a fraction's unit, link type."""
    head = stream.read(HEAD)
    if len(head) < HEAD or head[:4] not in MAGICS:
        raise PcapError("not a pcap file")
    order, unit = MAGICS[head[:4]]
    return order, unit, struct.unpack(order + "I", head[20:24])[0]


def _length(n: int) -> int:
    if n > MOST_BYTES:
        raise Truncated("record is too long")
    return n


def read_pcap(stream, start: int = HEAD, end: int | None = None) -> Iterator[tuple[int, bytes, int]]:
    """(time in nanoseconds, frame, link type) of each record, from byte `start`, where a record begins, to byte `end`."""
    order, unit, linktype = _head(stream)
    if start > HEAD:
        stream.seek(start)
    at = start
    while (end is None or at < end) and (record := _exactly(stream, 16)):
        seconds, fraction, n, _ = struct.unpack(order + "IIII", record)
        frame = _exactly(stream, _length(n)) if n else b""
        if len(frame) < n:
            raise Truncated("record is cut off")
        at += 16 + n
        yield seconds * 1_000_000_000 + fraction * unit, frame, linktype


def boundary(stream, size: int, start: int, budget: int) -> tuple[int, int]:
    """(byte, records) of the last end of a record within `budget` bytes from `start`, but of one record at least where a whole one is there."""
    order, _, _ = _head(stream)
    at, records = start, 0
    while at + 16 <= size:
        stream.seek(at)
        after = at + 16 + _length(struct.unpack(order + "I", _exactly(stream, 16)[8:12])[0])
        if after > size or (records and after - start > budget):
            break
        at, records = after, records + 1
    return at, records


def write_pcap(stream, records, linktype: int = 1, snaplen: int = 65535) -> int:
    """Writes (time in nanoseconds, frame) records, little-endian, in microseconds."""
    stream.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, linktype))
    n = 0
    for ts_ns, frame in records:
        stream.write(struct.pack("<IIII", ts_ns // 1_000_000_000, ts_ns // 1000 % 1_000_000, len(frame), len(frame)) + frame)
        n += 1
    return n


def _buffered(path: str) -> io.BufferedReader:
    store, at = opened(path)
    return io.BufferedReader(store.open_input_file(at), 1 << 20)


class Piece(ds.InputPartition):
    """Records of one file from byte `start` to byte `end`, the first of which has number `seq`."""

    def __init__(self, path: str, seq: int, start: int = HEAD, end: int | None = None):
        self.path, self.seq, self.start, self.end = path, seq, start, end


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    seq, ts, frame, link = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(ts, pa.int64()), pa.array(frame, pa.binary()), pa.array(link, pa.int32())], names=["seq", "ts_ns", "frame", "linktype"])


def _batches(piece: Piece, decoded: bool, timely=None, likely=None) -> Iterator[pa.RecordBatch]:
    """A piece's records whose time passes `timely` and, before anything else of them is decoded, whose protocol and ports pass `likely`."""
    with _buffered(piece.path) as stream:
        rows: list[tuple] = []
        held = 0
        for i, (ts_ns, frame, linktype) in enumerate(read_pcap(stream, piece.start, piece.end)):
            if (timely and not timely(ts_ns)) or (likely and not likely(frame)):
                continue
            rows.append((piece.seq + i, ts_ns, frame, linktype))
            held += len(frame)
            if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                yield decode.decoded(rows) if decoded else _batch(rows)
                rows, held = [], 0
        if rows:
            yield decode.decoded(rows) if decoded else _batch(rows)


_COMPARISONS = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le, ds.In: lambda a, values: a in values}
_TIMES, _PLACES = {"ts_ns": 1, "ts_us": 1000}, {"ip_proto": 0, "src_port": 1, "dst_port": 2}


class Wanted:
    """Pushed filters on time, protocol and ports.  They only sort out early: Spark asks all of them again."""

    def __init__(self, filters: list[ds.Filter], decoded: bool):
        self.times: list[tuple] = []
        self.places: list[tuple] = []
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in _TIMES and not (decoded and column in _PLACES):
                continue
            if isinstance(f, ds.IsNotNull):
                test = (_always, None)
            elif type(f) in _COMPARISONS:
                test = (_COMPARISONS[type(f)], tuple(f.value) if isinstance(f, ds.In) else f.value)
            else:
                continue
            (self.times if column in _TIMES else self.places).append((_TIMES.get(column, _PLACES.get(column)), *test))

    def timely(self, ts_ns: int) -> bool:
        return all(test(ts_ns // unit, value) for unit, test, value in self.times)

    def likely(self, frame: bytes) -> bool:
        seen = decode.peek(frame)
        return seen is None or all(seen[i] is not None and test(seen[i], value) for i, test, value in self.places)


def _always(seen, value) -> bool:
    return True


def _flag(options, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


class PcapReader(ds.DataSourceReader):
    def __init__(self, options):
        self.path, self.decoded = options["path"], _flag(options, "decoded")
        self.wanted = Wanted([], self.decoded)

    def partitions(self):
        return [Piece(whole_path(self.path, f), i * FILE_STRIDE) for i, f in enumerate(visible(self.path))]

    def read(self, partition):
        w = self.wanted
        return _batches(partition, self.decoded, w.timely if w.times else None, w.likely if w.places else None)


class PushedReader(PcapReader):
    """The reader where the session lets Python sources take filters."""

    def pushFilters(self, filters):
        self.wanted = Wanted(filters, self.decoded)
        return filters


class PcapStreamReader(ds.DataSourceStreamReader):
    """Files of a folder in the order of their names, each once; an offset is a place in a file.

    `number` counts files, `byte` is where the next record begins and `record`
    its number in the file, -1 after a whole file, whose records nobody
    counted.  A batch takes whole files up to `maxBytesPerTrigger`; a longer
    file is cut at a record, for which only the record heads are looked up.  A
    file is taken as finished when it is seen, unless `growing` says that the
    newest one is not: its whole records are taken, and the rest when it is
    there.  A file that comes behind the stream's place, that grows after it was
    taken whole, or that is gone when a restarted stream counts its files,
    raises PcapError: nothing is left out or numbered twice unnoticed.

    Spark does not tell a Python source how far its log goes.  So the first
    batch after a start can be all that is there, unless `placeFile` names a file,
    one for each query, in which the place of the last logged batch is kept.
    Rows are those of Spark's log in either case.
    """

    def __init__(self, options):
        self.path, self.decoded, self.growing = options["path"], _flag(options, "decoded"), _flag(options, "growing")
        self.budget = int(options.get("maxBytesPerTrigger", 1 << 30))
        self.place, self.place_file = None, options.get("placeFile")

    def initialOffset(self):
        return {"file": "", "number": -1, "byte": HEAD, "record": 0}

    def latestOffset(self):
        if self.place is not None:
            self.place = self.advance(self.place, self.budget)
        elif self.place_file:
            self.place = self.advance(self._told() or self.initialOffset(), self.budget)
        else:
            self.place = self.advance(self.initialOffset(), 1 << 62)
        return self.place

    def _told(self) -> dict | None:
        store, at = opened(self.place_file)
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(at) as f:
            return json.loads(f.read())

    def _tell(self, place: dict) -> None:
        store, at = opened(self.place_file)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at + ".next") as f:
            f.write(json.dumps(place).encode())
        store.move(at + ".next", at)

    def advance(self, start: dict, budget: int) -> dict:
        """The end of the batch that begins at `start`."""
        files = visible(self.path)
        if sum(f.base_name <= start["file"] for f in files) > start["number"] + 1:
            raise PcapError(f"a file whose name is before {start['file']} came after it was read")
        at, left = start, budget
        files = [f for f in files if f.base_name >= start["file"]]
        for i, f in enumerate(files):
            growing, again = self.growing and i == len(files) - 1, f.base_name == at["file"]
            if left <= 0 or (growing and f.size < HEAD):
                break
            here = at if again else {"file": f.base_name, "number": at["number"] + 1, "byte": HEAD, "record": 0}
            rest = f.size - here["byte"]
            if rest < 0:
                raise PcapError(f"{f.base_name} is no pcap file, or became shorter")
            if rest and here["record"] < 0:
                raise PcapError(f"{f.base_name} grew after it was read whole")
            if rest <= left and not growing:
                at, left = here | {"byte": f.size, "record": here["record"] if again and not rest else -1}, left - rest
                continue
            if left == budget or growing:
                with _buffered(whole_path(self.path, f)) as stream:
                    byte, records = boundary(stream, f.size, here["byte"], left)
                if byte == here["byte"] and not growing:
                    raise Truncated(f"{f.base_name} is cut off")
                at = here | {"byte": byte, "record": here["record"] + records}
            break
        return at

    def partitions(self, start, end):
        if self.place is None or (end["number"], end["byte"]) > (self.place["number"], self.place["byte"]):
            self.place = end
        if self.place_file and start != end:
            self._tell(end)
        if (end["number"], end["byte"]) < (start["number"], start["byte"]):
            raise PcapError(f"the log of the stream is ahead of {self.place_file or 'the folder'}")
        files = [f for f in visible(self.path) if start["file"] <= f.base_name <= end["file"]]
        new = [f for f in files if f.base_name != start["file"]]
        if start["number"] + len(new) != end["number"]:
            raise PcapError("files were taken away that the log of the stream still counts")
        pieces = []
        for f in files:
            again = f.base_name == start["file"]
            number = start["number"] if again else start["number"] + 1 + new.index(f)
            first, record = (start["byte"], start["record"]) if again else (HEAD, 0)
            last = end["byte"] if f.base_name == end["file"] else f.size
            if first < last:
                pieces.append(Piece(whole_path(self.path, f), number * FILE_STRIDE + record, first, last))
        return pieces

    def read(self, partition):
        return _batches(partition, self.decoded)


class PcapWriter(ds.DataSourceArrowWriter):
    """Rows with `ts_ns` and `frame` as one file for each partition that has rows, named by its number; they appear together or not at all."""

    def __init__(self, path: str):
        self.staging = Staging(path)

    def write(self, iterator):
        staged, stream = None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if stream is None:
                staged, stream = self.staging.create()
                write_pcap(stream, [])
            body = io.BytesIO()
            write_pcap(body, zip(batch.column("ts_ns").to_pylist(), batch.column("frame").to_pylist()))
            stream.write(body.getvalue()[HEAD:])
        if stream is None:
            return Written([])
        stream.close()
        return Written([(staged, f"part-{TaskContext.get().partitionId():06d}-{self.staging.job[:8]}.pcap")])

    def commit(self, messages):
        self.staging.publish([f for m in messages if m for f in m.files])

    def abort(self, messages):
        self.staging.discard()


class Written(ds.WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class PcapSource(ds.DataSource):
    """One partition per file; a file can't be split in a batch, as records don't tell where they start."""

    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return decode.RAW if _flag(self.options, "decoded") else SCHEMA

    def reader(self, schema):
        return PushedReader(self.options) if _flag(self.options, "pushed") else PcapReader(self.options)

    def streamReader(self, schema):
        return PcapStreamReader(self.options)

    def writer(self, schema, overwrite):
        return PcapWriter(self.options["path"])


def read(spark: SparkSession, path: str, decoded: bool = False) -> DataFrame:
    """Frames, or with `decoded` the fields of decode.RAW, of a file or of the files of a folder.

    Filters on time, protocol and ports reach the reader, ahead of decoding,
    where the session has spark.sql.python.filterPushdown.enabled.
    """
    spark.dataSource.register(PcapSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("pcap").option("decoded", decoded).option("pushed", pushed).load(path)


def write(frames: DataFrame, path: str) -> None:
    """frames(ts_ns, frame) as pcap files, one a partition, in the order of partitions and rows."""
    frames.sparkSession.dataSource.register(PcapSource)
    frames.select("ts_ns", "frame").write.format("pcap").mode("append").save(path)


def stream(spark: SparkSession, path: str, decoded: bool = False, growing: bool = False, max_bytes: int = 1 << 30, place_file: str | None = None) -> DataFrame:
    """The same of a folder into which captures are moved, or with `growing` written, as a stream."""
    spark.dataSource.register(PcapSource)
    more = {"placeFile": place_file} if place_file else {}
    return spark.readStream.format("pcap").options(decoded=decoded, growing=growing, maxBytesPerTrigger=max_bytes, **more).load(path)
