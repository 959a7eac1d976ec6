"""Reading and writing the store's own files: logs, runs, JSON dumps, metric texts."""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bloom import StoredFilter, bloom_size
from ..operators.changes import DEL, PUT, op_name
from ..session import create_file, file_system, names_in, read_file, remove

LOG_SCHEMA = "path string, op string, key string, value binary, ver long, ts long, vc map<string,bigint>"
RUN_SCHEMA = "path string, level int, run_id long, key string, value binary, version long, ts_ns long, tombstone boolean, vc map<string,bigint>"

# Operation bytes of a log record, first byte of a run's row, limits of lengths.
_OPS = {0: PUT, 1: DEL}
_ROW = 0xBF
_MAX_KEY, _MAX_PART = 1 << 20, 10 << 20
_TAIL = struct.Struct("<QqBI")  # version, ns, operation, length of the clock


def encode_record(op: str, key: str, value: bytes, ver: int, ts: int, vc: dict | None = None) -> bytes:
    """A log record: key and value with their lengths, version, time, operation, clock as JSON with its length."""
    k, clock = key.encode(), json.dumps(vc).encode()
    return struct.pack("<I", len(k)) + k + struct.pack("<I", len(value)) + value + _TAIL.pack(ver, ts, 1 if op == DEL else 0, len(clock)) + clock


def _record_at(data: bytes, at: int) -> tuple[tuple, int] | None:
    """The record that starts at a byte, and where it ends; None if none does."""
    room = len(data)
    if at + 4 > room:
        return None
    (n,) = struct.unpack_from("<I", data, at)
    key_end = at + 4 + n
    if n > _MAX_KEY or key_end + 4 > room:
        return None
    (m,) = struct.unpack_from("<I", data, key_end)
    value_end = key_end + 4 + m
    if m > _MAX_PART or value_end + _TAIL.size > room:
        return None
    ver, ts, op, c = _TAIL.unpack_from(data, value_end)
    end = value_end + _TAIL.size + c
    if op not in _OPS or c > _MAX_PART or end > room:
        return None
    try:
        clock = json.loads(data[value_end + _TAIL.size:end]) if c else None
        key = data[at + 4:key_end].decode()
        if clock is not None and not (isinstance(clock, dict) and all(isinstance(x, int) for x in clock.values())):
            return None
    except ValueError:
        return None
    return (_OPS[op], key, data[key_end + 4:value_end], ver if ver < 1 << 63 else ver - (1 << 64), ts, clock), end


def records(data: bytes) -> Iterator[tuple]:
    """All records of a log file; where none starts, reading goes on with the next byte."""
    at = 0
    while at < len(data):
        found = _record_at(data, at)
        if found is None:
            at += 1
        else:
            yield found[0]
            at = found[1]


def _legacy(data: bytes) -> Iterator[tuple]:
    """Records of the older form, a JSON object per line; malformed lines are skipped, clocks aren't carried."""
    for line in data.splitlines():
        try:
            r = json.loads(line)
            yield (DEL if r.get("op") == DEL else PUT, r["key"], base64.b64decode(r.get("value") or ""), int(r.get("ver") or 0), int(r.get("ts") or 0), None)
        except (ValueError, KeyError, TypeError, AttributeError):
            continue


def read_log(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """Rows of log files in either form (told apart by the first byte), from a byte offset on.

    A file is one record stream without markers, so a file is read by one task; the store's logs are
    segments of bounded size. Corrupt stretches are skipped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = data[offset:]
                rows = [(name, *r) for r in (_legacy(data) if data[:1] == b"{" else records(data))]
                for i in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[i:i + 10_000]))
                    cols[-1] = [None if c is None else list(c.items()) for c in cols[-1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _LOG_TYPES)], ["path", "op", "key", "value", "ver", "ts", "vc"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, LOG_SCHEMA)


_MAP = pa.map_(pa.string(), pa.int64())
_LOG_TYPES = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), _MAP]


def read_legacy_log(df: DataFrame, line: str = "value") -> DataFrame:
    """The older form from a table of lines, on the JVM side: op, key, value (bytes), ver, ts; malformed lines are dropped."""
    r = F.from_json(F.col(line), "op string, key string, value string, ver long, ts long")
    rows = df.select(r.alias("r")).filter(F.col("r.key").isNotNull()).select("r.*")
    return rows.select(F.when(F.col("op") == DEL, DEL).otherwise(PUT).alias("op"), "key", F.expr("try_to_binary(value, 'base64')").alias("value"), F.coalesce("ver", F.lit(0)).alias("ver"), F.coalesce("ts", F.lit(0)).alias("ts"))


def to_legacy_lines(log: DataFrame) -> DataFrame:
    """Changes as JSON lines: op, key, value in base64 (as stored), ver, ts."""
    return log.select(F.to_json(F.struct(op_name(F.col("op")).alias("op"), "key", "value", "ver", "ts")).alias("value"))


def write_log(rows: DataFrame, path: str, per_file: int = 100_000, noise: bytes = b"") -> DataFrame:
    """Rows (op, key, value bytes, ver, ts, vc) as log segments of at most ``per_file`` records: file, records, bytes.

    Segments are named by partition and number, so a task that runs again writes the same files. ``noise`` is
    put between the records (for tests of salvage). JSON lines become segments by way of ``read_legacy_log``;
    nothing is merged on the way.
    """
    from pyspark import TaskContext

    where = _address(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, []

        def flush(records: list[bytes]) -> pa.RecordBatch:
            name, data = f"{where}/segment-{part:05d}-{n:05d}.wal", noise.join(records)
            _store(name, data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)], pa.int64()), pa.array([len(data)], pa.int64())], ["file", "records", "bytes"])

        for b in batches:
            for op, key, value, ver, ts, vc in zip(*(c.to_pylist() for c in b.columns)):
                held.append(encode_record(op, key, value or b"", ver, ts, dict(vc) if vc is not None else None))
                if len(held) == per_file:
                    yield flush(held)
                    n, held = n + 1, []
        if held:
            yield flush(held)

    return rows.select("op", "key", "value", "ver", "ts", "vc").mapInArrow(run, "file string, records long, bytes long")


def _address(spark: SparkSession, path: str) -> str:
    """A path as an address that pyarrow opens too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file:///" + full[6:].lstrip("/") if full.startswith("file:/") else full


def _store(address: str, data: bytes) -> None:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(address)
    system.create_dir(at.rsplit("/", 1)[0])
    with system.open_output_stream(at) as out:
        out.write(data)


def log_size(spark: SparkSession, path: str) -> DataFrame:
    """One row: files and bytes of a log, from the listing alone; its records are ``read_log(...).count()``."""
    return spark.read.format("binaryFile").load(path).select("length").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def reset_log(spark: SparkSession, path: str) -> None:
    """An empty log in place of what is there."""
    remove(spark, path)
    fs, at = file_system(spark, path)
    fs.mkdirs(at)


class LogMark:
    """The position up to which a log has been taken over: saved as numbered files, of which the newest holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> int | None:
        names = names_in(self.spark, self.path)
        return int(read_file(self.spark, f"{self.path}/{names[-1]}")) if names else None

    def save(self, position: int) -> None:
        names = names_in(self.spark, self.path)
        if not create_file(self.spark, f"{self.path}/{int(names[-1]) + 1 if names else 1:010d}", str(position).encode()):
            raise RuntimeError("another writer has saved a position")

    def truncate(self, log: DataFrame, position: str) -> DataFrame:
        """The log without what lies before the mark; rows without a position stay."""
        at = self.load()
        return log if at is None else log.filter((F.col(position) >= at) | F.col(position).isNull())


# -- runs ------------------------------------------------------------------------------------------------
def _row(data: bytes) -> tuple | None:
    """key, value, version, ns, tombstone, clock out of a run's row."""
    if data[:1] != bytes([_ROW]):
        return None
    (n,) = struct.unpack_from("<I", data, 1)
    at = 5 + n
    (m,) = struct.unpack_from("<I", data, at)
    value = data[at + 4:at + 4 + m]
    ver, ts, dead, c = _TAIL.unpack_from(data, at + 4 + m)
    at += 4 + m + _TAIL.size
    clock = None
    if c:
        clock, (count,), p = {}, struct.unpack_from("<I", data, at), at + 4
        for _ in range(count):
            (k,) = struct.unpack_from("<H", data, p)
            clock[data[p + 2:p + 2 + k].decode()] = struct.unpack_from("<Q", data, p + 2 + k)[0]
            p += 10 + k
    return data[5:5 + n].decode(), value, ver, ts, dead == 1, clock


def encode_run(rows: list[tuple], rate: float = 0.01) -> bytes:
    """A run file of rows (key, value, version, ns, tombstone, clock) in key order: rows, packed where that is shorter; index; filter; footer."""
    import zstandard

    squeeze, data, index = zstandard.ZstdCompressor(), bytearray(), []
    for key, value, ver, ts, dead, vc in rows:
        k, clock = key.encode(), b""
        if vc:
            clock = struct.pack("<I", len(vc)) + b"".join(struct.pack("<H", len(n.encode())) + n.encode() + struct.pack("<Q", c) for n, c in vc.items())
        body = bytes([_ROW]) + struct.pack("<I", len(k)) + k + struct.pack("<I", len(value)) + value + _TAIL.pack(ver, ts, int(dead), len(clock)) + clock
        packed = squeeze.compress(body)
        if use := len(packed) < len(body):
            body = packed
        index.append({"k": key, "o": len(data), "s": len(body) + 4, "c": use, "b": True})
        data += struct.pack("<I", len(body)) + body
    text = json.dumps(index).encode()
    sieve = StoredFilter.of([r[0].encode() for r in rows], *bloom_size(len(rows), rate)).dump()
    at = len(data)
    return bytes(data) + text + sieve + struct.pack("<4Q", at, len(text), at + len(text), len(sieve))


def write_run_files(rows: DataFrame, path: str, level: int, run_id: int) -> DataFrame:
    """Rows (key, value bytes, version, ts_ns, tombstone, vc) as run files, one for each range of keys: file, rows."""
    from pyspark import TaskContext

    where = _address(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]  # a run file is one value in memory when it is read, too
        if held:
            name = f"{where}/L{level}_{run_id + TaskContext.get().partitionId()}.sst"
            _store(name, encode_run([(k, v or b"", *rest[:3], dict(rest[3]) if rest[3] else None) for k, v, *rest in held]))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], ["file", "rows"])

    cut = rows.select("key", "value", "version", "ts_ns", "tombstone", "vc").repartitionByRange("key").sortWithinPartitions("key")
    return cut.mapInArrow(run, "file string, rows long")


def read_runs(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """Rows of run files (``L<level>_<nanos>.sst``): footer, JSON index, then each row, unpacked if packed.

    Unreadable rows are skipped. Level and run id come from the file's name. With ``keys`` only these are
    unpacked, and none of a file whose filter rules them out.
    """
    wanted = None if keys is None else frozenset(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                named = re.search(r"L(\d+)_(\d+)\.sst$", name)
                if len(data) < 32:
                    continue
                at, size, sieve, length = struct.unpack("<4Q", data[-32:])
                if wanted is not None and length and not StoredFilter.read(data[sieve:sieve + length]).may_hold([k.encode() for k in wanted]).any():
                    continue
                rows = []
                for entry in json.loads(data[at:at + size]):
                    if wanted is not None and entry.get("k") not in wanted:
                        continue
                    try:
                        body = data[entry["o"] + 4:entry["o"] + entry["s"]]
                        got = _row(unzip.decompress(body, max_output_size=64 << 20) if entry.get("c") else body)
                    except (ValueError, struct.error, zstandard.ZstdError, KeyError):
                        continue
                    if got:
                        rows.append((name, int(named[1]) if named else None, int(named[2]) if named else None, *got[:5], None if got[5] is None else list(got[5].items())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RUN_TYPES)], _RUN_NAMES)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RUN_SCHEMA)


_RUN_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), _MAP]
_RUN_NAMES = ["path", "level", "run_id", "key", "value", "version", "ts_ns", "tombstone", "vc"]


def write_run(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """A run as Parquet: ranges of keys, sorted, with a Bloom filter on the key; only what narrows the files is packed."""
    ranged = df.repartitionByRange(partitions, "key") if partitions else df.repartitionByRange("key")
    ranged.sortWithinPartitions("key").write.option("compression", "zstd").option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run files with level, run id and size, newest first by name."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    name = F.regexp_extract("path", r"L(\d+)_\d+\.sst$", 1), F.regexp_extract("path", r"L\d+_(\d+)\.sst$", 1)
    return files.filter(F.col("path").rlike(r"L\d+_\d+\.sst$")).select("path", name[0].cast("int").alias("level"), name[1].cast("long").alias("run_id"), "bytes").orderBy(F.desc("path"))


# -- JSON and metrics ------------------------------------------------------------------------------------
def import_json(df: DataFrame, text: str = "value") -> DataFrame:
    """JSON objects of texts as rows: key, value, and ok (false for a null value or an empty key)."""
    pairs = df.select(F.explode(F.from_json(F.col(text), "map<string,string>")).alias("key", "value"))
    return pairs.withColumn("ok", (F.col("key") != "") & F.col("value").isNotNull())


def export_json(live: DataFrame, rows: int = 10_000) -> DataFrame:
    """Visible rows as JSON objects of ``rows`` keys each in key order (``block``), to be written as lines.

    One object of all rows would be a single value; the objects follow each other in key order.
    """
    from ..operators.snapshot import global_rank

    ranked = global_rank(live.select("key", "value"), [F.col("key")], "pos")
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    return ranked.groupBy(F.floor(F.col("pos") / rows).alias("block")).agg(F.to_json(pairs).alias("json"))


def export_document(live: DataFrame) -> DataFrame:
    """All visible rows as the lines of one indented JSON object in key order: ``pos`` and ``line``, to be written in order.

    No value holds more than a row; the braces are the lines before the first and after the last.
    """
    from ..operators.snapshot import global_rank

    ranked = global_rank(live.select("key", "value"), [F.col("key")], "pos", "total")
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    entry = F.concat(F.lit("  "), text("key"), F.lit(": "), F.when(F.col("value").isNull(), "null").otherwise(text("value")), F.when(F.col("pos") < F.col("total") - 1, ",").otherwise(""))
    edges = live.sparkSession.createDataFrame([("{",), ("}",)], "line string")
    ends = edges.select(F.when(F.col("line") == "{", -1).otherwise(F.lit(1 << 62)).cast("long").alias("pos"), "line")
    return ranked.select("pos", entry.alias("line")).unionByName(ends)


def parse_metrics(df: DataFrame, line: str = "value") -> DataFrame:
    """Samples of a metrics text: name, labels (text within braces), value; comments, NaN and non-numbers are dropped."""
    words = F.split(F.trim(F.col(line)), r"\s+(?=\S+$)")
    number = F.expr("try_cast(element_at(__w, -1) as double)")
    rows = df.filter(~F.ltrim(F.col(line)).startswith("#") & (F.trim(F.col(line)) != "")).withColumn("__w", words).withColumn("v", number)
    head = F.col("__w")[0]
    return rows.filter((F.size("__w") > 1) & F.col("v").isNotNull() & ~F.isnan("v")).select(F.regexp_extract(head, r"^([^{\s]+)", 1).alias("name"), F.regexp_extract(head, r"\{(.*)\}", 1).alias("labels"), F.col("v").alias("value"))


def format_metrics(gauges: DataFrame) -> DataFrame:
    """Lines ``name value`` of gauges (name, value)."""
    return gauges.select(F.format_string("%s %s", "name", F.col("value").cast("string")).alias("value"))
