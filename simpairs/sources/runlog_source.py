"""Run logs as a Spark data source (A9-A12, A15): ``spark.read.format("runlog")``.

``kind`` names what is read below ``path``, one folder ``version_<n>`` a run:

* ``metrics``: lines of the metric files, by each file's own header;
* ``results``: every number of the result files;
* ``hparams``: every key of the option files;
* ``log``: rows of a metric log that this source wrote.

A batch read deals files out by bytes: a large metric file becomes several
ranges, small files share a partition.  Conditions on ``run_id`` choose files
before any is opened.  A streaming read of ``metrics`` keeps the bytes read of
every file as its offset and takes in whole new lines only.

Very many runs can be kept in packs: tables of (path, content) in the folder
``packs`` of the root, each row one run file, or a stretch of whole lines of a
metric file below its header.  A pack is read by one task, row by row, as if
its rows were files; a batch read takes in loose files and packs alike.

A write stages its files and makes them part of the log by one small commit
file, named after the write's ``id`` (the micro-batch in a stream).  Without
that file nothing of a write is ever read; a write whose commit is there adds
nothing, so a replay leaves the log as it is.

Paths are those that pyarrow opens (local, shared or object storage).
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator, Sequence
from fnmatch import fnmatch
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan,
    GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..session import ship_package
from .runlogs import EPOCH, RUN_ID_PATTERN, STEP

SCHEMAS = {
    "metrics": "run_id int, epoch long, step long, values map<string,double>, _corrupt_record string",
    "results": "run_id int, metric string, value double",
    "hparams": "run_id int, options map<string,string>, parse_error string",
    "log": "run_id long, epoch long, metric string, value double",
}
ARROW = {
    "metrics": pa.schema([("run_id", pa.int32()), ("epoch", pa.int64()), ("step", pa.int64()), ("values", pa.map_(pa.string(), pa.float64())),
                          ("_corrupt_record", pa.string())]),
    "results": pa.schema([("run_id", pa.int32()), ("metric", pa.string()), ("value", pa.float64())]),
    "hparams": pa.schema([("run_id", pa.int32()), ("options", pa.map_(pa.string(), pa.string())), ("parse_error", pa.string())]),
    "log": pa.schema([("run_id", pa.int64()), ("epoch", pa.int64()), ("metric", pa.string()), ("value", pa.float64())]),
}
FILES = {"metrics": "metrics.csv", "results": "results.json", "hparams": "hparams.yaml"}
SPLIT_BYTES = 32 << 20
#: Bytes that a file counts for at least, so that many empty files are spread too.
OPEN_BYTES = 64 << 10
BATCH_ROWS = 10_000
PACKS = "packs"
#: Run files of one pack, and those that a task holds at a time.
PACK_FILES, PACK_ROWS = 5_000, 200
_INTEGER = re.compile(r"[+-]?\d+(\.0*)?$")


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


class Ranges(InputPartition):
    """Byte ranges of files: (path, run, start, end)."""

    def __init__(self, ranges: list[tuple[str, int | None, int, int]]) -> None:
        self.ranges = ranges


class Pack(InputPartition):
    """One pack of run files."""

    def __init__(self, path: str) -> None:
        self.path = path


def run_of(path: str) -> int | None:
    found = re.search(RUN_ID_PATTERN, path)
    return int(found[1]) if found else None


def run_files(fs: pafs.FileSystem, root: str, name: str) -> list[tuple[str, int | None, int]]:
    """(path, run, bytes) of the files ``<root>/<folder>/<name>``."""
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    depth = root.rstrip("/").count("/") + 2
    return sorted((f.path, run_of(f.path), f.size) for f in found
                  if f.type == pafs.FileType.File and f.path.count("/") == depth and fnmatch(f.base_name, name)
                  and f.path.split("/")[-2] != PACKS)


def pack_paths(fs: pafs.FileSystem, root: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(f"{root.rstrip('/')}/{PACKS}", allow_not_found=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".parquet"))


def parse_line(line: str, names: Sequence[str], run: int | None) -> tuple:
    """A metric line as a row; a line that does not fit its header, or holds a
    cell that is no number, is kept as ``_corrupt_record``.  Empty cells are
    null; of columns with one name the last counts."""
    cells, row = line.split(","), {}
    try:
        if len(cells) != len(names) or "_" in line:  # float() takes 1_000, a log does not
            raise ValueError(line)
        for name, cell in zip(names, cells):
            if cell and not cell.isspace():
                row[name] = float(cell)
            elif name in row:
                del row[name]
    except ValueError:
        return run, None, None, None, line
    at = [row.pop(c, None) for c in (EPOCH, STEP)]
    return run, *[None if x is None or math.isnan(x) else int(x) for x in at], list(row.items()), None


def lines_of(fs: pafs.FileSystem, path: str, start: int, end: int) -> Iterator[str]:
    """The header, then the lines that begin in [start, end), read in blocks.

    A line belongs to the range in which its first byte lies; the header line,
    wherever it is repeated, is no data."""
    with fs.open_input_file(path) as f:
        head = b""
        while b"\n" not in head and (block := f.read(1 << 16)):
            head += block
        head = head.split(b"\n")[0]
        yield head.decode(errors="replace").strip("\r")
        at = max(start - 1, 0)
        f.seek(at)
        rest, skip = b"", start > 0
        while at < end and (block := f.read(1 << 20)):
            rest += block
            *whole, rest = rest.split(b"\n")
            for line in whole:
                begins, at = at, at + len(line) + 1
                if skip:
                    skip = False
                elif begins >= end:
                    return
                elif line != head and line.strip():
                    yield line.decode(errors="replace").strip("\r")
        if rest.strip() and at < end and not skip and rest != head:
            yield rest.decode(errors="replace").strip("\r")


def wanted(run: int | None, filters: Sequence[Filter]) -> bool:
    for f in filters:
        if run is None:
            return False
        if isinstance(f, In):
            ok = run in f.value
        else:
            ok = {EqualTo: run == f.value, GreaterThan: run > f.value, GreaterThanOrEqual: run >= f.value,
                  LessThan: run < f.value, LessThanOrEqual: run <= f.value}[type(f)]
        if not ok:
            return False
    return True


def on_runs(f: Filter) -> bool:
    return isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("run_id",)


def dealt(files: Sequence[tuple[str, int | None, int, int]], split: int, whole: bool) -> list[Ranges]:
    """Ranges of files packed into partitions of about ``split`` bytes; a file
    above that is cut unless it must be read ``whole``."""
    parts: list[Ranges] = []
    held, size = [], 0
    for path, run, start, end in files:
        step = max(1, end - start) if whole else split
        for a in range(start, max(end, start + 1), step):
            b = min(end, a + step)
            if held and size + b - a > split:
                parts.append(Ranges(held))
                held, size = [], 0
            held.append((path, run, a, b))
            size += max(b - a, OPEN_BYTES)
    return parts + ([Ranges(held)] if held else [])


def parse_options(text: str) -> dict:
    """An option file's keys; libyaml reads it where it can, the other parser
    tells what is wrong with the rest."""
    import yaml

    try:
        found = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        found = yaml.safe_load(text)
    return found or {}


def rows_of(kind: str, run: int | None, text: str) -> Iterator[tuple]:
    """The rows of a whole run file."""
    if kind == "metrics":
        head, *lines = text.split("\n")
        names = [x.strip() for x in head.strip("\r").split(",")]
        for line in lines:
            if line != head and line.strip():
                yield parse_line(line.strip("\r"), names, run)
    elif kind == "results":
        for line in ([text] if text.count("{") == 1 else text.splitlines()):
            found = json.loads(line) if line.strip() else {}
            for k, v in found.items():
                if isinstance(v, (int, float)) and not isinstance(v, bool):
                    yield run, k, float(v)
    else:
        import yaml

        options, error = [], None
        try:
            options = [(str(k), json.dumps(v, default=str)) for k, v in parse_options(text).items()]
        except (yaml.YAMLError, AttributeError) as exc:  # kept and reported, never lost
            error = str(exc)
        yield run, options, error


def rows_of_ranges(root: str, kind: str, ranges: Sequence[tuple]) -> Iterator[tuple]:
    fs, _ = open_store(root)
    for path, run, start, end in ranges:
        if kind == "metrics":
            lines = lines_of(fs, path, start, end)
            names = [x.strip() for x in next(lines).split(",")]
            for line in lines:
                yield parse_line(line, names, run)
        else:
            with fs.open_input_stream(path) as f:
                text = f.read().decode(errors="replace")
            yield from rows_of(kind, run, text)


def rows_of_pack(root: str, kind: str, path: str, name: str, filters: Sequence[Filter]) -> Iterator[tuple]:
    """Rows of the pack's files of that name whose run fits the conditions."""
    fs, _ = open_store(root)
    with fs.open_input_file(path) as f:
        for batch in pq.ParquetFile(f).iter_batches(PACK_ROWS, columns=["path", "content"]):
            for file, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                run = run_of(file)
                if fnmatch(file.rsplit("/", 1)[-1], name) and wanted(run, filters):
                    yield from rows_of(kind, run, text)


def in_batches(rows: Iterator[tuple], kind: str) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, BATCH_ROWS)):
        yield as_batch(part, kind)


def read_ranges(root: str, kind: str, ranges: Sequence[tuple]) -> Iterator[pa.RecordBatch]:
    return in_batches(rows_of_ranges(root, kind, ranges), kind)


def as_batch(rows: Sequence[tuple], kind: str) -> pa.RecordBatch:
    schema = ARROW[kind]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class RunLogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.kind = options["path"], options.get("kind", "metrics")
        self.name = options.get("file", FILES.get(self.kind, ""))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if on_runs(f):
                self.filters.append(f)
                if self.kind != "log":
                    continue  # a file holds one run: nothing is left to test
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = open_store(self.root)
        if self.kind == "log":
            files = []
            for entry in committed(fs, root):
                lo, hi = entry["runs"]
                # A file is out only if some condition excludes its whole span.
                ends = [f for f in self.filters if not isinstance(f, (EqualTo, In))]
                points = [f for f in self.filters if isinstance(f, (EqualTo, In))]
                out = any(not wanted(hi, [f]) if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else not wanted(lo, [f]) for f in ends)
                out = out or any(not any(lo <= v <= hi for v in (f.value if isinstance(f, In) else [f.value])) for f in points)
                if not out:
                    files.append((f"{root}/{entry['file']}", None, 0, entry["bytes"]))
            return dealt(files, self.split, True) or [Ranges([])]
        files = [(p, run, 0, n) for p, run, n in run_files(fs, root, self.name) if wanted(run, self.filters)]
        # Spark reads a source without partitions as one without a partition object.
        return [*dealt(files, self.split, self.kind != "metrics"), *map(Pack, pack_paths(fs, root))] or [Ranges([])]

    def read(self, partition: Ranges | Pack) -> Iterator[pa.RecordBatch]:
        if self.kind == "log":
            fs, _ = open_store(self.root)
            for path, *_ in partition.ranges:
                with fs.open_input_file(path) as f:
                    yield from pq.ParquetFile(f).iter_batches()
        elif isinstance(partition, Pack):
            yield from in_batches(rows_of_pack(self.root, self.kind, partition.path, self.name, self.filters), self.kind)
        else:
            yield from read_ranges(self.root, self.kind, partition.ranges)


class RunLogStream(DataSourceStreamReader):
    """Metric files that grow: an offset is the bytes taken in of every file."""

    def __init__(self, options: dict) -> None:
        self.root, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.name = options.get("file", FILES["metrics"])

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = open_store(self.root)
        return {path: end for path, _, size in run_files(fs, root, self.name) if (end := last_line_end(fs, path, size))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return dealt([(p, run_of(p), start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)], self.split, False)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from read_ranges(self.root, "metrics", partition.ranges)


def last_line_end(fs: pafs.FileSystem, path: str, size: int) -> int:
    """The byte after the last whole line."""
    with fs.open_input_file(path) as f:
        at = size
        while at > 0:
            low = max(0, at - (1 << 16))
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


class Staged(WriterCommitMessage):
    def __init__(self, files: list[dict]) -> None:
        self.files = files


def committed(fs: pafs.FileSystem, root: str) -> list[dict]:
    """File entries of all committed writes, in order of their ids."""
    found = fs.get_file_info(pafs.FileSelector(f"{root}/_commits", allow_not_found=True))
    out: list[dict] = []
    for info in sorted(found, key=lambda f: f.base_name):
        if info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                out += json.loads(f.read())
    return out


class LogFiles:
    """Staging, commit and abort of the files of one write."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"]

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        """One file of this task; rows are written as they come."""
        fs, root = open_store(self.root)
        fs.create_dir(f"{root}/files")
        name, writer, lo, hi, schema = f"files/{uuid.uuid4().hex}.parquet", None, None, None, ARROW["log"]
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch]).select(schema.names).cast(schema)
                runs = [r for r in table["run_id"].to_pylist() if r is not None]
                lo, hi = min([*runs, *([] if lo is None else [lo])], default=None), max([*runs, *([] if hi is None else [hi])], default=None)
                writer = writer or pq.ParquetWriter(fs.open_output_stream(f"{root}/{name}"), schema)
                writer.write_table(table)
        finally:
            if writer is not None:
                writer.close()
        if writer is None:
            return Staged([])
        return Staged([{"file": name, "bytes": fs.get_file_info(f"{root}/{name}").size, "runs": [lo if lo is not None else 0, hi if hi is not None else -1]}])

    def finish(self, messages: Sequence[Staged | None], write_id: str) -> None:
        fs, root = open_store(self.root)
        fs.create_dir(f"{root}/_commits")
        target = f"{root}/_commits/{write_id}.json"
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            self.drop(messages)  # the write is there already
            return
        entries = [e for m in messages if m is not None for e in m.files]
        aside = f"{root}/_commits/.{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as f:
            f.write(json.dumps(entries).encode())
        fs.move(aside, target)

    def drop(self, messages: Sequence[Staged | None]) -> None:
        fs, root = open_store(self.root)
        for m in messages:
            for e in m.files if m is not None else []:
                fs.delete_file(f"{root}/{e['file']}")


class RunLogWriter(LogFiles, DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options)
        if overwrite:
            raise ValueError("a metric log is only appended to")
        self.write_id = options.get("id") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: list) -> None:
        self.finish(messages, f"write-{self.write_id}")

    def abort(self, messages: list) -> None:
        self.drop(messages)


class RunLogStreamWriter(LogFiles, DataSourceStreamArrowWriter):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.stream = options.get("id", "stream")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.finish(messages, f"{self.stream}-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        self.drop(messages)


class RunLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "runlog"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "metrics")]

    def reader(self, schema) -> RunLogReader:
        return RunLogReader(dict(self.options))

    def streamReader(self, schema) -> RunLogStream:
        return RunLogStream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RunLogWriter:
        return RunLogWriter(dict(self.options), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> RunLogStreamWriter:
        return RunLogStreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``format("runlog")`` known to the session, with filters pushed down."""
    ship_package(spark)
    spark.dataSource.register(RunLogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load_runs(spark: SparkSession, path: str, kind: str, file: str | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("runlog").option("kind", kind)
    return (reader.option("file", file) if file else reader).load(path)


def append_log(long: DataFrame, path: str, write_id: str) -> None:
    """Append rows (run_id, epoch, metric, value) to the log once per ``write_id``."""
    register(long.sparkSession)
    rows = long.selectExpr("cast(run_id as long) run_id", "cast(epoch as long) epoch", "metric", "cast(value as double) value")
    rows.sortWithinPartitions("run_id").write.format("runlog").option("kind", "log").option("id", write_id).mode("append").save(path)


def write_packs(files: DataFrame, path: str) -> None:
    """Run files (path, content) into packs below the log root.  One file per
    run costs a folder, a commit and a listing entry each; packs cost their
    bytes, so this is the form for very many runs."""
    files.select("path", "content").write.mode("append").option("maxRecordsPerFile", PACK_FILES).parquet(f"{path}/{PACKS}")
