"""Gridded files of the classic NetCDF format (its three versions, uncompressed) as a Spark data source, read and written by tasks.

Reading: a row per cell of the variable with the most dimensions. Every dimension is a column, its coordinate variable's value or else its index; variables over some of the dimensions repeat along
the others; fill values are null. A file is cut into ranges of its first (usually the record) dimension, `records` of them a partition, and only the variables in the schema that is asked for
are read, each from its own place in the file. Bounds of the first dimension narrow the ranges before there are tasks: its coordinate is searched by halves (it must ascend if its last value isn't below
its first). They are options, not filters of the plan: Spark 4.1 keeps a Python source's pushed filters with the DataFrame, so that a later query without them would lose rows.

Writing: each task streams its rows as records into one file, a record variable per column, without holding them; the record dimension is named by the option `record`, whose column then is its
coordinate (rows ascending in it can be searched later). Files appear under their names only when the whole job has ended.
"""

from __future__ import annotations

import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "classic_grid"

# Fixed values of the public format: tags, types with their codes, default fill values.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
FILLS = {">f4": 9.969209968386869e36, ">f8": 9.969209968386869e36, ">i1": -127, ">i2": -32767, ">i4": -2147483647, ">i8": -9223372036854775806}
CODES = {v: k for k, v in TYPES.items()}
SPARK = {"double": ">f8", "float": ">f4", "bigint": ">i8", "int": ">i4", "smallint": ">i2"}


@dataclass
class Variable:
    name: str
    dims: list[int]
    dtype: str
    begin: int
    record: bool
    size: int  # bytes of one record, or of the whole
    fill: float | int | None


@dataclass
class Header:
    dims: list[tuple[str, int]]  # name, length; the record dimension has the number of records
    variables: dict[str, Variable]
    step: int  # bytes from one record to the next

    @property
    def main(self) -> Variable:
        return max(self.variables.values(), key=lambda v: len(v.dims))


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        return system, inner
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[str]:
    """The files that a path names: itself, or those in the folder whose names begin with neither a dot nor an underscore."""
    from pyarrow import fs

    system, inner = _open(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def read_header(f) -> Header:
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a file of the classic format")
    wide, far = magic[3] == 5, magic[3] >= 2
    whole = lambda: struct.unpack(">q" if wide else ">i", f.read(8 if wide else 4))[0]
    tag = lambda: struct.unpack(">i", f.read(4))[0]

    def padded(n: int) -> bytes:
        return f.read(-(-n // 4) * 4)[:n]

    def name() -> str:
        return padded(whole()).decode()

    def attributes() -> dict:
        kind, n, out = tag(), whole(), {}
        for _ in range(n if kind == ATTRIBUTE else 0):
            key, dtype, many = name(), TYPES[tag()], whole()
            out[key] = np.frombuffer(padded(many * np.dtype(dtype).itemsize), dtype)
        return out

    records = whole()
    kind, n = tag(), whole()
    dims = [(name(), whole()) for _ in range(n if kind == DIMENSION else 0)]
    unlimited = next((i for i, d in enumerate(dims) if d[1] == 0), None)
    attributes()
    kind, n = tag(), whole()
    found = []
    for _ in range(n if kind == VARIABLE else 0):
        label, own = name(), [whole() for _ in range(whole())]
        given, dtype, _ = attributes(), TYPES[tag()], whole()
        begin = struct.unpack(">q" if far else ">i", f.read(8 if far else 4))[0]
        record = bool(own) and own[0] == unlimited
        size = int(np.prod([dims[i][1] for i in own[record:]], dtype=np.int64)) * np.dtype(dtype).itemsize
        fill = next((given[k][0] for k in ("_FillValue", "missing_value") if k in given and len(given[k])), FILLS.get(dtype))
        found.append(Variable(label, own, dtype, begin, record, size, fill))
    recorded = [v for v in found if v.record]
    step = recorded[0].size if len(recorded) == 1 else sum(-(-v.size // 4) * 4 for v in recorded)
    dims = [(d, records if i == unlimited else n) for i, (d, n) in enumerate(dims)]
    return Header(dims, {v.name: v for v in found if v.dtype != "S1"}, step)


def read_slab(f, h: Header, v: Variable, lo: int, hi: int) -> np.ndarray:
    """A variable from lo to hi along its first dimension, as float64 or int64 with fill values masked (float: NaN)."""
    shape = [h.dims[i][1] for i in v.dims]
    if not shape:
        f.seek(v.begin)
        return np.frombuffer(f.read(v.size), v.dtype)
    each = int(np.prod(shape[1:], dtype=np.int64)) * np.dtype(v.dtype).itemsize
    if v.record and h.step != each:
        parts = []
        for i in range(lo, hi):
            f.seek(v.begin + i * h.step)
            parts.append(f.read(each))
        raw = b"".join(parts)
    else:
        f.seek(v.begin + lo * each)
        raw = f.read((hi - lo) * each)
    return np.frombuffer(raw, v.dtype).reshape(hi - lo, *shape[1:])


def _masked(values: np.ndarray, v: Variable) -> pa.Array:
    missing = values == v.fill if v.fill is not None else np.zeros(values.shape, bool)
    kind = np.float64 if v.dtype[1] == "f" else np.int64
    if kind is np.float64:
        missing = missing | np.isnan(values)
    return pa.array(values.astype(kind), mask=missing)


class Range(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema, records: int, low: float | None, high: float | None):
        self.paths, self.names, self.records, self.low, self.high = paths, schema.names, records, low, high

    def _range(self, f, h: Header) -> tuple[int, int]:
        """Positions along the first dimension that the bounds leave; all of them if its coordinate doesn't ascend from the first value to the last."""
        name, n = h.dims[h.main.dims[0]] if h.main.dims else ("", 1)
        own = h.variables.get(name)
        at = (lambda i: read_slab(f, h, own, i, i + 1)[0].item()) if own else (lambda i: i)
        if own and n and not at(0) <= at(n - 1):
            return 0, n

        def first(test) -> int:
            lo, hi = 0, n
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if test(at(mid)) else (mid + 1, hi)
            return lo

        lo = 0 if self.low is None else first(lambda x: x >= self.low)
        return lo, n if self.high is None else max(lo, first(lambda x: x > self.high))

    def _within(self, f, h: Header, lo: int, hi: int) -> np.ndarray:
        """Which of the positions are within the bounds."""
        own = h.variables.get(h.dims[h.main.dims[0]][0])
        at = read_slab(f, h, own, lo, hi).astype(float) if own else np.arange(lo, hi)
        ok = np.ones(hi - lo, bool)
        if self.low is not None:
            ok &= at >= self.low
        if self.high is not None:
            ok &= at <= self.high
        return ok

    def partitions(self):
        out = []
        for path in self.paths:
            system, inner = _open(path)
            with system.open_input_file(inner) as f:
                lo, hi = self._range(f, read_header(f))
            out += [Range(path, i, min(i + self.records, hi)) for i in range(lo, hi, self.records)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        system, inner = _open(partition.path)
        with system.open_input_file(inner) as f:
            h = read_header(f)
            dims = h.main.dims
            shape = [h.dims[i][1] for i in dims]
            per = max(1, int(np.prod(shape[1:], dtype=np.int64)))
            run = max(1, 65536 // per)
            for lo in range(partition.lo, partition.hi, run):
                hi = min(lo + run, partition.hi)
                full = [hi - lo, *shape[1:]] if dims else []
                arrays = []
                for name in self.names:
                    v = h.variables.get(name)
                    if v is None:  # a dimension without a coordinate
                        k = [h.dims[i][0] for i in dims].index(name)
                        values, own, masked = np.arange(lo, hi) if k == 0 else np.arange(shape[k]), [dims[k]], pa.array
                    else:
                        lead = bool(v.dims) and bool(dims) and v.dims[0] == dims[0]
                        values, own = read_slab(f, h, v, *((lo, hi) if lead else (0, h.dims[v.dims[0]][1] if v.dims else 0))), v.dims
                        masked = lambda x, v=v: _masked(x, v)
                    laid = values.reshape([full[i] if d in own else 1 for i, d in enumerate(dims)]) if dims else values
                    arrays.append(masked(np.ascontiguousarray(np.broadcast_to(laid, full)).ravel() if dims else laid.ravel()))
                batch = pa.RecordBatch.from_arrays(arrays, self.names)
                if dims and not (self.low is None and self.high is None):
                    batch = batch.filter(pa.array(np.repeat(self._within(f, h, lo, hi), per)))
                yield batch


class Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


def encode_header(records: int, record: str, columns: list[tuple[str, str]]) -> bytes:
    """A header of the 64-bit version: one unlimited dimension, one variable over it per (name, type)."""
    word = lambda s: struct.pack(">q", len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)

    def build(begins: list[int]) -> bytes:
        out = b"CDF\x05" + struct.pack(">q", records) + struct.pack(">iq", DIMENSION, 1) + word(record) + struct.pack(">q", 0) + struct.pack(">iq", 0, 0) + struct.pack(">iq", VARIABLE, len(columns))
        for (name, dtype), begin in zip(columns, begins, strict=True):
            item = np.dtype(dtype).itemsize
            fill = np.array([FILLS[dtype]], dtype).tobytes()
            out += word(name) + struct.pack(">qq", 1, 0) + struct.pack(">iq", ATTRIBUTE, 1) + word("_FillValue") + struct.pack(">iq", CODES[dtype], 1) + fill + b"\0" * (-item % 4)
            out += struct.pack(">iqq", CODES[dtype], -(-item // 4) * 4, begin)
        return out

    begin, begins = len(build([0] * len(columns))), []
    for _, dtype in columns:
        begins.append(begin)
        begin += -(-np.dtype(dtype).itemsize // 4) * 4
    return build(begins)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, record: str, columns: list[tuple[str, str]]):
        self.path, self.record, self.columns = path.rstrip("/"), record, columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        layout = np.dtype([(n, t) if np.dtype(t).itemsize % 4 == 0 else (n, t, (1,)) for n, t in self.columns], align=False)
        narrow = {n for n, t in self.columns if np.dtype(t).itemsize % 4}
        if narrow and len(self.columns) > 1:
            raise TypeError("columns of 16 bits aren't written beside others; cast them")
        system, folder = _open(self.path)
        system.create_dir(f"{folder}/_temporary", recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.nc", 0
        body = f"{folder}/_temporary/{name}.records"
        with system.open_output_stream(body) as out:
            for batch in iterator:
                rows = np.empty(batch.num_rows, layout)
                for c, t in self.columns:
                    column = batch.column(c)
                    filled = column.fill_null(FILLS[t]) if column.null_count else column
                    rows[c] = filled.to_numpy(zero_copy_only=False).reshape(rows[c].shape)
                out.write(rows.tobytes())
                n += len(rows)
        if n:
            # the number of records stands at the beginning, and stores only append
            with system.open_output_stream(f"{folder}/_temporary/{name}") as out, system.open_input_stream(body) as held:
                out.write(encode_header(n, self.record, self.columns))
                while block := held.read(1 << 20):
                    out.write(block)
        system.delete_file(body)
        return Written(name if n else None)

    def commit(self, messages):
        system, folder = _open(self.path)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{folder}/_temporary/{m.name}", f"{folder}/{m.name}")
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        system, folder = _open(self.path)
        if system.get_file_info(f"{folder}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_temporary")


class ClassicGrid(DataSource):
    """Options: path; records (of a partition, 65536); low, high (of the first dimension, both included); record (on writing, the name of the record dimension, "record")."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _paths(self) -> list[str]:
        return files_of(self.options["path"])

    def schema(self) -> str:
        paths = self._paths()
        if not paths:
            raise ValueError(f"no file in {self.options['path']}: give a schema")
        system, inner = _open(paths[0])
        with system.open_input_file(inner) as f:
            h = read_header(f)
        kind = lambda v: "double" if v.dtype[1] == "f" else "bigint"
        indices = [h.dims[i][0] for i in h.main.dims if h.dims[i][0] not in h.variables]
        return ", ".join([*(f"`{d}` bigint" for d in indices), *(f"`{v.name}` {kind(v)}" for v in h.variables.values() if set(v.dims) <= set(h.main.dims))])

    def reader(self, schema) -> DataSourceReader:
        bound = lambda k: float(self.options[k]) if k in self.options else None
        return Reader(self._paths(), schema, int(self.options.get("records", 65536)), bound("low"), bound("high"))

    def writer(self, schema, overwrite: bool):
        kinds = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        if bad := [n for n, k in kinds if k not in SPARK]:
            raise TypeError(f"numbers only: {', '.join(bad)}")
        if overwrite:
            for path in self._paths():
                system, inner = _open(path)
                system.delete_file(inner)
        return Writer(self.options["path"], self.options.get("record", "record"), [(n, SPARK[k]) for n, k in kinds])


def _register(spark: SparkSession) -> None:
    # workers that plan a source don't have this package on their path: the classes travel whole
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(ClassicGrid)


def read_classic(spark: SparkSession, path: str, schema: str | None = None, low: float | None = None, high: float | None = None, records: int = 65536) -> DataFrame:
    """The rows of a file or a folder of files, of those from low to high (both included) of the first dimension only; of a schema's columns only, if one is given (doubles and longs, by the names of dimensions and variables)."""
    _register(spark)
    reader = spark.read.format(NAME).option("records", records)
    for k, v in (("low", low), ("high", high)):
        reader = reader if v is None else reader.option(k, repr(float(v)))
    return (reader.schema(schema) if schema else reader).load(path)


def write_classic(df: DataFrame, path: str, record: str = "record", mode: str = "append") -> None:
    """Writes each partition's rows in their order as one file in the folder; columns are numbers, nulls become fill values."""
    _register(df.sparkSession)
    df.write.format(NAME).option("record", record).mode(mode).save(path)
