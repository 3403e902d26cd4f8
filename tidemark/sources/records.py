"""Binary altimeter records: fixed-length, big-endian, a two-letter tag first. A revolution record sets orbit and time for the data records that follow it in the file.

The layout is data (`Layout`), so that the record families differ in tables and not in code. Files are read by Spark's binaryFile source and decoded in Arrow tasks; order-dependent
state is carried by a window over (file, record number).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import record_seconds
from ..functions.geo import wrap_360


@dataclass(frozen=True)
class Layout:
    """size: bytes a record. head, data: field name to (offset, big-endian NumPy type, divisor)."""

    size: int
    head_tag: str
    data_tag: str
    head: dict = field(default_factory=dict)
    data: dict = field(default_factory=dict)


# Byte offsets, types and divisors of the record families (two-letter tags; big-endian).
_HEAD = {"orbit": (4, ">i4", 1), "mjd": (8, ">i4", 1), "sec": (12, ">i4", 1), "fsec": (16, ">i4", 1e6)}
_DATA = {
    "retstat": (2, ">u2", 1), "dsec": (4, ">i4", 1e6), "lat": (8, ">i4", 1e6), "lon": (12, ">i4", 1e6), "surf": (16, ">i4", 1e2), "surf_raw": (16, ">i4", 1),
}
_CORRECTIONS = {
    "surfstat": (32, ">i4", 1), "iono": (36, ">i2", 1), "wet": (38, ">i2", 1), "dry": (40, ">i2", 1), "stide": (44, ">i2", 1), "otide": (46, ">i2", 1e3), "agc": (52, ">i2", 1e2),
    "inc1": (58, ">i2", 1), "inc2": (62, ">i2", 1), "inc3": (66, ">i2", 1),
}
RA1 = Layout(100, "IR", "ID", _HEAD, _DATA | _CORRECTIONS)
RA2 = Layout(112, "IR", "ID", _HEAD, _DATA | _CORRECTIONS)
WAVEFORM = Layout(184, "WR", "WD", _HEAD, _DATA | {"surfstat": (20, ">i4", 1), "agc": (46, ">i2", 1e2), "sig0": (178, ">i2", 1e2)})
FILE_HEADER = Layout(100, "IH", "ID", {"first_date": (48, ">i4", 1), "first_time": (52, ">i4", 1), "last_date": (56, ">i4", 1), "last_time": (60, ">i4", 1), "satellite": (64, ">i4", 1)}, {})
CORRECTED = ["iono", "wet", "dry", "stide"]  # corrections that must be given


def read_records(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """decode_records of the files at a path."""
    return decode_records(spark.read.format("binaryFile").load(path).select("path", "content"), layout)


def decode_records(files: DataFrame, layout: Layout) -> DataFrame:
    """Of files (path, content): rows (src, recno, tag, fields of both kinds as doubles; null where the record is of the other kind). Bytes after the last whole record are left out."""
    names = [*layout.head, *layout.data]

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for src, content in zip(frame["path"], frame["content"], strict=True):
                n = len(content) // layout.size
                raw = np.frombuffer(content, np.uint8, n * layout.size).reshape(n, layout.size)
                tag = np.ascontiguousarray(raw[:, :2]).view("S2")[:, 0]
                out = {"src": src, "recno": np.arange(n, dtype=np.int64), "tag": pd.Series(tag.astype("U2"), dtype=object)}
                for kind, fields in ((layout.head_tag, layout.head), (layout.data_tag, layout.data)):
                    own = tag == kind.encode()
                    for name, (at, dtype, divisor) in fields.items():
                        v = np.ascontiguousarray(raw[:, at : at + np.dtype(dtype).itemsize]).view(dtype)[:, 0] / divisor
                        out[name] = np.where(own, v, np.nan)
                yield pd.DataFrame(out)

    rows = files.mapInPandas(decode, "src string, recno long, tag string, " + ", ".join(f"{n} double" for n in names))
    return rows.select("src", "recno", "tag", *[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names])


def carry_header(rows: DataFrame, layout: Layout) -> DataFrame:
    """Data records with the fields of the header record before them; those before any header go."""
    w = Window.partitionBy("src").orderBy("recno").rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for name in layout.head:
        out = out.withColumn(name, F.last(name, True).over(w))
    first = next(iter(layout.head))
    return out.where((F.col("tag") == layout.data_tag) & F.col(first).isNotNull())


def flags(word: str, modes: int = 2) -> dict:
    """Of a status word: fprob (any of bits 13, 11, 8, 7), fret (bit 5), fmode (bits 1 and 0 as 0..3, or bit 0 alone)."""
    bit = lambda n: F.getbit(F.col(word).cast("int"), F.lit(n))
    mode = bit(1) * 2 + bit(0) if modes == 2 else bit(0)
    return {"fprob": F.greatest(*[bit(n) for n in (13, 11, 8, 7)]), "fret": bit(5), "fmode": mode}


def valid(df: DataFrame, checked: list[str]) -> DataFrame:
    """Plausible places, a surface (its raw value isn't -9999), and all corrections in `checked` given (32767: none)."""
    near_zero = (F.abs("lat") < 1e-6) & (F.col("lat") != 0) | (F.abs("lon") < 1e-6) & (F.col("lon") != 0)
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 360) & ~near_zero & (F.col("surf_raw") != -9999)
    for c in checked:
        ok = ok & (F.col(c) != 32767)
    return df.where(ok)


def to_points(df: DataFrame, tide_applied: Column | None = None, increment: str | None = None) -> DataFrame:
    """utc85, lon from 0 to 360, and the surface with a (raw, valid) increment in it and without the ocean tide where that had been applied."""
    seconds = [F.col(c) for c in ("sec", "fsec", "dsec") if c in df.columns]
    surf = F.col("surf") + (F.when(F.col(increment) != 32767, F.col(increment) / 100).otherwise(0) if increment else 0)
    if tide_applied is not None:
        surf = F.when(tide_applied == 1, surf + F.col("otide")).otherwise(surf)
    return df.withColumn("utc85", record_seconds(F.col("mjd"), *seconds)).withColumn("lon", wrap_360(F.col("lon"))).withColumn("surf", surf)


def decode_points(files: DataFrame, layout: Layout, modes: int, checked: list[str] = CORRECTED, increment: str | None = None) -> DataFrame:
    """Files of records to valid points: src, recno, orbit, utc85, lat, lon, surf, agc, fmode, fret, fprob. An invalid increment drops its point, as invalid corrections do."""
    df = carry_header(decode_records(files, layout), layout).withColumns(flags("retstat", modes))
    df = valid(df, [*checked, *([increment] if increment else [])])
    df = to_points(df, F.getbit(F.col("surfstat").cast("int"), F.lit(7)) if "otide" in layout.data else None, increment)
    return df.select("src", "recno", F.col("orbit").cast("long").alias("orbit"), "utc85", "lat", "lon", "surf", "agc", "fmode", "fret", "fprob", *[c for c in ("sig0",) if c in layout.data])


def decode_waveforms(files: DataFrame) -> DataFrame:
    """Waveform records with a surface; the only test is that it isn't -9999."""
    df = carry_header(decode_records(files, WAVEFORM), WAVEFORM).withColumns(flags("retstat", 1)).where("surf_raw <> -9999")
    return to_points(df).select("src", "recno", F.col("orbit").cast("long").alias("orbit"), "utc85", "lat", "lon", "surf", "agc", "sig0", "fmode", "fret", "fprob")


def decode_region(files: DataFrame, layout: Layout, box: tuple[float, float, float, float], to_360: bool = True) -> DataFrame:
    """Points with a surface in a closed box (left, right, bottom, top), longitudes compared from 0 to 360 or from -180 to 180; an invalid second increment adds nothing, and the tide stays as it is."""
    df = carry_header(decode_records(files, layout), layout).where("surf_raw <> -9999")
    lon = wrap_360(F.col("lon")) if to_360 else F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))
    left, right, bottom, top = box
    df = df.withColumn("lon", lon).where(F.col("lon").between(left, right) & F.col("lat").between(bottom, top))
    return to_points(df, increment="inc2").select("src", "recno", F.col("orbit").cast("long").alias("orbit"), "utc85", "lat", "lon", F.col("surf").alias("elev"))


def file_dates(files: DataFrame) -> DataFrame:
    """(src, first, last) of file headers as YYYYMM; two-digit years are of the 1900s."""
    month = lambda c: F.when(F.floor(F.col(c) / 100) <= 9912, F.floor(F.col(c) / 100) + 190000).otherwise(F.floor(F.col(c) / 100))
    heads = decode_records(files, FILE_HEADER).where("tag = 'IH'")
    return heads.select("src", month("first_date").alias("first"), month("last_date").alias("last"))


def pack(size: int, tag: str, fields: dict[str, tuple[int, str, float]], values: dict[str, Column]) -> Column:
    """A record as hexadecimal digits: whole-number values at their fields' offsets, zeros elsewhere."""
    out, at = [F.lit(tag.encode().hex().upper())], 2
    for name, (offset, dtype, _) in sorted(fields.items(), key=lambda f: f[1][0]):
        if name not in values or offset < at:
            continue
        n = np.dtype(dtype).itemsize
        out += [F.lit("00" * (offset - at)), F.right(F.lpad(F.hex(values[name].cast("long")), 16, "0"), F.lit(2 * n))]
        at = offset + n
    return F.concat(*out, F.lit("00" * (size - at)))


def to_files(records: DataFrame, src: str, order: list[str], digits: str) -> DataFrame:
    """Files (path, content) of the packed records of each src, in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(digits).alias("x"))))
    return records.groupBy(F.col(src).cast("string").alias("path")).agg(F.unhex(F.array_join(F.transform(rows, lambda r: r["x"]), "")).alias("content"))
