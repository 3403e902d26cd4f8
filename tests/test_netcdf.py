"""Classic gridded files: round trips, hand-made files of each version, bounds and pruning."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import netcdf as N


def cube_file(path, version, unlimited=True):
    """t (4) x y (3) x x (2): coordinates t and x, v over all, h over (y, x), one scalar; written from the format's description."""
    wide, far = version == 5, version >= 2
    n = (lambda k: struct.pack(">q", k)) if wide else (lambda k: struct.pack(">i", k))
    word = lambda s: n(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    t = np.array([1.5, 2.5, 4.0, 8.0], ">f8")
    v = np.arange(24, dtype=">f4").reshape(4, 3, 2)
    v[1, 1, 1] = -999
    h = np.arange(6, dtype=">i2").reshape(3, 2)
    x = np.array([10, 20], ">i4")
    fill = struct.pack(">i", 12) + n(1) + word("_FillValue") + struct.pack(">i", 5) + n(1) + struct.pack(">f", -999)
    none = struct.pack(">i", 0) + n(0)
    title = struct.pack(">i", 12) + n(1) + word("title") + struct.pack(">i", 2) + n(5) + b"cubes\0\0\0"
    variables = [("x", [2], none, 4, x, False), ("h", [1, 2], none, 3, h, False), ("t", [0], none, 6, t, unlimited), ("v", [0, 1, 2], fill, 5, v, unlimited), ("k", [], none, 4, np.array(7, ">i4"), False)]

    def head(begins):
        out = b"CDF" + bytes([version]) + n(4 if unlimited else 0)
        out += struct.pack(">i", 10) + n(3) + word("t") + n(0 if unlimited else 4) + word("y") + n(3) + word("x") + n(2) + title + struct.pack(">i", 11) + n(5)
        for (name, dims, att, code, a, record), b in zip(variables, begins):
            size = a[0].nbytes if record else a.nbytes
            out += word(name) + n(len(dims)) + b"".join(map(n, dims)) + att + struct.pack(">i", code) + n(-(-size // 4) * 4) + struct.pack(">q" if far else ">i", b)
        return out

    at, begins = len(head([0] * 5)), []
    for record in (False, True):
        for i, (_, _, _, _, a, r) in enumerate(variables):
            if r == record:
                begins.append((i, at))
                at += -(-(a[0].nbytes if r else a.nbytes) // 4) * 4
    body = head([b for _, b in sorted(begins)])
    for *_, a, r in variables:
        body += b"" if r else a.tobytes() + b"\0" * (-a.nbytes % 4)
    for i in range(4 if unlimited else 0):
        body += t[i : i + 1].tobytes() + v[i].tobytes()
    path.write_bytes(body)
    return [(int(k), float(tt), int(j), int(xx), None if v[i, j, m] == -999 else float(v[i, j, m]), int(h[j, m])) for k in [7] for i, tt in enumerate(t) for j in range(3) for m, xx in enumerate(x)]


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("unlimited", [True, False])
def test_cubes_of_each_version(spark, tmp_path, version, unlimited):
    want = cube_file(tmp_path / "a.nc", version, unlimited)
    (tmp_path / "_hidden").write_bytes(b"no")
    df = N.read_classic(spark, str(tmp_path), records=2)
    assert sorted(df.columns) == ["h", "k", "t", "v", "x", "y"] and df.rdd.getNumPartitions() == 2
    key = lambda r: [(x is None, x or 0) for x in r]
    assert sorted((tuple(r) for r in df.select("k", "t", "y", "x", "v", "h").collect()), key=key) == sorted(want, key=key)
    some = N.read_classic(spark, f"file://{tmp_path}/a.nc", "v double, t double", 1)
    assert some.columns == ["v", "t"] and sorted(r["t"] for r in some.collect()) == sorted(r[1] for r in want)
    for low, high, parts in ((2.6, None, 2), (2.5, 4, 2), (4, 4, 1), (None, 1.5, 1), (100, None, 1)):
        bounded = N.read_classic(spark, str(tmp_path), None, low, high, records=1)
        assert bounded.rdd.getNumPartitions() == parts
        within = [r for r in want if (low is None or r[1] >= low) and (high is None or r[1] <= high)]
        assert sorted((tuple(r) for r in bounded.select("k", "t", "y", "x", "v", "h").collect()), key=key) == sorted(within, key=key)


def test_round_trip_in_parts(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 97).alias("t"), F.col("id").cast("int").alias("i"), F.when(F.col("id") % 7 > 0, F.col("id") / 3).alias("v"))
    path = f"file://{tmp_path}/table"
    N.write_classic(df.repartitionByRange(4, "t").sortWithinPartitions("t", "i"), path, "t")
    back = N.read_classic(spark, path, records=300)
    assert sorted(map(str, back.select("t", "i", "v").collect())) == sorted(map(str, df.collect()))
    assert not (tmp_path / "table" / "_temporary").exists()
    few = N.read_classic(spark, path, low=90, records=300)
    assert few.rdd.getNumPartitions() < back.rdd.getNumPartitions() / 2 and few.count() == df.where("t >= 90").count()
    N.write_classic(df.limit(3).coalesce(1), path, "t", mode="overwrite")
    assert N.read_classic(spark, path).count() == 3
    with pytest.raises(Exception, match="numbers only"):
        N.write_classic(df.selectExpr("cast(i AS string) AS s"), path)
    N.write_classic(df.limit(0), f"{path}-empty")
    assert N.read_classic(spark, f"{path}-empty", "t bigint").count() == 0
