import struct
import time

from pyspark.sql import functions as F

from tidemark.sources import records as R
from tidemark.sources import tables as T
from tidemark.streaming import tracks as S

LAYOUT = R.Layout(
    32, "IH", "ID", {"orbit": (4, ">i4", 1), "mjd": (8, ">i4", 1), "sec": (12, ">i4", 1)},
    {"dsec": (4, ">i4", 1e6), "lat": (8, ">i4", 1e6), "lon": (12, ">i4", 1e6), "surf": (16, ">i4", 1e2), "surf_raw": (16, ">i4", 1), "otide": (20, ">i2", 1e3), "iono": (22, ">i2", 1), "status": (24, ">u2", 1)},
)


def head(orbit, mjd, sec):
    return struct.pack(">2sHiii16x", b"IH", 0, orbit, mjd, sec)


def data(dsec, lat, lon, surf, tide, iono, status):
    return struct.pack(">2sHiiiihhH6x", b"ID", 0, dsec, lat, lon, surf, tide, iono, status)


def test_records(spark, tmp_path):
    body = data(0, 1, 1, 1, 1, 1, 0) + head(7, 46066, 60) + data(500000, -70_000000, -10_000000, 12345, 250, 5, 0b100000) + data(0, 0, 0, -9999, 0, 5, 0) + head(8, 46067, 0) + data(0, -71_000000, 5_000000, 100, 0, 32767, 0) + data(1, -72_000000, 5_000000, 100, 0, 1, 1 << 13 | 2)
    (tmp_path / "a.bin").write_bytes(body + b"xx")
    df = R.carry_header(R.read_records(spark, str(tmp_path), LAYOUT), LAYOUT)
    df = R.to_points(R.valid(df.withColumns(R.flags("status")), ["iono"]))
    got = df.orderBy("recno").select("orbit", "lat", "lon", "surf", "utc85", "fret", "fprob", "fmode").collect()
    assert [tuple(r) for r in got] == [(7.0, -70.0, 350.0, 123.45, 60.5, 1, 0, 0), (8.0, -72.0, 5.0, 1.0, 86400.000001, 0, 1, 2)]


def test_sniff():
    assert T.sniff(["# note", "a, b", "1, 2"]) == {"sep": ",", "comment": "#", "header": True}
    assert T.sniff(["1 2", "3 4"])["header"] is False
    assert T.sniff([]) == {"sep": " ", "comment": None, "header": False}


def test_text_and_partitions(spark, tmp_path):
    (tmp_path / "t.txt").write_text("% head\nlon lat\n1.5   2\n3 4\n")
    rows = T.read_text_table(spark, str(tmp_path / "t.txt")).collect()
    assert [(r["lon"], r["lat"]) for r in rows] == [(1.5, 2), (3.0, 4)]
    df = spark.range(10).selectExpr("id", "id % 2 AS k")
    T.write_partitions(df, str(tmp_path / "p"), ["k"], ["id"])
    assert {p.name for p in (tmp_path / "p").glob("k=*")} == {"k=0", "k=1"}
    assert spark.read.parquet(str(tmp_path / "p")).count() == 10
    T.add_columns(spark, str(tmp_path / "p"), str(tmp_path / "q"), {"d": F.col("id") * 2})
    assert spark.read.parquet(str(tmp_path / "q")).agg(F.sum("d")).first()[0] == 90


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("timestamp_seconds(1700000000 + id * 60 + if(id > 100, 7200, 0)) AS ts", "id % 3 AS trk", "cast(id AS double) AS v")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, f in (("w", lambda d: S.stream_windows(d, "ts", "30 minutes", "10 minutes", "1 hour", "trk", "v")), ("s", lambda d: S.stream_segments(d, "ts", "trk", "20 minutes", "1 hour"))):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        time.sleep(0.1)
        batch = {tuple(r) for r in f(spark.read.parquet(str(tmp_path / "in"))).collect()}
        got = {tuple(r) for r in spark.table(name).collect()}
        assert got <= batch and got and (name == "s" or got == batch)
