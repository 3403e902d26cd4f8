"""Sources and sinks of columns: text with sniffed separators, keys in file names, partitioned output."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sniff(lines: list[str]) -> dict:
    """Separator, comment mark and header of the first lines of a text table; blanks separate where nothing else does."""
    comment = next((x.lstrip()[0] for x in lines if x.strip() and x.lstrip()[0] in "#%"), None)
    body = [x for x in lines if x.strip() and not (comment and x.lstrip().startswith(comment))]
    try:
        sep = csv.Sniffer().sniff("\n".join(body), delimiters=",;\t|").delimiter
    except csv.Error:
        sep = " "

    def numeric(cells: list[str]) -> bool:
        try:
            return all(float(c) is not None for c in cells if c.strip())
        except ValueError:
            return False

    cells = [c.strip().strip('"') for c in (body[0].split() if sep == " " else body[0].split(sep))] if body else []
    return {"sep": sep, "comment": comment, "header": bool(cells) and not numeric(cells)}


def read_text_table(spark: SparkSession, path: str, lines: int = 21) -> DataFrame:
    """A text table with what `sniff` finds in its first lines; runs of blanks are one separator."""
    first = [r.value for r in spark.read.text(path).limit(lines).collect()]
    how = sniff(first)
    options = {"sep": how["sep"], "header": how["header"], "inferSchema": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "multiLine": False}
    if how["comment"]:
        options["comment"] = how["comment"]
    if how["sep"] == " ":
        # a name and a number of columns from the first lines; every line is split by Spark
        rows = [r.split() for r in first if r.strip() and not (how["comment"] and r.lstrip().startswith(how["comment"]))]
        names = rows[0] if how["header"] else [f"_c{i}" for i in range(len(rows[0]))] if rows else []
        text = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
        if how["comment"]:
            text = text.where(~F.startswith("value", F.lit(how["comment"])))
        if how["header"]:
            text = text.where(F.regexp_replace("value", r"\s+", " ") != " ".join(names))
        body = rows[1:] if how["header"] else rows
        number = lambda i: all(re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|nan|NaN", r[i]) for r in body if i < len(r))
        cells = F.split("value", r"\s+")
        return text.select(*[(F.get(cells, i).try_cast("double") if number(i) else F.get(cells, i)).alias(n) for i, n in enumerate(names)])
    return spark.read.options(**options).csv(path)


def name_keys(path: Column) -> dict[str, Column]:
    """Keys in a file's name: instrument, the two dates, sector (the last two digits after an underscore) and direction."""
    return {
        "sat": F.regexp_extract(path, r"(ers1|ers2|envi)", 1),
        "time1": F.regexp_extract(path, r"(\d{8})_\d{8}", 1),
        "time2": F.regexp_extract(path, r"\d{8}_(\d{8})", 1),
        "sector": F.regexp_extract(path, r"_(\d\d)(?=[._])", 1),
        "trk": F.regexp_extract(path, r"_(asc|des)(?=[._])", 1),
    }


def write_partitions(df: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """One folder per key value; rows are dealt by the keys and sorted, so that a folder has few files and series read in order."""
    df.repartition(*keys).sortWithinPartitions(*keys, *order).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_text(df: DataFrame, path: str, sep: str = " ", header: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def add_columns(spark: SparkSession, source: str, target: str, columns: dict[str, Column]) -> None:
    """Rewrites a stored table with more columns."""
    spark.read.parquet(source).withColumns(columns).write.mode("overwrite").parquet(target)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without null or NaN in any column."""
    return df.na.drop("any")
