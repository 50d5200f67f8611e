"""Readers: wide and monthly CSV, fixed-layout level files, tab-separated series, JSON side files, many-part layers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import settled
from ..operators.reshape import to_long

#: basin, start and end in a monthly file's name; the part before _area is optional.
MONTHLY_NAME = r"(\d+)_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})(?:_.*)?_area\.csv$"
#: Numbers that mean no value in level files (fixed values).
SENTINELS = (99999999.0, 999.99, 9999.99)


def wide_csv(spark: SparkSession, path: str, key: str, periods: Sequence[str], value: str = "value") -> DataFrame:
    """A wide entity-month table of any number of files as long rows; other columns are not parsed into values.

    All files are one scan of lines. A line with the key's name among its fields is its file's header, whatever the order of
    columns; a file without a column has nulls there. Files that share a header need no join: with several headers, lines meet
    theirs by the file. Fields may be quoted but must not hold line breaks.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.length("value") > 0)
    # Lines with the name somewhere are few; among them only headers have it as a field.
    maybe = lines.where(F.col("value").contains(key))
    most = maybe.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    generic = ", ".join(f"c{k} string" for k in range(most))
    parsed = lambda df: df.withColumn("c", F.from_csv("value", F.lit(generic))).withColumn("fields", F.array(*(F.col(f"c.c{k}") for k in range(most)))).drop("c", "value")
    wanted = F.array(*map(F.lit, periods))
    at = lambda name: F.array_position("fields", name).cast("int") - 1
    headers = parsed(maybe).where(F.array_contains("fields", key)).select("file", at(F.lit(key)).alias("key_at"), F.transform(wanted, at).alias("at"))
    headers = settled(headers.distinct())
    kinds = headers.select("key_at", "at").distinct().limit(2).collect()
    rows = parsed(lines).where(~F.coalesce(F.array_contains("fields", key), F.lit(False)))
    if len(kinds) == 1:
        rows = rows.withColumns({"key_at": F.lit(kinds[0]["key_at"]), "at": F.array(*map(F.lit, kinds[0]["at"]))})
    else:
        rows = rows.join(headers, "file")
    value_at = lambda i: F.when(i >= 0, F.get("fields", i).try_cast("double"))
    wide = rows.select(F.get("fields", F.col("key_at")).try_cast("long").alias(key), F.transform("at", value_at).alias("v"))
    return to_long(wide.select(key, *(F.get("v", F.lit(k)).alias(p) for k, p in enumerate(periods))), key, periods, value)


def monthly_csvs(spark: SparkSession, path: str, key: str = "id", value: str = "area") -> DataFrame:
    """(basin, start, end, key, value) of a folder of monthly files; other file names are skipped."""
    df = spark.read.csv(path, header=True, schema=f"{key} long, {value} double", pathGlobFilter="*_area.csv")
    return parsed_names(df.withColumn("__file", F.col("_metadata.file_name")), key, value)


def parsed_names(df: DataFrame, key: str, value: str) -> DataFrame:
    part = lambda k: F.regexp_extract("__file", MONTHLY_NAME, k)
    rows = df.where(F.col("__file").rlike(MONTHLY_NAME))
    return rows.select(part(1).cast("long").alias("basin"), F.to_date(part(2)).alias("start"), F.to_date(part(3)).alias("end"), key, F.nanvl(value, F.lit(None).cast("double")).alias(value))


def level_files(spark: SparkSession, path: str, header_lines: int = 50, fields: int = 16, names: Sequence[str] | None = None) -> DataFrame:
    """Rows of fixed-layout level files with the file's latitude and longitude.

    A file is read as one text, being small. The header's line "Latitude and longitude" holds the place; sentinels are
    null, and rows with a null or a wrong number of fields drop out.
    """
    names = list(names or [f"f{k}" for k in range(fields)])
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    place = F.regexp_extract_all(F.regexp_extract("value", r"([^\n]*Latitude and longitude[^\n]*)", 1), F.lit(r"(-?\d+(?:\.\d+)?)"), 1)
    # White space is made single in the whole text at once, and a text's place and numbers are parsed before they become rows: once each.
    lines = F.split(F.regexp_replace("value", r"[ \t\x0B\f\r]+", " "), "\n")
    parsed = F.transform(F.slice(lines, header_lines + 1, F.greatest(F.size(lines), F.lit(1))), lambda x: F.split(F.trim(x), " ")).try_cast("array<array<double>>")
    files = text.select(F.inline(F.array(F.struct("file", place[0].cast("double").alias("lat"), place[1].cast("double").alias("lon"), parsed.alias("parsed")))))
    rows = files.select("file", "lat", "lon", F.explode("parsed").alias("f"))
    known = [F.col("f")[k].isNotNull() & ~F.col("f")[k].isin(*SENTINELS) for k in range(fields)]
    lon = F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))
    good = rows.where((F.size("f") == fields) & reduce(and_, known))
    return good.select("file", "lat", lon.alias("lon"), *(F.col("f")[k].alias(n) for k, n in enumerate(names)))


def tab_series(spark: SparkSession, path: str, date: str, value: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """(period, value): means by month of a tab-separated series."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.groupBy(F.trunc(F.to_date(date, fmt), "MM").alias("period")).agg(F.avg(F.col(value).try_cast("double")).alias(value))


def history_json(spark: SparkSession, path: str) -> DataFrame:
    """(metric, epoch, value) of a file that maps metrics to lists by epoch, from 0."""
    df = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,array<double>>")
    return df.select(F.explode(parsed).alias("metric", "values")).select("metric", F.posexplode("values").alias("epoch", "value"))


def patch_positions(spark: SparkSession, path: str) -> DataFrame:
    """(raster, number, xoff, yoff) of a file that maps raster names to lists of patch positions, numbered from 0."""
    df = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,array<array<int>>>")
    rows = df.select(F.explode(parsed).alias("raster", "places")).select("raster", F.posexplode("places").alias("number", "place"))
    return rows.select("raster", "number", F.col("place")[0].alias("xoff"), F.col("place")[1].alias("yoff"))


def parts(*tables: DataFrame) -> DataFrame:
    """The rows of all parts; a missing column is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tile table: raster_id, tile_r, tile_c, data."""
    return spark.read.parquet(path)
