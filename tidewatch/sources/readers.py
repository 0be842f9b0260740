"""Readers of the feed formats: parsed with Spark's own functions, bad rows become nulls and are dropped where asked."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positions of the columns that are used of a 61-column event line, by name; fixed by the format.
EVENT_COLUMNS = {"global_event_id": 0, "sql_date": 1, "event_code": 26, "event_root_code": 28, "goldstein": 30, "geo_name": 52, "country_code": 53, "lat": 56, "lng": 57, "date_added": 59, "source_url": 60}


def event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated event lines: positional, lines of another width go, numbers that aren't become null."""
    parts = F.split(F.col(column), "\t")
    rows = lines.filter(F.size(parts) == 61)
    number = {"goldstein", "lat", "lng"}
    return rows.select(*[(F.get(parts, F.lit(i)).try_cast("double") if name in number else F.get(parts, F.lit(i))).alias(name) for name, i in EVENT_COLUMNS.items()])


def fire_rows(rows: DataFrame) -> DataFrame:
    """Fire detections of rows of texts, by name: those of low confidence, or without finite coordinates and power, go."""
    typed = rows.select(*[F.col(c).try_cast("double").alias(c) for c in ("latitude", "longitude", "frp")], F.lower(F.trim("confidence")).alias("confidence"), F.trim("acq_date").alias("acq_date"), F.trim("acq_time").alias("acq_time"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return typed.filter((F.coalesce("confidence", F.lit("")) != "l") & finite("latitude") & finite("longitude") & finite("frp"))


def fire_csv(spark: SparkSession, path: str) -> DataFrame:
    """Fire detections of a CSV file, whose columns are found by their names."""
    return fire_rows(spark.read.option("header", True).csv(path))


def fire_lines(lines: DataFrame, header: str, column: str = "value") -> DataFrame:
    """Fire detections of CSV lines, as a stream brings them, with the header's names."""
    return fire_rows(lines.select(F.from_csv(column, ", ".join(f"`{c.strip()}` string" for c in header.split(","))).alias("r")).select("r.*"))


def export_urls(texts: DataFrame, column: str = "value") -> DataFrame:
    """The first link to an export archive in each file list: lines of a checksum, a size and a link."""
    parts = F.filter(F.transform(F.split(F.trim(column), "\n"), lambda x: F.get(F.split(F.trim(x), r"\s+"), F.lit(2))), lambda u: u.endswith(".export.CSV.zip"))
    return texts.withColumn("url", F.get(parts, F.lit(0)))


def _inflated(batches):
    for batch in batches:
        names, lines = [], []
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for member in archive.namelist():
                    with archive.open(member) as file:
                        for line in io.TextIOWrapper(file, "utf-8", errors="replace"):
                            names.append(path)
                            lines.append(line.rstrip("\r\n"))
                            if len(lines) == 10_000:  # a bounded number of lines at a time
                                yield pd.DataFrame({"path": names, "value": lines})
                                names, lines = [], []
        yield pd.DataFrame({"path": names, "value": lines})


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the lines of ZIP archives, one task an archive at the most."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_inflated, "path string, value string")


QUAKES = "struct<features:array<struct<id:string,properties:struct<mag:double,place:string,time:bigint>,geometry:struct<coordinates:array<double>>>>>"


def quakes(texts: DataFrame, column: str = "value", least: float = 4.5) -> DataFrame:
    """Earthquakes of a GeoJSON feed from a magnitude on."""
    f = texts.select(F.explode(F.from_json(column, QUAKES)["features"]).alias("f"))
    point = F.col("f.geometry.coordinates")
    rows = f.select("f.id", F.col("f.properties.mag").alias("mag"), F.col("f.properties.place").alias("place"), F.get(point, F.lit(0)).alias("lng"), F.get(point, F.lit(1)).alias("lat"))
    return rows.filter(F.col("mag") >= least)


GEOMETRY = "struct<type:string,coordinates:string>"


def centroids(shapes: DataFrame, column: str = "geometry") -> DataFrame:
    """The point, or the mean of the outer ring's points, of GeoJSON geometries."""
    g = F.from_json(column, GEOMETRY)
    point = F.from_json(g["coordinates"], "array<double>")
    ring = F.get(F.from_json(g["coordinates"], "array<array<array<double>>>"), F.lit(0))
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda a, p: a + F.get(p, F.lit(i))) / F.nullif(F.size(ring), F.lit(0))
    is_point = g["type"] == "Point"
    return shapes.withColumn("lng", F.when(is_point, F.get(point, F.lit(0))).otherwise(mean(0))).withColumn("lat", F.when(is_point, F.get(point, F.lit(1))).otherwise(mean(1)))


def distress(frames: DataFrame, codes: tuple[int, ...] = (7, 14)) -> DataFrame:
    """Ship position frames whose navigation status tells of distress; works on streams too."""
    return frames.filter(F.col("status").isin(*codes))


def wkb_points(df: DataFrame, column: str = "geom") -> DataFrame:
    """Longitude and latitude of little-endian WKB points in hexadecimal, with or without a reference system."""
    hexes = F.upper(F.col(column))
    body = F.when(F.substring(hexes, 9, 2) == "20", F.substring(hexes, 19, 32)).otherwise(F.substring(hexes, 11, 32))

    def number(text):
        bits = F.conv(F.concat(*[F.substring(text, i, 2) for i in range(15, 0, -2)]), 16, -10).cast("long")
        sign = F.when(bits < 0, -1.0).otherwise(1.0)
        exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(2047))
        fraction = bits.bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
        return F.when((exponent == 0) & (fraction == 0), 0.0).otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 1023))

    return df.withColumn("lng", number(F.substring(body, 1, 16))).withColumn("lat", number(F.substring(body, 17, 16)))
