"""The same operators over streams: pages as they arrive, and windowed counts of fetch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract_chapters

PAGES = "page_id long, url string, html string"


def read_pages(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """Parquet files of pages as they come into the folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def extract_stream(pages: DataFrame) -> DataFrame:
    """extract_chapters of a stream: every page by itself, so no state is kept."""
    return extract_chapters(pages)


def first_of_each(rows: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """One row of each key, if its repeats come within that time: state is dropped behind the watermark."""
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def tier_windows(fetches: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Successes and failures of each tier (fetches: tier, success) in windows of time; start is the window's."""
    counted = fetches.withWatermark(ts, late).groupBy(F.window(ts, width), "tier").agg(F.count_if("success").alias("hits"), F.count_if(~F.col("success")).alias("failures"))
    return counted.select(F.col("window.start").alias("start"), "tier", "hits", "failures")


def write_stream(rows: DataFrame, path: str, checkpoint: str, forever: bool = False) -> StreamingQuery:
    """Appends to Parquet files, each batch once; ends with what is there now, unless forever."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer if forever else writer.trigger(availableNow=True)).start()
