"""Files in and out: page files, JSON, chapters as text files, and the views that a console shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def html_files(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """Page files as page_id (a hash of the path), url (the path) and html."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.decode("content", charset).alias("html"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, null fields written too, characters unescaped."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def chapter_files(chapters: DataFrame, style: str = "export") -> DataFrame:
    """folder, file and body of chapters (book, source, position, title, url, content); nulls count as empty.

    style "export": folder and file names are made safe and cut to 50 and 100 characters, the body starts with title, URL
    and source; "interactive": only slashes are replaced, the folder ends in _chapters, the body starts with the title.
    """
    if style not in ("export", "interactive"):
        raise ValueError(f"style: {style}")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slashes = lambda c: F.regexp_replace(c, r"[/\\]", "_")
    if style == "export":
        folder, name = F.concat(T.safe_filename(text("book"), 50), F.lit("_"), text("source")), T.safe_filename(text("title"), 100)
        body = F.concat(F.lit("Title: "), text("title"), F.lit("\nURL: "), text("url"), F.lit("\nSource: "), text("source"), F.lit("\n\n"), text("content"))
    else:
        folder, name = F.concat(slashes(text("book")), F.lit("_chapters")), slashes(text("title"))
        body = F.concat(F.lit("Title: "), text("title"), F.lit("\n\n"), text("content"))
    return chapters.select(folder.alias("folder"), F.concat(F.format_string("%04d_", F.col("position").cast("int")), name, F.lit(".txt")).alias("file"), body.alias("body"))


def write_chapters(files: DataFrame, path: str) -> None:
    """Each body as text below path/folder=.../file=.../, by Spark's committer, so lost and repeated tasks leave no halves."""
    files.write.partitionBy("folder", "file").text(path)


def ellipsis(c: Column, most: int = 100) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def chapter_view(chapters: DataFrame, book: str, position: str, most: int | None = 50) -> DataFrame:
    """Lines of each book's chapter list, the first `most` (None: all): book, n, line.

    The limit is put into the window, so tasks keep that many rows of a book before the shuffle.
    """
    n = F.row_number().over(Window.partitionBy(book).orderBy(position))
    volume = F.when(F.col("volume") > 0, F.concat(F.lit("[Vol."), F.col("volume").cast("string"), F.lit("] "))).otherwise("")
    rows = chapters.withColumn("n", n)
    rows = rows if most is None else rows.where(F.col("n") <= most)
    return rows.select(book, "n", F.concat(F.format_string("%4d. ", "n"), volume, "title").alias("line"))
