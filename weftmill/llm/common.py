"""Helpers that the training-data operators share: shared storage, batching, bounded samples, word arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import slices as slices
from ..operators.storage import _file, discard as discard, new_path as new_path, saved as saved, shared_dir as shared_dir

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reachable(spark: SparkSession, path: str) -> str | None:
    """path, whole, as the tasks' own file access takes it; None where only Spark's reaches it."""
    from pyarrow import fs

    files, p = _file(spark, path)
    uri = files.makeQualified(p).toUri()
    scheme = {"s3a": "s3"}.get(uri.getScheme(), uri.getScheme())
    whole = f"{scheme}://{uri.getRawAuthority() or ''}{uri.getPath()}"
    try:
        fs.FileSystem.from_uri(whole)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    return whole


def picked(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of saved data whose `row`, a number that grows within each file, is in kept (row). No row is shuffled.

    kept is written in order of row; a task reads the files of it that its own rows fall in, of which the driver knows the
    first and last numbers. On storage that only Spark reaches the rows are joined instead, which shuffles them.
    """
    spark = rows.sparkSession
    path = new_path(spark, "kept")
    whole = reachable(spark, path)
    if whole is None:
        return rows.join(saved(kept.select("row"), "kept"), "row", "left_semi").select(*rows.columns)
    kept.select("row").repartitionByRange("row").sortWithinPartitions("row").write.parquet(path)
    written = spark.read.schema("row long").parquet(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    files = sorted((r["first"], r["last"], r["name"]) for r in written.groupBy(name.alias("name")).agg(F.min("row").alias("first"), F.max("row").alias("last")).collect())
    shared = spark.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(whole)
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            row = np.asarray(batch.column("row"))
            low, high = int(row.min()), int(row.max())
            names = [n for a, b, n in shared.value if a <= high and b >= low]
            held = {n: held[n] if n in held else np.asarray(pq.read_table(f"{root}/{n}", columns=["row"], filesystem=where).column("row")) for n in names}
            found = np.zeros(len(row), dtype=bool)
            for own in held.values():
                at = np.searchsorted(own, row)
                found |= own[np.minimum(at, len(own) - 1)] == row
            yield batch.filter(pa.array(found))

    return rows.mapInArrow(run, rows.schema)


def id_crc32(column: str) -> Column:
    """crc32 of an id's decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def hashed_share(column: Column, share: float) -> Column:
    """True for about this share of the keys, always the same ones."""
    if share >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit("sample"), column), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def carried(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str, str]:
    """(the columns `keep` of docs as k0, k1 and so on, and their text; the DDL of the former; the name of the text column, which is one of them where it can be)."""
    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    name = "text"
    if "text" in keep and dict(docs.dtypes)["text"] == "string":
        name = f"k{keep.index('text')}"
    else:
        columns.append(F.col("text").cast("string").alias(name))
    rows = docs.select(*columns)
    return rows, ", ".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), name


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Texts cut at spaces and line feeds: (number of pieces of each text, distinct pieces, index of each piece among them). Null counts as empty; pieces may be empty."""
    lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    coded = lists.flatten().dictionary_encode()
    return np.asarray(pc.list_value_length(lists), dtype=np.int64), coded.dictionary, np.asarray(coded.indices)


def gather_ragged(offsets: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `which` of a ragged array, one after the other: (their lengths, their values)."""
    n = (offsets[1:] - offsets[:-1])[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(offsets[:-1][which] - (ends - n), n)
    return n, values[at]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; to be called on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))
