"""Readers and writers of the lake: series, indexes, directories, manifests and filing archives."""

from __future__ import annotations

import csv
import io
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import accession
from ..operators.series import latest_wins
from .zips import csv_members

#: Columns of the members of an archive; further cells of a line are left out.
CELLS = [f"c{i}" for i in range(9)]
_ROWS = 5000


def read_series(spark: SparkSession, path: str, schema: StructType | None = None, symbols: list[str] | None = None) -> DataFrame:
    """All loads of all symbols, revisions included; ``symbols`` prunes the folders that are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if symbols is None else df.where(F.col("symbol").isin(symbols))


def append_series(df: DataFrame, path: str) -> None:
    """Append a load, one folder a symbol. The rebalance makes few files a symbol and splits those of a symbol with many rows."""
    df.hint("rebalance", "symbol").write.mode("append").partitionBy("symbol").parquet(path)


def read_filing_index(spark: SparkSession, path: str, forms: tuple[str, ...] = ("10-K", "10-Q")) -> DataFrame:
    """``cik, company, form, filed, file_name, accession_number`` of the lines with five fields that begin with a number;
    the preamble has none."""
    f = F.split("value", r"\|")
    rows = spark.read.text(path).where(f[0].rlike(r"^\d+$") & (F.size(f) >= 5))
    named = rows.select(f[0].alias("cik"), f[1].alias("company"), f[2].alias("form"), f[3].try_cast("date").alias("filed"), F.trim(f[4]).alias("file_name"))
    return named.where(F.col("form").isin(*forms)).withColumn("accession_number", accession(F.col("file_name")))


def read_symbol_directory(spark: SparkSession, path: str) -> DataFrame:
    """``symbol`` and the other columns of pipe-delimited directories, without their closing line."""
    df = spark.read.option("sep", "|").option("header", True).csv(path)
    name = next(c for c in ("Symbol", "NASDAQ Symbol") if c in df.columns)
    rows = df.where(F.col(f"`{name}`").isNotNull() & ~F.col(f"`{df.columns[0]}`").startswith("File Creation Time"))
    return rows.withColumnRenamed(name, "symbol")


def json_field(column: str, path: str) -> Column:
    """The value at ``path`` ($.a.b) of a column of JSON texts, as text; null where it isn't there."""
    return F.get_json_object(F.col(column), path)


def read_manifests(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_universe(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_universe(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def append_months(df: DataFrame, path: str, key: str = "symbol", date: str = "date") -> None:
    """Append a load, one folder a key and month."""
    rows = df.withColumn("month", F.date_format(date, "yyyy-MM"))
    rows.hint("rebalance", key, "month").write.mode("append").partitionBy(key, "month").parquet(path)


def read_since(spark: SparkSession, path: str, target: DataFrame, schema: StructType, key: str = "symbol", date: str = "date") -> DataFrame:
    """Rows of a lake of ``append_months`` from each key's last date in ``target`` on, that day included; keys new to it whole.

    The folders that can hold such rows, by key and month, are found from the names of the files alone, and only those are listed
    and opened. The driver gets their names, as it does for any scan. ``schema``: that of the files, with ``key`` and ``month``
    (texts).
    """
    marks = target.groupBy(key).agg(F.max(date).alias("_mark"))
    # This reader gives the names of files and opens none as long as their content isn't asked for.
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    part = lambda c: F.url_decode(F.regexp_replace(F.regexp_extract("path", f"/{c}=([^/]*)/", 1), r"\+", "%2B")).alias(c)
    folders = names.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), part(key), part("month")).distinct()
    due = folders.join(marks, key, "left").where(F.col("_mark").isNull() | (F.col("month") >= F.date_format("_mark", "yyyy-MM")))
    due = [r.folder for r in due.select("folder").collect()]
    if not due:
        return spark.createDataFrame([], schema)
    source = spark.read.schema(schema).option("basePath", path).parquet(*due)
    return source.join(marks, key, "left").where(F.col("_mark").isNull() | (F.col(date) >= F.col("_mark"))).select(source.columns)


def register_lake(spark: SparkSession, root: str, tables: list[str] | dict[str, dict[str, str]]) -> None:
    """Make the Parquet tables under ``root`` known by name, so that one session joins them.

    A list: temporary views of this session. Names of databases with the columns (DDL) of their tables: external tables of the
    catalog over ``root/database/table``, which every session of the catalog sees; their files stay when a table is dropped, and
    a table that is registered already gets the columns that are given now.
    """
    if not isinstance(tables, dict):
        for t in tables:
            spark.read.parquet(f"{root}/{t}").createOrReplaceTempView(t)
        return
    for database, members in tables.items():
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        for t, columns in members.items():
            spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{t}`")
            spark.sql(f"CREATE TABLE `{database}`.`{t}` ({columns}) USING parquet LOCATION '{root}/{database}/{t}'")


def compact_latest(spark: SparkSession, path: str, out: str, keys: list[str], order: list[str]) -> None:
    """Write the last row of every key to ``out``, a new place; the caller switches readers to it."""
    latest_wins(spark.read.parquet(path), keys, order).write.mode("errorifexists").parquet(out)


def lake_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n``: the rows of every table, counted side by side."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def lake_status(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``table_name, n, symbols``: rows and distinct values of the named column of each table."""
    each = [df.agg(F.count("*").alias("n"), F.count_distinct(c).alias("symbols")).select(F.lit(name).alias("table_name"), "n", "symbols") for name, (df, c) in tables.items()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def newest_rows(tables: dict[str, tuple[DataFrame, str, str]], n: int = 5) -> DataFrame:
    """``table_name, rank, id, at``: the ``n`` newest rows of each table, given with its key and its time, as samples."""
    tops = []
    for name, (df, key, at) in tables.items():
        top = df.select(F.col(key).cast("string").alias("id"), F.col(at).cast("string").alias("at"), F.col(at).alias("_at")).orderBy(F.desc("_at"), "id").limit(n)
        ranked = top.agg(F.array_sort(F.collect_list(F.struct("_at", "id", "at")), lambda a, b: F.when(a["_at"] > b["_at"], -1).when(a["_at"] < b["_at"], 1).when(a["id"] < b["id"], -1).otherwise(1)).alias("x"))
        tops.append(ranked.select(F.lit(name).alias("table_name"), F.posexplode("x").alias("k", "y")).select("table_name", (F.col("k") + 1).alias("rank"), "y.id", "y.at"))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _text(raw: bytes) -> str:
    """By the mark at the beginning where there is one, else UTF-8, else the Japanese code page."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp932", "replace")


def _members(batches, part: str = ""):
    names = ["path", "file_name", "line", "width", *CELLS]
    kinds = [pa.int32() if n in ("line", "width") else pa.string() for n in names]
    missing = [[None] * (len(CELLS) - n) for n in range(len(CELLS))]

    def flush(held):
        columns = zip(*held, strict=True) if held else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    held: list[list] = []
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            for name, data in csv_members(content.as_py() or b"", part):
                text = _text(data)
                sep = "\t" if "\t" in text[: text.find("\n") + 1 or None] else ","
                # Without quotes and returns a reader would part the lines in the same way, in six times the time.
                plain = '"' not in text and "\r" not in text
                lines = (line.split(sep) if line else [] for line in text.split("\n")) if plain else csv.reader(io.StringIO(text), delimiter=sep)
                width = len(next(lines, []))
                for i, cells in enumerate(lines):
                    if cells and (n := len(cells)) <= width:
                        held.append([path, name, i, width, *(cells + missing[n] if n < len(CELLS) else cells[: len(CELLS)])])
                    if len(held) >= _ROWS:
                        yield flush(held)
                        held = []
    yield flush(held)


def archive_rows(files: DataFrame, part: str = "") -> DataFrame:
    """``path, file_name, line, width, c0..c8`` of the CSV members of the ZIP files ``files(path, content)``.

    The first line of a member, and lines with more cells than it, are left out; files that are no archives give no rows.
    ``part``: only members whose name has it, in lower case, are read. A task holds one archive at a time, and gives out its
    lines in batches.
    """
    return files.select("path", "content").mapInArrow(partial(_members, part=part), f"path string, file_name string, line int, width int, {', '.join(f'{c} string' for c in CELLS)}")


def read_filing_archives(spark: SparkSession, path: str) -> DataFrame:
    """``archive_rows`` of all files under ``path``."""
    return archive_rows(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))
