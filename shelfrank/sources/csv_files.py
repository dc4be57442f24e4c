"""Folder of shop CSV files to one raw listing table.

Each file has its own delimiter, column order and header spelling. Files with the same
header line are read together; all cells stay text until they are cleaned, because the
same column is text in one file and numbers in another.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.functions.clean import NUMERIC_CELL
from shelfrank.sources.listings import normalise_headers, null_missing, rename_aliases, union_by_name
from shelfrank.sources.snapshot import input_state, stored

LOCAL_FILE = "^file:/+"  # the lister and the readers write local paths differently
DELIMITERS = [",", ";", "\t", "|"]
SEQ, BROKEN = "seq", "broken_line"
MARK = "\ufeff"
VOTERS = 200  # first lines of a file, after its header, that have a vote on its delimiter
BROADCAST_FILES = 100_000  # up to this many one-row-per-file flags are sent to every task


def find_files(spark: SparkSession, folder: str, pattern: str = "*.csv", recursive: bool = False) -> DataFrame:
    """path and source_file of the files there, empty ones too: the listing that Spark makes to plan a read."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    try:
        paths = reader.text(folder).inputFiles()
    except AnalysisException:
        paths = []
    found = spark.createDataFrame([(unquote(p),) for p in paths], "path string")
    return found.select(_plain("path").alias("path"), F.element_at(F.split("path", "/"), -1).alias("source_file"))


def _plain(path: str):
    return F.regexp_replace(F.col(path), LOCAL_FILE, "file:/")


def sniff_delimiter(header: str) -> str:
    return max(DELIMITERS, key=lambda d: (header.count(d), -DELIMITERS.index(d)))


def _marks(line: str) -> Column:
    """How often each delimiter stands in a line outside quotes; null for a line that ends within quotes."""
    value = F.col(line)
    closed = F.length(F.translate(value, '"', "")) % 2 == F.length(value) % 2
    bare = F.regexp_replace(value, '"[^"]*"', "")
    return F.when(closed, F.array(*[F.length(bare) - F.length(F.translate(bare, d, "")) for d in DELIMITERS]))


def _delimiter() -> Column:
    """The delimiter that cuts most voting lines into as many cells as the header; of equal ones the header's most frequent."""

    def vote(k: int) -> Column:
        n = F.element_at("head", k + 1)
        agree = F.size(F.filter("voters", lambda marks: F.element_at(marks, k + 1) == n))
        return F.struct((n > 0).alias("stands"), F.when(n > 0, agree).otherwise(0).alias("votes"), n.alias("n"), F.lit(-k).alias("first"), F.lit(DELIMITERS[k]).alias("sep"))

    votes = [vote(k) for k in range(len(DELIMITERS))]
    return F.greatest(*votes)["sep"]


def _headers(spark: SparkSession, folder: str, pattern: str, recursive: bool) -> dict[tuple[str, str], list[str]]:
    """Paths by header line and delimiter. One job finds the first line of every file and lets the next ones vote.

    Lines with an odd number of quotes have no vote. A file whose header ends within quotes is
    told by its header alone, as is one without further lines.
    """
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    try:
        lines = reader.text(folder)
    except AnalysisException:
        return {}
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    first = lines.where("start = 0").withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("at"))).where(F.col("place") <= VOTERS + 1)
    heads = first.withColumn("marks", _marks("value")).groupBy("path").agg(
        F.min_by("value", "place").alias("header"), F.min_by("marks", "place").alias("head"),
        F.collect_list(F.when((F.col("place") > 1) & (F.col("value") != ""), F.col("marks"))).alias("voters"),
    )
    heads = heads.where("header <> ''").select("path", "header", F.when(F.col("head").isNotNull(), _delimiter()).alias("sep"))
    by_header = defaultdict(list)
    for row in heads.orderBy("path").toLocalIterator():
        header = row.header.removeprefix(MARK)
        by_header[header, row.sep or sniff_delimiter(header)].append(unquote(row.path))
    return by_header


def _read_group(spark: SparkSession, paths: list[str], header: str, sep: str, multi_line: bool) -> DataFrame:
    names = [n.strip().strip('"') or f"unnamed_{i}" for i, n in enumerate(next(csv.reader([header], delimiter=sep)))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BROKEN]])
    rows = (
        spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", "UTF-8").option("enforceSchema", True)
        .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
        .option("multiLine", multi_line).csv(paths)
    )
    rows = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"),
    )
    return normalise_headers(rows)


def read_folder(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.csv",
    numeric_price: bool | Mapping[str, bool] | None = None,
    multi_line: bool = False,
    recursive: bool = False,
) -> DataFrame | None:
    """Union of all files, with ``seq`` (position in file order), ``source_file``, ``price_is_number``
    and ``broken_line``; None if there is no usable file.

    ``numeric_price`` says which files hold prices as numbers: one answer for all, or one
    per file name. Left out, it is found by one extra pass over the price column.
    ``broken_line`` holds a line whose cells don't fit the header (too many, too few, or a
    quoted line break read without ``multi_line``); it is null for all others.
    """
    by_header = _headers(spark, folder, pattern, recursive)
    if not by_header:
        return None
    rows = union_by_name([_read_group(spark, p, h, sep, multi_line) for (h, sep), p in by_header.items()])
    rows = null_missing(rename_aliases(normalise_headers(rows)), None)
    rows = rows.withColumn(SEQ, F.struct("_path", "_block", "_row")).drop("_block", "_row")
    n_files = sum(map(len, by_header.values()))
    return _flag_number_prices(rows, numeric_price, n_files <= BROADCAST_FILES).drop("_path")


def _flag_number_prices(rows: DataFrame, numeric_price, few_files: bool) -> DataFrame:
    flag = "price_is_number"
    if "price" not in rows.columns:
        return rows.withColumn(flag, F.lit(False))
    if isinstance(numeric_price, bool):
        return rows.withColumn(flag, F.lit(numeric_price))
    if numeric_price is not None:
        yes = [name for name, is_number in numeric_price.items() if is_number]
        return rows.withColumn(flag, F.col("source_file").isin(yes))
    per_file = rows.groupBy("_path").agg(
        F.coalesce(F.every(F.col("price").rlike(NUMERIC_CELL)), F.lit(True)).alias(flag)
    )
    return rows.join(F.broadcast(per_file) if few_files else per_file, "_path")


def inventory(spark: SparkSession, folder: str, pattern: str = "*.csv", **read_options) -> DataFrame:
    """path, source_file and n_rows of every file found, 0 rows for one without usable ones."""
    files = find_files(spark, folder, pattern, read_options.get("recursive", False))
    rows = read_folder(spark, folder, pattern, numeric_price=False, **read_options)
    if rows is None:
        return files.withColumn("n_rows", F.lit(0).cast("long"))
    counts = rows.groupBy(F.regexp_replace(f"{SEQ}._path", LOCAL_FILE, "file:/").alias("path")).agg(F.count("*").alias("n"))
    plain = F.regexp_replace(F.col("path"), " ", "%20")  # the lister does not escape blanks
    return files.withColumn("_key", plain).join(counts.withColumnRenamed("path", "_key"), "_key", "left").select(
        "path", "source_file", F.coalesce("n", F.lit(0)).alias("n_rows")
    )


def status_text(folder: str, found: int, usable: int, n_rows: int, exists: bool = True) -> str:
    """What became of a folder, in one line."""
    if not exists:
        return f"Data directory not found at {folder}"
    if not found:
        return f"No CSV files found in {folder}"
    if not usable:
        return f"Found {found} CSV files but none contained usable rows"
    return f"Loaded {n_rows} rows from {usable} CSV files"


def status(spark: SparkSession, folder: str, pattern: str = "*.csv", **read_options) -> str:
    """The status of reading a folder now."""
    try:
        spark.read.format("binaryFile").load(folder).schema
    except AnalysisException:
        return status_text(folder, 0, 0, 0, exists=False)
    row = inventory(spark, folder, pattern, **read_options).agg(F.count("*"), F.count(F.when(F.col("n_rows") > 0, 1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    return status_text(folder, *row)


def snapshot(spark: SparkSession, folder: str, cache_root: str, pattern: str = "*.csv", **read_options) -> DataFrame | None:
    """Parquet copy of the raw table, made once per state of the input files; None without usable files."""
    state = input_state(spark, folder, pattern, read_options.get("recursive", False))
    if not state:
        return None
    return stored(spark, cache_root, "raw", state, lambda: read_folder(spark, folder, pattern, **read_options))


def save_csv(df: DataFrame, target: str, mode: str = "overwrite", sep: str = ",") -> str:
    """CSV with header; every part starts with a byte-order mark, as spreadsheets expect."""
    first, *rest = df.columns
    flat = df.withColumnRenamed(first, "﻿" + first)
    (
        flat.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(target)
    )
    return target
