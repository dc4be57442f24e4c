"""Derived tables kept as Parquet, one copy per state of their input and of the code.

A writer writes under a name of its own and publishes it by one manifest; readers read only
what a manifest names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def input_state(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> list[tuple]:
    """Paths, sizes and times of the files; their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    try:
        return sorted(tuple(map(str, r)) for r in reader.load(path).select("path", "length", "modificationTime").collect())
    except AnalysisException:
        return []


@lru_cache
def code_state() -> str:
    root = Path(__file__).resolve().parent.parent
    digest = hashlib.sha256()
    for source in sorted(root.rglob("*.py")):
        digest.update(source.read_bytes())
    return digest.hexdigest()


def state_key(state: list[tuple]) -> str:
    """A name for this state of input files and of the code."""
    return hashlib.sha256(repr((state, code_state())).encode()).hexdigest()[:24]


def published(spark: SparkSession, base: str) -> dict | None:
    """What the first manifest under ``base`` says, or None if no writer has ended there.

    A manifest is one line of JSON that a job commits after all data is written, so a folder
    that a killed writer left, with whatever is in it, is never named by one.
    """
    try:
        rows = spark.read.text(f"{base}/manifest-*", wholetext=True).select("value", F.col("_metadata.file_path").alias("path")).collect()
    except AnalysisException:
        return None
    for row in sorted(rows, key=lambda r: r.path):
        try:
            found = json.loads(row.value)
        except ValueError:
            continue
        if found.get("end"):
            return found
    return None


def publish(spark: SparkSession, base: str, write: Callable[[str], dict]) -> dict:
    """Calls ``write`` with a folder of its own and commits the manifest that it gives.

    Writers that run at the same time don't see each other's folders; readers follow the
    first manifest.
    """
    writer = uuid.uuid4().hex
    manifest = write(f"{base}/data-{writer}")
    line = json.dumps({**manifest, "end": True})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{base}/manifest-{writer}")
    return published(spark, base)


def stored(spark: SparkSession, root: str, name: str, state: list[tuple], build: Callable[[], DataFrame | None]) -> DataFrame | None:
    """The table of this state, built and written if no writer has published it yet.

    The folder is named by the state, so changed input or code never meets an old copy.
    """
    base = f"{root.rstrip('/')}/{name}-{state_key(state)}"
    found = published(spark, base)
    if found is None:
        rows = build()
        if rows is None:
            return None

        def write(folder: str) -> dict:
            rows.write.parquet(f"{folder}/table")
            return {"table": f"{folder}/table"}

        found = publish(spark, base, write)
    return spark.read.parquet(found["table"])
