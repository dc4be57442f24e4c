"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# The JVM does not compile methods above 8000 bytes. Where the fused code of a stage is
# longer, Spark is to generate small methods instead of running it interpreted.
CODE_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(master: str | None = None, app: str = "shelfrank", **settings) -> SparkSession:
    """A session with adaptive execution; on a cluster leave ``master`` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in {**CODE_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """The code settings on a session made elsewhere."""
    for key, value in CODE_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application, for the functions that run in Python."""
    context = spark.sparkContext
    if getattr(context, "_shelfrank_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="shelfrank-code-")) / "shelfrank.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in root.rglob("*.py"):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._shelfrank_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's checkpoint setting.

    Only a local master, as in tests, gets a folder of its own; a cluster without the
    setting is an error, since its executors would each write to their own disks.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if not root:
        root = local_root(spark.sparkContext.master)
        spark.conf.set(CHECKPOINT_SETTING, root)
    return root.rstrip("/")


def local_root(master: str) -> str:
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"{CHECKPOINT_SETTING} must name a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix="shelfrank-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
