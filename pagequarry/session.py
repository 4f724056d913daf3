"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results (time zone) or keep memory per task flat (batch sizes).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages reach 5,000,000 characters: 64 of them is the largest batch a parser task should hold.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
    # Noting the caller of every column operation doubles the time it takes to build large expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(master: str | None = None, partitions: int | None = None, app: str = "pagequarry") -> SparkSession:
    """A session with :data:`SETTINGS`; ``master`` and ``partitions`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the session, once, so that jobs run from any working folder."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="run-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def apply_settings(spark: SparkSession) -> None:
    """Set the runtime-changeable part of :data:`SETTINGS` on a session somebody else made."""
    ship(spark)
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder: later uses read it, and a lost executor does not repeat its work."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local session, as in tests, gets a temporary one where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
