"""Session helpers: building a session for tests / benches, table loading and
the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                app: str = "foldwise") -> SparkSession:
    """Local session used by tests and the bench. On a cluster the caller
    owns the session; nothing in the library requires these settings except
    the UTC time zone for date arithmetic."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: Folders chosen here, by application, where the session names none.
_CHOSEN: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set to a folder that all executors share. Only a
    local master falls back to a fresh local folder (tests, local runs); the
    setting itself can't be changed in a running session, so the choice is
    kept here."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or _CHOSEN.get(sc.applicationId)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = _CHOSEN[sc.applicationId] = tempfile.mkdtemp(prefix="foldwise-ckpt-", dir="/tmp")
    sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, tag: str) -> str:
    """A path of its own below the shared folder; nothing is made there, as the
    folder need not be on a disk that the driver sees."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that run within."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss;
    never ``localCheckpoint``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``foldwise`` importable in Python workers (Arrow / pandas
    functions reference its helpers): zip the package once on the driver and
    add it with ``addPyFile``, as ``--py-files`` does at submit time."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="foldwise-pkg-", dir="/tmp")
    archive = shutil.make_archive(os.path.join(out, "foldwise"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir="foldwise")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
