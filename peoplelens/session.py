"""Spark session set-up and intermediate tables."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Shared folder taken where ``spark.checkpoint.dir`` is unset and Spark runs in local mode, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints"

HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # HotSpot does not compile methods above 8000 bytes; beyond that Spark's split expressions are faster.
    HUGE_METHOD: "8000",
    "spark.ui.enabled": "false",
}

_RUN_FOLDERS: dict[str, str] = {}


def build_session(app: str = "peoplelens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Inside, wide projections are planned as methods that HotSpot compiles, also in a session that ``build_session`` did not make."""
    before = spark.conf.get(HUGE_METHOD)
    spark.conf.set(HUGE_METHOD, str(min(int(before), int(DEFAULTS[HUGE_METHOD]))))
    try:
        yield
    finally:
        spark.conf.set(HUGE_METHOD, before)


def scratch_dir(spark: SparkSession) -> str:
    """Folder of this application below the cluster's ``spark.checkpoint.dir``; deleted when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _RUN_FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            base = LOCAL_SCRATCH
        _RUN_FOLDERS[app] = f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _RUN_FOLDERS[app])
    return _RUN_FOLDERS[app]


def _forget(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        delete(spark, folder)


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, folder: str) -> None:
    path, files = _file_system(spark, folder)
    files.delete(path, True)


def names_in(spark: SparkSession, folder: str) -> set[str]:
    """Names in a folder, from one listing; none if it does not exist."""
    path, files = _file_system(spark, folder)
    return {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()


def create_file(spark: SparkSession, file: str, text: str) -> bool:
    """Write a small file that must not exist; False where another writer has it already."""
    path, files = _file_system(spark, file)
    files.mkdirs(path.getParent())
    try:
        out = files.create(path, False)
    except Py4JJavaError as e:
        if not files.exists(path):
            raise e
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Lineage ends here, lost executors cost nothing, and later readers prune columns and push filters down.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
