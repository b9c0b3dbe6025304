"""Session helpers shared by all operators: tables, shared storage, code shipping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it is known to stay under this many rows and about this many bytes.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 64 << 20
#: Rows of one key that one task joins; keys with more are dealt to several.
DEALT_ROWS = 4_000


def local_session(cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("slatework")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="slatework-"), "slatework-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("slatework", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset on one machine (tests) a temporary
    folder is made and set as checkpoint folder; on a cluster it must be set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="slatework-shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone already
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder as parquet and read it back.

    The files are replayable after the loss of executors. They are removed when
    the driver process ends, or before by ``dropped``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Remove the files of frames made by ``written`` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            _remove(df.sparkSession, path)


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Give Python-heavy work enough tasks when the input has fewer splits than cores.

    Inputs that already have a split per core are left alone, so nothing is
    shuffled at scale. The exchange is by the given keys, hence repeatable.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        want = max(want, rows)
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *[F.col(k) for k in keys])


def whole_list(df: DataFrame, rows: int) -> list:
    """All rows of a list that has at most ``rows`` of them; a longer one is refused, not cut."""
    out = df.limit(rows + 1).collect()
    if len(out) > rows:
        raise ValueError(f"a list of {', '.join(df.columns)} has more than {rows} rows")
    return out


def _size(name: str, kind: str):
    """About the bytes of a column's value."""
    c = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(16)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``rows`` rows of at most ``size`` bytes together.

    Proof is by reading at most ``rows + 1`` of them; larger tables are returned
    without a hint and joined by shuffle.
    """
    each = sum((_size(n, t) for n, t in df.dtypes), F.lit(0))
    seen = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(each), F.lit(0)).alias("b")).first()  # one row
    return F.broadcast(df) if seen["n"] <= rows and seen["b"] <= size else df


def dealt(probe: DataFrame, build: DataFrame, keys: list[str], by: str, rows: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(probe, build, keys) for a join on ``keys`` in which no task meets more than about ``rows`` build rows of one key.

    Build rows of a key that holds more are dealt to salts by a hash of ``by``, and probe
    rows visit each salt of their key once, so every pair still comes once. The bound is
    the same whatever the size of the table; the table of hot keys is broadcast only if
    it is small. Without hot keys nothing is added.
    """
    most = rows or DEALT_ROWS
    counts = build.groupBy(*keys).count().where(F.col("count") > most)
    hot = written(counts.select(*keys, F.ceil(F.col("count") / most).cast("int").alias("_salts")), "hot-keys")
    if hot.isEmpty():
        return probe, build, keys
    hot = small(hot)
    build = build.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    probe = probe.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return probe, build, [*keys, "_salt"]
