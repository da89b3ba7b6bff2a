"""SparkSession construction and job-level settings.

Everything here is configuration a Spark user would set at submit time. On a
cluster the session already exists (``getOrCreate`` returns it) and the
settings below only fill gaps: nothing that the cluster has configured is
overridden, in particular ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings applied only when the session does not already define them.
_DEFAULTS = {
    # Runtime re-planning: coalesce small shuffle partitions, split skewed
    # join partitions, switch to broadcast when a side turns out small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Dates derived from timestamp_ntz do not depend on it, but pin it so
    # that timestamp rendering is identical on every executor.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "arrlens",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or attach to) a session with the library's defaults.

    ``master``/``shuffle_partitions`` are for local runs and tests; leave them
    ``None`` under spark-submit so the cluster's values stay in force.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", "8g")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply library defaults to an existing session without overriding it."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect sessions have no SparkContext
        return None


def session_key(spark: SparkSession) -> str:
    """Identity of the running application, for session-scoped caches."""
    return spark.conf.get("spark.app.id", None) or str(id(spark))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...)
    and is used as is. Only a local session without it (tests) gets a fresh
    temporary folder.
    """
    sc = _context(spark)
    if sc is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder")
        configured = tempfile.mkdtemp(prefix="arrlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder, for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, *parts) if "://" not in base else "/".join([base.rstrip("/"), *parts])


def _path_and_files(spark: SparkSession, path: str):
    """A path and its file system; None without a classic session."""
    sc = _context(spark)
    if sc is None:
        return None, None
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def dealt(df, key: str):
    """``df`` dealt by ``key`` over all ``spark.sql.shuffle.partitions``, which adaptive
    execution does not merge into few: for steps whose tasks hold much more than they read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query ends (Spark 4.1), not when
    the driver happens to collect garbage; unless the session has its own setting. For
    steps that execute no frame twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key, None)
    if own is None:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have a written intermediate table removed when the driver ends."""
    p, fs = _path_and_files(spark, path)
    if fs is not None:
        fs.deleteOnExit(p)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote."""
    p, fs = _path_and_files(spark, path)
    if fs is not None:
        fs.delete(p, True)


def list_paths(spark: SparkSession, glob: str) -> list[str]:
    """Paths that match a glob; nothing else is listed."""
    p, fs = _path_and_files(spark, glob)
    if fs is None:
        raise RuntimeError("listing folders needs a classic session")
    return [str(x.getPath().toString()) for x in (fs.globStatus(p) or [])]


class TableScope:
    """Written intermediate tables that live and go together, counted by their users.

    Tables that ``materialize`` writes inside ``with scope:`` belong to it. It starts with one
    user, its maker; ``acquire`` adds one and ``release`` takes one away, and with the last
    one the tables are removed. Outside of any scope a table stays until the driver ends,
    as do those of a scope that nobody released.
    """

    _open: list[TableScope] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.users = spark, [], 1

    def __enter__(self) -> TableScope:
        TableScope._open.append(self)
        return self

    def __exit__(self, *exc) -> None:
        TableScope._open.remove(self)

    @classmethod
    def current(cls) -> TableScope | None:
        return cls._open[-1] if cls._open else None

    def acquire(self) -> TableScope:
        self.users += 1
        return self

    def release(self) -> None:
        self.users -= 1
        if self.users == 0:
            for path in self.paths:
                delete_path(self.spark, path)
            self.paths.clear()

    def lend(self, df):
        """Makes ``df`` a user of the tables for as long as the object lives. Frames derived
        from it do not count: keep ``df`` while they are in use."""
        import weakref
        self.acquire()
        weakref.finalize(df, self.release).atexit = False
        return df


def manifest(spark: SparkSession, paths: list[str]) -> tuple:
    """Fingerprint of the files behind ``paths``: their number, bytes, and a sum of
    hashes of (path, length, modification time). Folders are listed and hashed by
    Spark, and no listing comes to the driver; paths that are single files are asked
    for directly. No content is read."""
    found = [_path_and_files(spark, p) for p in paths]
    if all(fs is not None for _, fs in found):
        status = [fs.getFileStatus(p) for p, fs in found]
        if all(x.isFile() for x in status):
            return tuple((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in status)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
             .select("path", "length", F.unix_micros("modificationTime").alias("at")))
    digest = F.sum(F.xxhash64("path", "length", "at").cast("decimal(38,0)"))
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), digest.cast("string")).first())


def materialize(df, name: str | None = None, read_as=None):
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint
    folder and reading it back.

    Used where a derived table is read many times (the account feature table
    feeds medians, scaler statistics, scoring and every report). After an
    executor loss, recovery restarts from these files, not from the raw
    scans; re-reads are columnar, pruned and filter-pushed. ``read_as`` is a
    schema for reading, if it is not the written one (vector columns).
    """
    import uuid
    spark = df.sparkSession
    path = shared_dir(spark, "arrlens-tables", f"{name or 'table'}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    delete_on_exit(spark, path)
    scope = TableScope.current()
    if scope is not None:
        scope.paths.append(path)
    return spark.read.schema(read_as or df.schema).parquet(path)
