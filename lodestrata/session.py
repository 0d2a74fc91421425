"""Session helpers: lineage cuts in the shared folder, size-checked broadcasts, table loading."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import subprocess
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024
_OWN_DIR: dict[str, str] = {}
_KEPT_CLEAN: set[str] = set()


class _Scopes(threading.local):
    """The tables written inside the ``scoped`` functions that are running, innermost last; each thread has its own."""

    def __init__(self) -> None:
        self.open: list[list[DataFrame]] = []


_SCOPES = _Scopes()
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is missing and the master is local (tests, laptops) a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, _OWN_DIR[app], ignore_errors=True)
    return "file://" + _OWN_DIR[app]


def app_dir(spark: SparkSession) -> str:
    """This application's own folder inside the shared one; other applications' folders are never touched.

    It is deleted through the file system of its scheme when the driver ends: by Python at its exit, else by the JVM.
    """
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/lodestrata/{sc.applicationId}"
    if path not in _KEPT_CLEAN:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        atexit.register(_delete, fs, p)
        _KEPT_CLEAN.add(path)
    return path


def _delete(fs, path) -> None:
    try:
        fs.delete(path, True)
    except Exception:  # the JVM may be gone, and deletes the folder itself then
        pass


def cut(df: DataFrame, *, codec: str = "zstd", counted: Column | None = None, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table in the application's shared folder and return a scan of it.

    The returned frame has no lineage beyond the files, so lost executors recompute nothing, and nondeterministic
    numbering in ``df`` is frozen. ``rows`` of it gives the number of rows (those where ``counted`` holds) without a job.
    ``group_rows``: rows of a Parquet row group at most, for rows of megabytes: a writer holds one row group, and a scan
    up to 4096 rows of one, in memory.
    The table is dropped by ``release``, at the end of a ``scoped`` function, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, (F.count(F.lit(1)) if counted is None else F.count_if(counted)).alias("n")).write.options(
        compression=codec, **({"parquet.block.row.count.limit": group_rows} if group_rows else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestrata_path, out._lodestrata_rows = path, seen
    if _SCOPES.open:
        _SCOPES.open[-1].append(out)
    return out


def scoped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions that return a frame made by ``cut``: the other tables they wrote are dropped when they are done.

    A frame of another kind may still read those tables; then the function around it, or the driver's end, drops them.
    """

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        _SCOPES.open.append([])
        try:
            out = f(*args, **kwargs)
        finally:
            made = _SCOPES.open.pop()
        path = getattr(out, "_lodestrata_path", None)
        if path:
            release(*(x for x in made if x._lodestrata_path != path))
            made = [out]
        if _SCOPES.open:
            _SCOPES.open[-1].extend(made)
        return out

    return run


def rows(df: DataFrame) -> int:
    """The number of rows; of a frame made by ``cut`` it was counted while writing."""
    seen = getattr(df, "_lodestrata_rows", None)
    return df.count() if seen is None else seen.get["n"]


def release(*frames: DataFrame | None) -> None:
    """Delete the tables behind frames made by ``cut``; frames of any other kind are left alone."""
    for df in frames:
        path = getattr(df, "_lodestrata_path", None)
        if not path:
            continue
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Delete every table that this application's ``cut`` has left; frames that still read one can't be used afterwards."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(app_dir(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a scan of a ``cut`` table it is the file size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, *, blow_up: int = 8, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame | None:
    """``broadcast(df)`` when the files behind it, unpacked ``blow_up`` times, stay below ``limit``; else None."""
    return F.broadcast(df) if plan_bytes(df) * blow_up <= limit else None


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that it need not be installed on them.

    The archive is made on the driver and handed out by Spark's own file server.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = tempfile.mkdtemp(prefix="lodestrata-ship-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    path = os.path.join(at, "lodestrata.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str, *, by_parts: bool = False) -> DataFrame:
    """``by_parts``: for columns of long texts. Spark's default, vectored reads, may copy a row group's whole column through
    one buffer outside the heap, besides the copy inside it; without them it comes in parts of megabytes.
    """
    reader = spark.read.option("parquet.hadoop.vectored.io.enabled", "false") if by_parts else spark.read
    return reader.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def runtime_identity(spark: SparkSession) -> DataFrame:
    """C17: one row: the package's version and place, Spark's version, the application, and the commit if the package lies in a repository."""
    import lodestrata

    at = os.path.dirname(os.path.abspath(lodestrata.__file__))
    done = subprocess.run(["git", "-C", at, "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    row = (getattr(lodestrata, "__version__", "0"), at, spark.version, spark.sparkContext.applicationId, done.stdout.strip() or None if done.returncode == 0 else None)
    return spark.createDataFrame([row], "version string, place string, spark string, application string, commit string")
