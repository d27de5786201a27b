"""Session, shared scratch storage and small-file helpers.

Anything that has to outlive a lost executor is written below the folder the cluster
names in ``spark.checkpoint.dir``.  Only where that setting is absent (unit tests, a
laptop) a folder of our own is chosen.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestar", cpus: str | int | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the library is tuned for.

    With ``cpus`` (tests, bench) it is a local one.  Without, master, memory and shuffle partitions are left to
    spark-submit and its configuration; only where nothing names a master it is ``local[*]``.
    """
    given = SparkConf()
    b = SparkSession.builder.appName(app)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    local = cpus is not None or not given.contains("spark.master")
    if local:
        b = b.master(f"local[{cpus or '*'}]")
        defaults |= {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": os.environ.get("LODESTAR_DRIVER_MEMORY", "8g")}
    for k, v in (defaults | conf).items():
        if k in conf or local or not given.contains(k):
            b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; sets one only where the session has none."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        path = tempfile.mkdtemp(prefix="lodestar-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path.rstrip("/")


_SCRATCH: dict[str, tuple[SparkSession, list[str]]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``clear_scratch`` or the end of the program deletes it."""
    path = f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.register(_clear_all)
    _SCRATCH.setdefault(spark.sparkContext.applicationId, (spark, []))[1].append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes what the session has written to the shared folder; results not yet read are gone with it."""
    _, paths = _SCRATCH.pop(spark.sparkContext.applicationId, (spark, []))
    for p in paths:
        delete_path(spark, p)
    return len(paths)


def _clear_all() -> None:
    for spark, _ in list(_SCRATCH.values()):
        try:
            clear_scratch(spark)
        except Exception:  # the session has ended before the program: nothing to ask
            continue


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p, _ = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def list_suffixes(spark: SparkSession, path: str) -> set[str]:
    """The suffixes, in lower case, of the files in a folder and below it."""
    fs, p, _ = _fs(spark, path)
    out, files = set(), fs.listFiles(p, True)
    while files.hasNext():
        out.add(files.next().getPath().getName().rpartition(".")[2].lower())
    return out


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder; what was at the target is deleted first."""
    fs, a, jvm = _fs(spark, source)
    b = jvm.org.apache.hadoop.fs.Path(target)
    fs.delete(b, True)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {source} to {target}")


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def write_small_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small control file: whole under another name, then renamed over the old one in one step."""
    write_small_bytes(spark, path, text.encode("utf-8"))


def write_small_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p, jvm = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.tmp-{uuid.uuid4().hex[:8]}")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(p), how)


_MANIFEST = re.compile(r"^manifest-(\d{10})\.json$")


def publish_version(spark: SparkSession, folder: str, version: int, text: str, keep: int = 3) -> None:
    """Version ``version`` of a folder's manifest, as a file of its own: earlier ones stay until it is there.

    A version that exists already is refused, so of two writers one fails instead of undoing the other.
    """
    path = f"{folder}/manifest-{version:010d}.json"
    if path_exists(spark, path):
        raise OSError(f"{path} exists: another writer was first")
    write_small_text(spark, path, text)
    for name in list_names(spark, folder):
        m = _MANIFEST.match(name)
        if m and int(m.group(1)) <= version - keep:
            delete_path(spark, f"{folder}/{name}")


def latest_version(spark: SparkSession, folder: str) -> str | None:
    """The text of the highest manifest, or None."""
    names = [n for n in list_names(spark, folder) if _MANIFEST.match(n)]
    return read_small_text(spark, f"{folder}/{max(names)}") if names else None


def read_small_text(spark: SparkSession, path: str, limit: int = 4 << 20) -> str | None:
    """Content of a control file, or None if it is absent; refuses files above ``limit`` bytes."""
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    n = fs.getFileStatus(p).getLen()
    if n > limit:
        raise ValueError(f"{path} is no control file: {n} bytes")
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def load(spark: SparkSession, sf_dir: str, table: str, spread: bool = False) -> DataFrame:
    """A table of a folder.  With ``spread``, for work that costs far more than reading, one that comes in fewer pieces than half the cores is dealt out to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() * 2 < cores else df
