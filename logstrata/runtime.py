"""Session helpers: the shared folder for intermediate tables, and small filesystem calls through Hadoop."""

from __future__ import annotations

import atexit
import random
import re
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_LOCAL_DIRS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent, a temporary folder is made, which only suits a single machine; on any other master the
    setting is required, since a folder of one machine can't be read by the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="logstrata-")
    _LOCAL_DIRS.append(made)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


@atexit.register
def _remove_local_dirs() -> None:
    for d in _LOCAL_DIRS:
        shutil.rmtree(d, ignore_errors=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per application, so that they needn't find it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    made = tempfile.mkdtemp(prefix="logstrata-")
    _LOCAL_DIRS.append(made)
    archive = Path(made, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/logstrata/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut of the lineage that survives lost executors.
    It stays until it is discarded or the folder is emptied."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*written: DataFrame) -> None:
    """Remove what `materialize` wrote for these frames, which nothing may read any more."""
    for df in written:
        Hdfs(df.sparkSession, df._written).delete(df._written)


def spread(df: DataFrame) -> DataFrame:
    """``df``, repartitioned where it has less than half as many partitions as there are cores: for scans of a few files whose
    rows are costly to work on. Larger inputs have more partitions than that and aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


# How often a call to the storage is tried, the seconds waited for after the first failure and at most, and what is
# worth another try.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 3, 0.1, 5.0
PASSING = re.compile(r"ECONNRESET|ETIMEDOUT|ENOTFOUND|Connection reset|timed out|UnknownHost|SlowDown|ServiceUnavailable|[Ss]tatus(?: [Cc]ode)?:? ?(?:5\d\d|429)\b")


def retried(call: Callable[[], T], attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> T:
    """``call()``, tried again after failures that may pass, with waits that double and vary by a tenth."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 == attempts or not PASSING.search(str(e)):
                raise
            sleep(min(LONGEST_WAIT, first_wait * 2**n) * random.uniform(1, 1.1))
    raise ValueError("no attempts")


class Hdfs:
    """The few filesystem calls needed besides reading and writing DataFrames, on any Hadoop URI."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = self._path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _p(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._p(path))

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._p(old), self._p(new)):
            raise OSError(f"can't rename {old} to {new}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._p(path), True)

    def mkdirs(self, path: str) -> None:
        self._fs.mkdirs(self._p(path))

    def files(self, path: str) -> list[tuple[str, int]]:
        """(name, bytes) of the files directly in ``path``, sorted by name; empty where it doesn't exist."""
        if not self.exists(path):
            return []
        return retried(lambda: sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._p(path))))

    def read_text(self, path: str) -> str:
        def read() -> str:
            stream = self._fs.open(self._p(path))
            try:
                return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()

        return retried(read)

    def create(self, path: str, text: str) -> bool:
        """Create exclusively and whole; False where ``path`` exists.

        On a local disk the text is written beside it and linked to its name, elsewhere it's renamed, which both fail where the name
        is taken. Object stores show an object only once it's written; there its exclusive creation is used.
        """
        kind = self._fs.getScheme()
        whole = kind in ("s3a", "s3", "gs", "wasb", "wasbs")
        aside = path if whole else f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp"
        try:
            out = self._fs.create(self._p(aside), False)
        except Exception as e:
            if whole and ("AlreadyExists" in str(e) or "already exists" in str(e)):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if whole:
            return True
        try:
            if kind == "file":
                local = lambda x: self._fs.pathToFile(self._p(x)).toPath()
                self._jvm.java.nio.file.Files.createLink(local(path), local(aside))
                return True
            return not self.exists(path) and self._fs.rename(self._p(aside), self._p(path))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.delete(aside)

    def size(self, path: str) -> int | None:
        """Bytes of a file, None where there is none."""
        return self._fs.getFileStatus(self._p(path)).getLen() if self.exists(path) else None

    def bytes_in(self, path: str) -> int:
        """Bytes of the Parquet files directly in ``path``."""
        return sum(size for name, size in self.files(path) if name.endswith(".parquet"))
