"""Tables and files in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only where it is unset, as in
local tests, a temporary folder of this machine is taken instead.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import closing, contextmanager
from contextvars import ContextVar

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def root(spark: SparkSession) -> str:
    """The shared folder's URI."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets. Inside ``scratch`` it goes at the end."""
    path = f"{root(spark)}/quire-{name}-{uuid.uuid4().hex}"
    if (made := _scratch.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that was written to new paths inside. Results have to be consumed, or written elsewhere, before."""
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if there is no such file."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    with closing(fs.open(p)) as f:
        return bytes(f.readAllBytes()).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file. Who reads it meanwhile may see a part of it."""
    fs, p = _hadoop(spark, path)
    with closing(fs.create(p, True)) as f:
        f.write(bytearray(text.encode()))


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole if there is none of that name; says whether it did. Of several writers at once one does."""
    fs, p = _hadoop(spark, path)
    own = f"{path}.{uuid.uuid4().hex}"
    write_text(spark, own, text)
    source = spark._jvm.org.apache.hadoop.fs.Path(own)
    try:
        if fs.getUri().getScheme() == "file":
            os.link(source.toUri().getPath(), p.toUri().getPath())  # fails if the name is taken
            fs.delete(source, False)
        else:
            never = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(source, p, never)  # likewise
        return True
    except (FileExistsError, Py4JJavaError):
        fs.delete(source, False)
        if not fs.exists(p):
            raise
        return False


#: Rows of a table of narrow rows that are worth a file of their own.
ROWS_A_FILE = 250_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts the lineage and survives lost executors.

    rows: how many narrow rows there are at most, where that is known; a few rows then don't make a file for each shuffle partition."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(_nullable(df.schema)).parquet(path)
    out._quire_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that ``written`` made. Nothing may read it any more."""
    path = getattr(df, "_quire_path", None)
    if path:
        delete(df.sparkSession, path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def file_system(uri: str):
    """(file system, path) of a URI for use on an executor: file, hdfs, s3, gs and whatever else Arrow opens."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


#: Files, and their bytes, that a task reads, and folders that one lists.
FILES_A_TASK, BYTES_A_TASK, FOLDERS_A_TASK = 1000, 32 << 20, 16


def _hidden(name: str) -> bool:
    """Of files that Spark's readers leave out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def listed(spark: SparkSession, path: str) -> tuple[DataFrame, Callable[[], Callable[[int, str], bytes]]]:
    """Rows (path, size, root, at) of all files under ``path``, which may be a pattern, dealt to tasks by their number and bytes; and what
    gives, in a task, a function from (root, at) to a file's bytes.

    Tasks list the folders, level by level: the driver sees what the pattern matches, and numbers of files and folders. A folder is listed by one task."""
    fs, p = _hadoop(spark, path)
    found = list(fs.globStatus(p) or [])
    if not found:
        raise FileNotFoundError(path)
    uris, names = [f.getPath().toUri().toASCIIString() for f in found], [f.getPath().toString() for f in found]

    def opened() -> Callable[[int, str], bytes]:
        at_root = [file_system(u) for u in uris]

        def read(root: int, at: str) -> bytes:
            own, base = at_root[root]
            with own.open_input_stream(base + at) as f:
                return f.read()

        return read

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileType

        at_root = [file_system(u) for u in uris]
        for b in batches:
            for root, at in zip(b.column("root").to_pylist(), b.column("at").to_pylist()):
                own, base = at_root[root]
                inside = [x for x in own.get_file_info(FileSelector(base + at)) if not _hidden(x.base_name)]
                for i in range(0, len(inside), 10_000):
                    part = inside[i : i + 10_000]
                    sizes = [None if x.type == FileType.Directory else x.size for x in part]
                    yield pa.RecordBatch.from_arrays([pa.array([root] * len(part), pa.int32()), pa.array([f"{at}/{x.base_name}" for x in part], pa.string()), pa.array(sizes, pa.int64())], names=["root", "at", "size"])

    schema = "root int, at string, size long"
    levels = [spark.createDataFrame([(i, "", None if f.isDirectory() else f.getLen()) for i, f in enumerate(found)], schema)]
    while n := levels[-1].filter("size IS NULL").count():
        folders = levels[-1].filter("size IS NULL").select("root", "at").repartition(-(-n // FOLDERS_A_TASK), "root", "at")
        levels.append(written(folders.mapInArrow(level, schema), "listing"))
    files = levels[0]
    for one in levels[1:]:
        files = files.unionByName(one)
    files = files.filter("size IS NOT NULL")
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    name = F.element_at(F.array(*map(F.lit, names)), F.col("root") + 1)
    dealt = files.select(F.concat(name, "at").alias("path"), "size", "root", "at").repartition(max(1, -(-n // FILES_A_TASK) + size // BYTES_A_TASK), "path")
    return dealt, opened
