"""Files by path or URI, on executors by pyarrow and on the driver by Hadoop's file systems, and a shared folder for what is written on the way."""

from __future__ import annotations

import atexit
import re
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and runs in one process, as in local tests.
LOCAL_DIR = "/tmp/checkpoints"
RUN = uuid.uuid4().hex


def local(path: str) -> str | None:
    """The path of a local file, given with or without ``file:``; None for other stores."""
    if path.startswith("file:"):
        return unquote(urlparse(path).path)
    return None if "://" in path else path


def open_input(path: str):
    """A seekable file to read bytes from."""
    if (own := local(path)) is not None:
        return open(own, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def open_output(path: str):
    if (own := local(path)) is not None:
        return open(own, "wb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner)


def shared_dir(spark: SparkSession) -> str:
    """This process's folder in the one that driver and executors share (``spark.checkpoint.dir``); it goes when the process ends."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{named or LOCAL_DIR}/files-{RUN}"
    atexit.unregister(delete)
    atexit.register(delete, spark, path)
    return path


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete(spark: SparkSession, path: str) -> None:
    try:
        at, system = _hadoop(spark, path)
        system.delete(at, True)
    except Exception:  # at the process's end the JVM may have gone before it
        pass


def make_dir(spark: SparkSession, path: str) -> None:
    at, system = _hadoop(spark, path)
    system.mkdirs(at)


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _hadoop(spark, path)
    return system.exists(at)


def join_parts(spark: SparkSession, parts: str, path: str, header: str) -> None:
    """One file of ``header`` and all part files of the folder ``parts`` in the order of their names; streamed, whatever their size."""
    folder, system = _hadoop(spark, parts)
    out = system.create(_hadoop(spark, path)[0], True)
    try:
        out.write(bytearray(header.encode()))
        for name in sorted(f.getPath().toString() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")):
            part = system.open(_hadoop(spark, name)[0])
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file whose whole content is ``text``, put in place in one step."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    at, system = _hadoop(spark, fresh)
    out = system.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    end = _hadoop(spark, path)[0]
    system.delete(end, False)
    if not system.rename(at, end):
        raise OSError(f"{path} can't be written")


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet at ``path`` and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
