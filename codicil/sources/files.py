"""Small files (pointers, registers, artifacts, receipts) where the tables beside them are.

A path with a scheme (``s3a://``, ``hdfs://``, ``file:/``) goes through the file
system of the running session, as Spark's own reads and writes do; one without
is a folder of this machine. Files appear whole: they are written under another
name and renamed.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from codicil.errors import PipelineError


def is_remote(path: str) -> bool:
    return re.match(r"[a-z][a-z0-9+.-]*:/", path) is not None


def join(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts]) if is_remote(root) else os.path.join(root, *parts)


def _remote(path: str):
    """The session's file system for a path, and the path in its terms."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise PipelineError("no_session", f"{path} needs a running session")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(path: str) -> bool:
    if not is_remote(path):
        return os.path.exists(path)
    fs, p, _ = _remote(path)
    return fs.exists(p)


def read(path: str) -> bytes:
    """The content; FileNotFoundError where there is none."""
    if not is_remote(path):
        with open(path, "rb") as f:
            return f.read()
    fs, p, jvm = _remote(path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write(path: str, data: bytes) -> None:
    """Writes a file whole or not at all."""
    if not is_remote(path):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
        return
    fs, p, jvm = _remote(path)
    fs.mkdirs(p.getParent())
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, False)
    try:
        stream.write(data)
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), fs.getConf())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = SparkSession.getActiveSession().sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(part, p, options)


def delete(path: str) -> None:
    """Removes a file or folder; nothing happens where there is none."""
    if not is_remote(path):
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        elif os.path.exists(path):
            os.unlink(path)
        return
    fs, p, _ = _remote(path)
    fs.delete(p, True)


@contextmanager
def exclusive(path: str) -> Iterator[None]:
    """Held by one process at a time, else BlockingIOError at once.

    On this machine the system frees the lock of a process that has ended. In
    another file system the lock is a file made only where there is none; one
    left by a process that was killed has to be removed by hand, and says so.
    """
    if is_remote(path):
        fs, p, _ = _remote(path)
        try:
            fs.create(p, False).close()
        except Exception as e:  # noqa: BLE001 - which class depends on the file system
            raise BlockingIOError(f"{path} exists; remove it if no publication runs") from e
        try:
            yield
        finally:
            fs.delete(p, False)
        return
    import fcntl

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise BlockingIOError(path) from e
        yield
