"""Names that can be taken once only: files created exclusively on the shared file system."""

from __future__ import annotations

import os
import time
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Taken:
    """Small files below a folder, each created by exactly one of all that try.

    The file system decides: a create without overwrite on HDFS and on object stores that
    have it as one request, a hard link on a local disk. Needs a classic session.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark.sparkContext._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(folder)
        self._files = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._folder, name)

    def take(self, name: str, text: str) -> bool:
        """Create the file with this text. False if it is there already, whoever made it."""
        path = self._path(name)
        self._files.mkdirs(path.getParent())
        if self._files.getScheme() == "file":
            return _link(path.toUri().getPath(), text)
        try:
            out = self._files.create(path, False)
        except Py4JJavaError:
            if self._files.exists(path):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def text(self, name: str, patience: float = 10.0) -> str:
        """What the file says. Its maker may still be writing, so an empty one is looked at again for some seconds."""
        until = time.monotonic() + patience
        while True:
            stream = self._files.open(self._path(name))
            found = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if found or time.monotonic() > until:
                return found
            time.sleep(0.1)

    def has(self, name: str) -> bool:
        return self._files.exists(self._path(name))

    def give_back(self, name: str) -> None:
        """Remove the file, if it is there, so that the name can be taken again."""
        self._files.delete(self._path(name), False)

    def names(self, folder: str = "") -> list[str]:
        """The names below a folder, sorted; none if there is no such folder."""
        path = self._path(folder) if folder else self._folder
        if not self._files.exists(path):
            return []
        found = (status.getPath().getName() for status in self._files.listStatus(path))
        return sorted(name for name in found if not name.startswith("."))


def _link(target: str, text: str) -> bool:
    """A complete file appears under its name, or the name was taken."""
    written = os.path.join(os.path.dirname(target), f".{uuid4().hex}")
    with open(written, "x") as out:
        out.write(text)
    try:
        os.link(written, target)
    except FileExistsError:
        return False
    finally:
        os.unlink(written)
    return True
