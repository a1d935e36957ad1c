"""Listing folders on whatever file system Spark is configured for."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    system, path = _path(spark, folder)
    return system.exists(path)


def children(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names and full paths of the direct entries of a folder."""
    system, path = _path(spark, folder)
    found = [status.getPath() for status in system.listStatus(path)]
    return {p.getName(): p.toString() for p in found}


def is_folder(spark: SparkSession, place: str) -> bool:
    system, path = _path(spark, place)
    return system.getFileStatus(path).isDirectory()


def first_line(spark: SparkSession, file: str, limit: int = 1 << 16) -> str:
    """The first line of a text file, without its end; at most ``limit`` bytes of text are read.

    A file whose name ends as a codec's does is unpacked, as Spark's readers do.
    """
    system, path = _path(spark, file)
    stream = system.open(path)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
        spark._jsc.hadoopConfiguration()).getCodec(path)
    try:
        if codec is not None and system.getFileStatus(path).getLen():
            stream = codec.createInputStream(stream)
        head = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(
            spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, limit)))
    finally:
        stream.close()
    return head.decode("utf-8-sig", "replace").split("\n", 1)[0].rstrip("\r")


def remove(spark: SparkSession, folder: str) -> None:
    system, path = _path(spark, folder)
    system.delete(path, True)


def create(spark: SparkSession, file: str, text: str) -> None:
    """A new file with this text; FileExistsError if there is one of that name."""
    system, path = _path(spark, file)
    try:
        out = system.create(path, False)
    except Py4JJavaError:
        if system.exists(path):
            raise FileExistsError(file) from None
        raise
    try:
        out.write(text.encode())
    finally:
        out.close()


def read(spark: SparkSession, file: str) -> str:
    system, path = _path(spark, file)
    stream = system.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(
            "utf-8", "replace")
    finally:
        stream.close()


def age_hours(spark: SparkSession, folder: str) -> float:
    """Hours since a file or folder was last changed."""
    system, path = _path(spark, folder)
    return (time.time() * 1000 - system.getFileStatus(path).getModificationTime()) / 3_600_000
