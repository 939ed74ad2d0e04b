"""Numbered versions of a folder, published one at a time.

A version is one small JSON document ``_versions/<number>.json`` that names what
belongs to it (folders of files that are never changed afterwards). It is written
last, by a create that fails if the number is taken, and ends with a checksum:
readers take the newest document that is whole. A job that dies before leaves files
that no version names, and the version before it stays as it is. Two writers cannot
publish the same number: the slower one gets ``VersionConflict``.

Files are reached through the session's Hadoop file system, so the folder may lie
wherever Spark reads and writes.
"""

from __future__ import annotations

import json
import uuid
import zlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class VersionConflict(Exception):
    """Another job published this version number first."""


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in ``folder``, sorted; none if there is no such folder."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """A new file with ``text``; False if there is one already."""
    fs, p = _at(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def new_name() -> str:
    return uuid.uuid4().hex


def _number(name: str) -> int | None:
    stem, dot, end = name.partition(".")
    return int(stem) if end == "json" and stem.isdigit() else None


def latest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """(highest number used, the newest whole document or None)."""
    known = sorted((n for n in map(_number, names(spark, f"{folder}/_versions")) if n is not None), reverse=True)
    for n in known:
        doc = load(spark, folder, n)
        if doc is not None:
            return known[0], doc
    return (known[0] if known else 0), None


def load(spark: SparkSession, folder: str, number: int) -> dict | None:
    """The document of a version, None if it was not written to its end."""
    body, _, check = read_text(spark, f"{folder}/_versions/{number:012d}.json").rstrip("\n").rpartition("\n")
    return json.loads(body) if check == str(zlib.crc32(body.encode())) else None


def publish(spark: SparkSession, folder: str, number: int, doc: dict) -> None:
    """Make ``doc`` version ``number``."""
    body = json.dumps({**doc, "version": number}, sort_keys=True)
    if not create_text(spark, f"{folder}/_versions/{number:012d}.json", f"{body}\n{zlib.crc32(body.encode())}\n"):
        raise VersionConflict(f"version {number} of {folder}")
