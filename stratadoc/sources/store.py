"""Stored tables that are published as a whole: a reader sees a version with all its tables or not at all.

A version is a folder of its own, written first; a small file that names it, with the settings it was made by, is put
beside it last, under its final name in one step. Whoever stops between the two leaves a folder that nobody reads.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import SparkSession

#: Versions that stay, the published one included, so that who reads the one before can end.
KEPT = 2


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def listed_digest(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of change of all files under path; their contents aren't read."""
    at, fs = _path(spark, path)
    files, seen = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().toString()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def new_version(folder: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}"


def _published(spark: SparkSession, folder: str) -> list[str]:
    at, fs = _path(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in names if n.startswith("version-") and n.endswith(".json"))


def publish(spark: SparkSession, folder: str, version: str, settings: dict) -> None:
    """Makes version the one that readers of folder take. Versions before the last one go."""
    name = f"version-{time.time_ns():020d}.json"
    draft, fs = _path(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(json.dumps({"version": version, "settings": settings}).encode())
    out.close()
    if not fs.rename(draft, _path(spark, f"{folder}/{name}")[0]):
        raise OSError(f"{folder}/{name} couldn't be published")
    for old in _published(spark, folder)[:-KEPT]:
        gone = _read(spark, folder, old)["version"]
        fs.delete(_path(spark, f"{folder}/{old}")[0], False)
        if gone.startswith(folder):
            fs.delete(_path(spark, gone)[0], True)


def _read(spark: SparkSession, folder: str, name: str) -> dict:
    at, fs = _path(spark, f"{folder}/{name}")
    stream = fs.open(at)
    try:
        text = spark._jvm.scala.io.Source.fromInputStream(stream, "UTF-8").mkString()
    finally:
        stream.close()
    return json.loads(text)


def published(spark: SparkSession, folder: str, settings: dict | None = None) -> str | None:
    """The version that readers of folder take, where it was made by these settings (by any, where none are given)."""
    names = _published(spark, folder)
    if not names:
        return None
    found = _read(spark, folder, names[-1])
    return found["version"] if settings is None or found["settings"] == settings else None
