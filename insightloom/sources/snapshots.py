"""Cached tables: built once for given settings, reused while they stay the same.

A snapshot's folder is named by a hash of its settings, among them what the
source's files look like.  Tables are written to a folder of the attempt; only
then the manifest, which names that folder, is put in place by a rename.  What
has no manifest doesn't exist for readers, so a job that died half way leaves
nothing behind but files that the next ``sweep`` removes.  Of two jobs that
build the same snapshot, the one whose manifest is in place is read by both.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fingerprint(spark: SparkSession, path: str) -> str:
    """Hash of the names, sizes and times of a source's files, from the store
    that Spark reads."""
    fs, at = _fs(spark, path)
    found = []
    for status in fs.globStatus(at) or ():
        walk = fs.listFiles(status.getPath(), True)
        while walk.hasNext():
            f = walk.next()
            if not f.getPath().getName().startswith((".", "_")):
                found.append((f.getPath().toUri().getPath(), f.getLen(), f.getModificationTime()))
    if not found:
        raise FileNotFoundError(path)
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


def _read(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _commit(spark: SparkSession, folder: str, manifest: dict) -> None:
    fs, aside = _fs(spark, f"{folder}/{manifest['attempt']}.json")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True), "utf-8"))
    out.close()
    _, final = _fs(spark, f"{folder}/{MANIFEST}")
    if fs.exists(final) or not fs.rename(aside, final):  # another job was first
        fs.delete(aside, False)


def _open(spark: SparkSession, folder: str, manifest: dict) -> dict[str, DataFrame]:
    return {name: spark.read.schema(T.StructType.fromJson(schema)).parquet(f"{folder}/{manifest['attempt']}/{name}") for name, schema in manifest["tables"].items()}


def cached(spark: SparkSession, root: str, settings: dict, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of a snapshot under ``root``; ``build`` runs only where there
    is none for these settings (anything that JSON can hold)."""
    key = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:32]
    folder = f"{root.rstrip('/')}/{key}"
    known = _read(spark, f"{folder}/{MANIFEST}")
    if known is None:
        attempt, tables = uuid.uuid4().hex, build()
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{attempt}/{name}")
        _commit(spark, folder, {"attempt": attempt, "settings": settings, "tables": {name: df.schema.jsonValue() for name, df in tables.items()}})
        known = _read(spark, f"{folder}/{MANIFEST}")
    return _open(spark, folder, json.loads(known))


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Removes attempts that no manifest names; for times when nobody builds."""
    fs, at = _fs(spark, root)
    gone = []
    for snapshot in fs.listStatus(at) if fs.exists(at) else ():
        folder = snapshot.getPath().toString()
        known = _read(spark, f"{folder}/{MANIFEST}")
        keep = {MANIFEST} | ({json.loads(known)["attempt"]} if known else set())
        for entry in fs.listStatus(snapshot.getPath()):
            if entry.getPath().getName() not in keep:
                gone.append(entry.getPath().toString())
                fs.delete(entry.getPath(), True)
    return gone
