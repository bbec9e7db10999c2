"""Digests of files, folders and record chains: hashing happens where the bytes are, only small records are chained."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def chain(records: Column) -> Column:
    """The SHA-256 of an array of strings, each behind its length in bytes as eight bytes, the highest first."""
    one = lambda r: F.concat(F.lpad(F.hex(F.octet_length(r)), 16, "0"), F.hex(F.encode(r, "utf-8")))
    return F.sha2(F.unhex(F.array_join(F.transform(records, one), "")), 256)


def chained(rows: DataFrame, group: list[str], order: Iterable[str], record: Column) -> DataFrame:
    """group, n and sha256: the chain of each group's records in an order. Records of one group meet in one row: hash large contents first."""
    part = F.struct(*order, record.alias("_record"))
    per = rows.groupBy(*group).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    return per.select(*group, F.size("_parts").cast("bigint").alias("n"), chain(F.transform("_parts", lambda p: p["_record"])).alias("sha256"))


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path (relative), size and sha256 of every file under a folder; a file is hashed by the task that reads it.

    Spark's readers leave out names that begin with a dot or an underscore, and so does this. They leave out empty
    files as well, which count here: those come from the folder's listing.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (read.option("pathGlobFilter", pattern) if pattern else read).load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    root = fs.makeQualified(root).toString().rstrip("/")
    glob = spark._jvm.org.apache.hadoop.fs.GlobFilter(pattern or "*")
    listed, empty = fs.listFiles(spark._jvm.org.apache.hadoop.fs.Path(path), True), []
    while listed.hasNext():
        one = listed.next()
        if not one.getLen() and glob.accept(one.getPath()):
            name = one.getPath().toString().removeprefix(root)[1:]
            if not any(p[0] in "._" for p in name.split("/")):
                empty.append((name, 0, hashlib.sha256(b"").hexdigest()))
    # Spark and Hadoop write a local root with one and with three slashes.
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    below = F.substr(bare(F.col("path")), F.length(bare(F.lit(root))) + 2)
    rows = found.select(below.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return rows.where("size > 0").unionAll(spark.createDataFrame(empty, "path string, size bigint, sha256 string"))


def directory_digest(spark: SparkSession, path: str) -> str:
    """One SHA-256 of a folder: the chain of [relative path, file's SHA-256] as JSON, in the order of the paths' parts. An empty folder is an error."""
    rows = files(spark, path).withColumns({"parts": F.split("path", "/"), "one": F.lit(1)})
    got = chained(rows, ["one"], ["parts"], F.to_json(F.array("path", "sha256"))).first()
    if got is None:
        raise ValueError(f"no file under {path}")
    return got["sha256"]


def shard_set_digest(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """n, sha256 of a set of shards: the chain of each file's name, SHA-256 and size as JSON with sorted keys, by name."""
    rows = files(spark, path, pattern).where(~F.col("path").contains("/")).withColumn("one", F.lit(1))
    record = F.to_json(F.struct(F.col("path").alias("name"), "sha256", F.col("size").alias("size_bytes")))
    return chained(rows, ["one"], ["path"], record).select("n", "sha256")
