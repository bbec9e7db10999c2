"""Writers: partitioned shards, JSON payloads, single files that appear whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.operators.gates import GateError


def shard_name(stem: str, shard: int, n: int) -> str:
    return f"{stem}_shard{shard:05d}of{n:05d}.json"


def merged_name(stem: str) -> str:
    return f"{stem}_merged.json"


def payloads(rows: DataFrame, shard: str, order: str, manifest: dict, summary: Mapping[str, Column] | None = None) -> DataFrame:
    """shard and payload: one JSON object per shard with its rows in order, its size, the manifest, and `summary`, aggregates over its rows.

    A payload is one value, so a shard is as large as that may be; for larger ones see `shards.ShardSource`.
    """
    fields = [c for c in rows.columns if c != shard]
    said = [F.struct(*[c.alias(n) for n, c in summary.items()]).alias("summary")] if summary else []
    per = rows.groupBy(shard).agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("row")))).alias("r"), F.count(F.lit(1)).alias("n"), *said)
    body = F.struct(F.lit(True).alias("complete"), F.lit(json.dumps(manifest, sort_keys=True)).alias("manifest"), F.col("n").alias("num_rows"), F.transform("r", lambda x: x["row"]).alias("per_problem"), F.col(shard).alias("shard_id"), *(["summary"] if summary else []))
    return per.select(shard, F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def write_partitioned(rows: DataFrame, path: str, *keys: str) -> None:
    """Parquet by partition; only the partitions that occur are replaced, so a shard can be written again."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Put a file in another's place in one step, so that a reader finds the old or the new one at any moment.

    On a local disk that is the operating system's own rename, elsewhere Hadoop's with overwriting: one
    operation of the name node on HDFS, and as good as the store's own on others.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    conf = spark._jsc.hadoopConfiguration()
    fs = new.getFileSystem(conf)
    if fs.getScheme() == "file":
        moves = gateway.new_array(jvm.java.nio.file.CopyOption, 1)
        moves[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
        place = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
        jvm.java.nio.file.Files.move(place(old), place(new), moves)
        return
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(old, new, options)


def write_json_atomic(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON file with sorted keys, through Spark's file systems: written beside, then put in place; nothing is left on failure."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    # A local file without a checksum file beside it: that would go with another content's name.
    fs = fs.getRawFileSystem() if fs.getScheme() == "file" else fs
    try:
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
        out.hsync() if hasattr(out, "hsync") else out.flush()
        out.close()
        replace_file(spark, beside.toString(), path)
    finally:
        if fs.exists(beside):
            fs.delete(beside, False)


def publish(rows: DataFrame, path: str, counters: Mapping[str, Column] | None = None, gates: Mapping[str, Column] | None = None) -> dict[str, int]:
    """Write rows as a new version of the table under a path, and let readers see it once it is whole and passes its gates.

    counters: aggregates; gates: conditions of a row that is at fault. Both are measured in the pass that writes, without a
    scan of their own. A gate that finds a row raises GateError with its counts, and the version goes; else
    one file, replaced in one step, names it. The version before stays for readers that began with it. Returns `rows` and the counters.
    """
    spark = rows.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    seen, counters, gates = Observation(version), dict(counters or {}), dict(gates or {})
    measures = [F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counters.items()], *[F.count_if(g).alias(f"gate {n}") for n, g in gates.items()]]
    rows.observe(seen, *measures).write.parquet(f"{path}/{version}")
    got = {k: v or 0 for k, v in seen.get.items()}
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if bad := [(n, got[f"gate {n}"]) for n in gates if got[f"gate {n}"]]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{version}"), True)
        raise GateError("rows at fault", bad)
    before = _pointer(spark, path).get("version")
    metrics = {n: got[n] for n in ("rows", *counters)}
    write_json_atomic(spark, {"version": version, "previous": before, "metrics": metrics}, f"{path}/current.json")
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(status.getPath(), True)
    return metrics


def _pointer(spark: SparkSession, path: str) -> dict:
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current.json")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return {}
    return json.loads(spark.read.text(pointer.toString(), wholetext=True).first()[0])


def published(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """The version of a table that counts now, and what was measured when it was written."""
    now = _pointer(spark, path)
    if not now:
        raise FileNotFoundError(f"nothing is published under {path}")
    return spark.read.parquet(f"{path}/{now['version']}"), now["metrics"]


def report(rows: DataFrame, title: str, most: int = 50) -> str:
    """A small table as text: summaries only."""
    got = rows.limit(most).toPandas()
    return f"{title}\n{got.to_string(index=False)}"
