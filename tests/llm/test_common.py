"""Look-ups with hot keys, and slices of batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from corvane.llm.common import blocks, buffers, lookup


def test_lookup_as_a_left_join(spark):
    big = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k bigint, x int")
    small = big.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2).where("k % 5 <> 0 OR k = 7").cache()
    got = lookup(big, small, "k", "n")
    want = big.join(small.drop("n"), "k", "left").select("k", "x", "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "spread" in plan.split("Join LeftOuter")[1].split("\n")[0], "hot rows must be spread in the join"
    even = small.where("k <> 7")
    assert sorted(map(str, lookup(big, even, "k", "n").collect())) == sorted(map(str, big.join(even.drop("n"), "k", "left").select("k", "x", "v").collect()))


def test_blocks_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 900, 3, 3)] + [None])], ["text"])
    cut = list(blocks(iter([batch, batch.slice(0, 0)]), "text", 10))
    assert [b.num_rows for b in cut] and sum(b.num_rows for b in cut) == 6
    raw, at = buffers(batch.slice(2, 3).column("text"))
    assert len(raw) == 906 and at.tolist() == [0, 900, 903, 906]
