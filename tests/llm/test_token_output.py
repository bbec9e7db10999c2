"""Grammar shards: exact round trips, and ids as the library's."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corvane.llm import token_output as out
from corvane.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["", None, "a", " ", "\n\n", "Don't STOP <|endoftext|> now", "é É ﬁ İi ΣΑΣ ς", "a b c\x1cd\x85e\tf", "é ́x", "<|startoftext|>", "x" * 3000, "日本 語", "a <|endoftext|>b<|endoftext|> c"]


def test_words_give_the_ids_of_the_whole_text():
    r = random.Random(4)
    texts = [t or "" for t in ODD] + ["".join(r.choice("ab \n\t'sé1!İ́") for _ in range(r.choice([5, 400]))) for _ in range(200)]
    e = out.WordEncoder(PATH)
    ids, ends = e.encode(pa.array(texts))
    got = [x.tolist() for x in np.split(ids, ends)[:-1]]
    assert got == [[*e.tokenizer.encode(t, add_special_tokens=False).ids, out.END] for t in texts]


def test_repair_round_trip_and_random_access():
    r = np.random.default_rng(8)
    ids = np.concatenate([np.tile([5, 6, 7, 8], 300), r.integers(0, 40, 5000), np.full(999, 3), r.integers(0, 49408, 500)])
    ends = np.unique(np.concatenate([r.integers(1, len(ids), 60), [len(ids)]]))
    data = out.pack(np.arange(len(ends)), ids, ends, 49408)
    shard = out.Shard(data)
    assert shard.all().tolist() == ids.tolist() and len(shard.rules) > 0 and len(shard.symbols) < len(ids) * 0.8
    begins = [0, *ends[:-1].tolist()]
    for k in range(len(ends)):
        assert shard.document(k).tolist() == ids[begins[k] : ends[k]].tolist()
    assert (np.diff(shard.offs)[49408:] == shard.lengths).all()


def test_files_read_back(spark, monkeypatch):
    monkeypatch.setattr(out, "SHARD_IDS", 500)
    r = random.Random(1)
    texts = {7 * i - 20: t for i, t in enumerate(ODD + [" ".join(r.choice(["red", "blue", "Green's"]) for _ in range(r.randrange(200))) for _ in range(60)])}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id bigint, text string, start int")
    got = {x["doc_id"]: x for x in out.read_shards(out.write_shards(docs, PATH)).collect()}
    e, start = out.WordEncoder(PATH), 0
    for i in sorted(texts):
        ids = [*e.tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, out.END]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_empty_table(spark):
    assert out.read_shards(out.write_shards(spark.createDataFrame([], "doc_id bigint, text string"), PATH)).count() == 0


def test_ranges_have_like_bytes_and_hot_keys_are_split(spark):
    """A third of the keys null, a third one key, texts of very different lengths: order kept, no partition with most of the bytes."""
    r = random.Random(6)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else r.randrange(-(10**6), 10**6), " ".join(str(r.random()) for _ in range(1 + i % 7 * (i % 3 == 2) * 20))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "text")
    dealt = out.in_key_order(keyed).withColumn("p", F.spark_partition_id())
    assert all(x.p == x.shard_place for x in dealt.collect())
    got = [(x.p, x.key, x.h) for x in dealt.select("p", "key", F.xxhash64("text").alias("h")).collect()]
    assert sorted(got) == sorted(got, key=lambda x: x[1:])  # partitions follow each other in the order of keys and hashes
    weights = [x.w for x in dealt.groupBy("p").agg(F.sum(F.octet_length("text")).alias("w")).collect()]
    assert max(weights) < 0.4 * sum(weights) and len(weights) >= 4
    e = out.WordEncoder(PATH)
    back = sorted((x.doc_id, x.n_tokens) for x in out.read_shards(out.write_shards(docs, PATH)).collect())
    assert back == sorted((-(1 << 63) if i is None else i, len(e.tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows)
    starts = sorted((x.start, x.n_tokens, x.doc_id) for x in out.read_shards(out.write_shards(docs, PATH)).collect())
    assert [s for s, _, _ in starts] == [sum(n for _, n, _ in starts[:k]) for k in range(len(starts))] and [d for _, _, d in starts] == sorted(d for _, _, d in starts)
