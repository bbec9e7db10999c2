"""The pipeline's stages on a small corpus with known cases: what goes, what stays, what is masked."""

import random

import corpus_pipeline
from corvane.llm.queries import tokenizer_path


def test_stages(spark, tmp_path):
    r = random.Random(12)
    word = lambda: "".join(r.choice("aeioustnrl") for _ in range(r.randrange(2, 8)))
    vocab = [word() for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    good = {i: text(r.randrange(20, 90)) for i in range(300)}
    bad = {1000 + i: " ".join(w + "###" for w in text(40).split()) for i in range(120)}
    item = text(30)
    special = {2000: good[5], 2001: good[6] + " extra", 2002: f"start {item} end", 2003: text(30) + " password = hunter2hunter2", 2004: None, 2005: ""}
    docs = good | bad | special
    frame = spark.createDataFrame([(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in docs.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in good] + [(i, 0, 0) for i in bad], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append({x["doc_id"]: x for x in now.collect()})
        if k < 4:
            assert now.columns == frame.columns
    quality, dedup, clean, masked, encoded = seen
    assert len(set(bad) & set(quality)) <= 3 and len(set(good) - set(quality)) <= 3
    assert 2000 not in dedup and 2001 not in dedup and {5, 6} <= set(dedup) | (set(good) - set(quality))
    assert 2002 not in clean and set(dedup) - set(clean) == {2002}
    assert set(masked) == set(clean) == set(encoded)
    assert "hunter2" not in masked[2003]["text"] and masked[2003]["n_chars"] == len(masked[2003]["text"])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert all(x["n_tokens"] == len(t.encode(masked[i]["text"] or "", add_special_tokens=False).ids) for i, x in encoded.items())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(encoded)
