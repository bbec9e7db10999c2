"""Benchmark decontamination by DataFrame functions alone: broadcast n-gram set, verified hits, removal."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import without_keys, written

#: Fixed values of the contract: what is no word, after lower-casing A-Z, and a window's words.
NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
N = 10
#: Up to so many windows' signatures are broadcast (about 50 MB as a hash table); more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000


def folded(text: Column) -> Column:
    """Lower-case A-Z alone. ASCII texts take the byte-wise built-in, which then does just that."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(f"[^{NOT_WORD}]+"), F.lit(0))


def let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _signature(w: Column, i: Column, n: int) -> Column:
    """A hash of a window's size and a few of its words: equal windows have equal ones, so it can only let too much through."""
    return F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in sorted({0, n // 3, 2 * n // 3, n - 1})])


def _window(w: Column, i: Column, n: Column) -> Column:
    return F.array_join(F.slice(w, i + 1, n), " ")


def _sized(w: Column, i: Column, sizes: list[int]) -> Column:
    """(size, signature) of the windows that begin at place i; no signature where the text ends before."""
    one = lambda k: F.struct(F.lit(k).alias("size"), F.when((i >= 0) & (i + k <= F.size(w)), _signature(w, i, k)).alias("signature"))
    return F.array(*[one(k) for k in sizes])


def windows(bench: DataFrame, n: int = N, item: str = "item_id", text: str = "text") -> DataFrame:
    """(size, signature, window, item): the benchmark's distinct windows by item; an item of fewer words is one window."""
    w = bench.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    w = w.select("item", "w", F.least(F.size("w"), F.lit(n)).alias("size"))
    rows = w.select("item", "w", "size", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("i"))
    own = F.coalesce(*[F.when(F.col("size") == k, _signature(F.col("w"), F.col("i"), k)) for k in range(1, n + 1)])
    return rows.select("size", own.alias("signature"), _window(F.col("w"), F.col("i"), F.col("size")).alias("window"), "item").distinct()


def _scanned(base: DataFrame, known: DataFrame, sizes: list[int], few: bool) -> DataFrame:
    """Of each row of base (hit_row, own, w) one row with place -1, n_words and own, and one for each place whose signature is known, with the window.

    `few`: the set of signatures is broadcast, and one pass over the texts does it all. Otherwise
    (hit_row, place, size, signature) are shuffled, windows only of what meets a signature.
    """
    signatures = known.select("signature").distinct()
    rows = base.select("hit_row", "own", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("place"))
    rows = rows.select("hit_row", "own", "w", "place", F.inline(_sized(F.col("w"), F.col("place"), sizes)))
    is_own, n_words = (F.col("place") < 0) & (F.col("size") == sizes[0]), F.size("w").cast("bigint").alias("n_words")
    if few:
        met = rows.join(F.broadcast(signatures.withColumn("met", F.lit(True))), "signature", "left").where(is_own | F.col("met"))
        return met.select("hit_row", "place", "size", F.when(is_own, n_words).alias("n_words"), F.when(is_own, F.col("own")).alias("own"), F.when(~is_own, _window(F.col("w"), F.col("place"), F.col("size"))).alias("window"))
    met = rows.where("signature IS NOT NULL").select("hit_row", "place", "size", "signature").join(signatures, "signature", "left_semi").select("hit_row", "place", "size")
    met = met.join(base.select("hit_row", "w"), "hit_row").select("hit_row", "place", "size", F.lit(None).cast("bigint").alias("n_words"), _window(F.col("w"), F.col("place"), F.col("size")).alias("window"))
    own = base.select("hit_row", F.lit(-1).alias("place"), F.lit(sizes[0]).alias("size"), n_words, "own")
    return own.unionByName(met, allowMissingColumns=True)


def hits(docs: DataFrame, bench: DataFrame, n: int = N, text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """own (a struct of the columns `keep`), n_words, places [(place, size)] and items of each row of docs."""
    known = written(windows(bench, n), "windows")
    figures = known.groupBy("size").agg(F.count_distinct("signature").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy("size").collect()
    sizes, few, few_items = [r["size"] for r in figures] or [n], sum(r["n"] for r in figures) <= broadcast_windows, sum(r["rows"] for r in figures) <= broadcast_windows
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    base = docs.select(F.monotonically_increasing_id().alias("hit_row"), F.struct(F.lit(0).alias("_"), *[docs[c].alias(f"c{k}") for k, c in enumerate(keep)]).alias("own"), words(docs[text]).alias("w"))
    found = written(_scanned(base if few else written(base, "words"), known, sizes, few), "scanned")
    side = lambda df: F.broadcast(df) if few_items else df
    met = found.where("place >= 0").select("hit_row", "place", "size", "window").join(side(known.select("size", "window").distinct()), ["size", "window"], "left_semi")
    places = met.groupBy("hit_row").agg(F.array_sort(F.collect_set(F.struct("place", "size"))).alias("places"))
    # A window of many items meets each of a document's windows once, and never a list of them.
    items = met.select("hit_row", "size", "window").distinct().join(side(known.select("size", "window", "item")), ["size", "window"])
    items = items.groupBy("hit_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = found.where("place < 0").select("hit_row", "own", "n_words").join(places, "hit_row", "left").join(items, "hit_row", "left")
    none = F.array().cast("array<struct<place:int,size:int>>")
    return out.select("own", "n_words", F.coalesce("places", none).alias("places"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def covered(places: Column) -> Column:
    """How many words the windows at sorted places cover, each word once."""
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["place"] + x["size"] - F.greatest(x["place"], a["end"]))).alias("n"), F.greatest(a["end"], x["place"] + x["size"]).alias("end"))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"]).cast("bigint")


def contamination(docs: DataFrame, bench: DataFrame, n: int = N, text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs' other columns, n_words, n_hit (words inside any window's occurrence), items and places.

    Null texts have no words; empty texts, an empty benchmark and items without words give no hits; an
    item shorter than a window is one window. Every row of docs comes back, repeated ones too. Words and
    windows are compared as texts: the hashed set only picks candidates. Columns of docs that are named
    n_words, n_hit, items or places are replaced; other names can't clash.
    """
    new = ("n_words", "n_hit", "items", "places")
    keep = [c for c in docs.columns if c != text and c not in new]
    out = hits(docs, bench, n, text, broadcast_windows, keep)
    return out.select(*[F.col(f"own.c{k}").alias(c) for k, c in enumerate(keep)], "n_words", covered(F.col("places")).alias("n_hit"), "items", "places")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns of what `contamination` returns."""
    return found.select(key, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_documents(docs: DataFrame, bench: DataFrame, key: str = "doc_id", most: int = 0, n: int = N, text: str = "text") -> DataFrame:
    """The rows of docs whose windows cover `most` words at most. Rows of the same key, null included, go or stay together."""
    bad = contamination(docs.select(docs[key].alias("bad_key"), docs[text].alias("text")), bench, n).where(F.col("n_hit") > most).select("bad_key")
    return without_keys(docs, key, bad, "bad_key")


def without_spans(docs: DataFrame, bench: DataFrame, text: str = "text", n: int = N) -> DataFrame:
    """docs with the covered words cut out of the text, each with what stands before it since the last word."""
    found = hits(docs, bench, n, text, keep=docs.columns)
    columns = {c: F.col(f"own.c{k}") for k, c in enumerate(docs.columns)}
    upper = NOT_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")  # the same words, before lower-casing
    pieces = F.regexp_extract_all(columns[text], F.lit(f"[{upper}]*[^{upper}]+|[{upper}]+$"), F.lit(0))
    inside = lambda i: F.exists("places", lambda p: (i >= p["place"]) & (i < p["place"] + p["size"]))
    kept = F.array_join(F.filter(pieces, lambda x, i: ~inside(i)), "")
    columns[text] = F.when(F.size("places") == 0, columns[text]).otherwise(kept)
    return found.select(*[v.alias(c) for c, v in columns.items()])


def oracle(n: int = N) -> str:
    """DuckDB SQL of the digest over the tables documents and benchmark."""
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^{NOT_WORD}]+')"
    return f"""
    WITH d AS (SELECT doc_id, {split} AS w FROM documents),
    b AS (SELECT item_id, {split} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least({n}, len(w)) AS n, array_to_string(w[i:i + least({n}, len(w)) - 1], ' ') AS g
           FROM b, unnest(range(1, len(w) - least({n}, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
    h AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(0, n)) AS r(k) GROUP BY doc_id),
    s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""
