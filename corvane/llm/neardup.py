"""Near-duplicate documents: MinHash bands, verified links, connected components."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import wordnum
from corvane.llm.common import blocks, buffers, dropped, giving_back, lookup, python_ready, text_or_empty, without_keys, written

#: Words in a shingle; minima of a signature and its bands: a pair at 0.75 shares no band once in 200,000 times.
K, PERMS, BANDS = 5, 128, 32
#: Linked from so many hundredths on; a pair isn't verified if its signatures agree in less than LEAST (4.5 standard errors below).
PERCENT, LEAST = 75, 0.58
#: Members of a group up to which all its pairs between components are listed; rows and shingles of a block beyond it.
SMALL, BLOCK, BLOCK_SHINGLES = 6, 512, 2 << 20
#: Up to so many small rows (about 100 MB as a hash table) are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 2**31, PERMS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, PERMS, dtype=np.uint32)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; none for a text without words."""
    raw, at = buffers(column)
    starts, ends, offs = wordnum.words(raw, at, wordnum.SPACED)
    h = wordnum.word_hashes(raw, starts, ends)
    return [np.unique(wordnum.shingles(h[a:b], K)) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def signature(values: np.ndarray) -> np.ndarray:
    """The minima of PERMS universal hash functions over a set."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, (_A[:, None] * low[None, i : i + 4096] + _B[:, None]).min(axis=1), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    s = signatures.reshape(len(signatures), BANDS, -1).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * wordnum.PLACE[63]
    for j in range(s.shape[2]):
        key = key + (s[:, :, j] + np.uint64(1)) * wordnum.PLACE[j]
    return wordnum.mixed(key).view(np.int64)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_shingles, set_id (the set's fingerprint; null for an empty set), sketch (16 bits per minimum) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sets = shingle_sets(block.column("text"))
            sigs = np.stack([signature(s) for s in sets])
            ids = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
            thin = np.ascontiguousarray(sigs & np.uint32(0xFFFF), dtype=np.uint16)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(sigs).ravel()))
            yield pa.RecordBatch.from_arrays([block.column("key"), pa.array([len(s) for s in sets], pa.int64()), ids, pa.array([x.tobytes() for x in thin], pa.binary()), bands], ["key", "n_shingles", "set_id", "sketch", "bands"])

    return docs.select(docs[key].cast("bigint").alias("key"), text_or_empty(text).alias("text")).mapInArrow(giving_back(run), "key bigint, n_shingles bigint, set_id binary, sketch binary, bands array<bigint>")


def small(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a few numbers as a written table, to be broadcast in a join if there are no more than BROADCAST_ROWS."""
    rows = written(rows, name, 1)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def full_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """wanted's columns, of which `node` is a key, and values: the whole shingle sets of the wanted keys."""
    own = docs.select(docs[key].cast("bigint").alias("node"), text_or_empty(text).alias("text")).join(wanted, "node")
    names = wanted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sets = shingle_sets(block.column("text"))
            offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in names], pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(sets).view(np.int64)))], [*names, "values"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)
    return own.mapInArrow(giving_back(run), f"{kinds}, values array<bigint>")


def _alike(both: DataFrame) -> DataFrame:
    """The rows whose sets va and vb are similar enough."""
    both = both.where(F.least(F.size("va"), F.size("vb")) * 100 >= F.greatest(F.size("va"), F.size("vb")) * PERCENT)
    both = both.withColumn("common", F.size(F.array_intersect("va", "vb")))
    return both.where(F.col("common") * 100 >= (F.size("va") + F.size("vb") - F.col("common")) * PERCENT)


def _first_links(sets: DataFrame) -> DataFrame:
    """(a, b): the nodes b that are similar to the first node they meet.

    A node that is the first of more than BLOCK others is sent to several partitions, each with a share of them.
    """
    right = sets.where("first < node").select(F.col("first").alias("a"), "part", F.col("node").alias("b"), F.col("values").alias("vb"))
    left = sets.where("leads").select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("values").alias("va"))
    return _alike(right.join(left, ["a", "part"])).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of pairs (a, b, ...) whose full sets are similar enough; sets that aren't in a pair stay where they are."""
    right = sets.select(F.col("node").alias("b"), F.col("values").alias("vb")).join(pairs, "b")
    ids = small(pairs.select("a").distinct(), "ids")
    left = sets.select(F.col("node").alias("a"), F.col("values").alias("va")).join(ids, "a", "left_semi")
    return _alike(right.join(left, "a")).select(*pairs.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by alternating large-star and small-star; written.

    Edges: (a, b) in any order; self loops and repeats do no harm. They are held once, from the larger node a
    to the smaller one b. Large star: an edge moves on to the smallest neighbour of its smaller end; small
    star: a node's smaller neighbours, and itself, move to the smallest of them. Both take the smallest neighbour from
    one grouped aggregation, which has a row per node, and join it to the edges: a node with very many of
    them is one row in the former, and its edges in the latter are split by adaptive execution.
    """

    def smallest(e: DataFrame, name: str) -> DataFrame:
        return e.groupBy(F.col("a").alias(name)).agg(F.min("b").alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", 1)
    before = state(now)
    while before[0]:
        large = written(now.join(smallest(now, "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b")), "edges", 1)
        least = smallest(large, "a")
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges", 1)
        after = state(new)
        dropped(now, large)
        now = new
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _joined(rows: pa.Table) -> pa.Table:
    """Links between the components of one block, or of two: enough of them to join all that full sets confirm."""
    node, own = np.asarray(rows["node"]), np.asarray(rows["component"])
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(len(node), PERMS)
    lists = rows["values"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, offs = np.asarray(lists.values), np.asarray(lists.offsets).astype(np.int64)
    size = np.diff(offs)
    one = rows["bi"][0].as_py() == rows["bj"][0].as_py()
    side = np.asarray(rows["side"])
    left, right = (np.arange(len(node)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    part = own.copy()
    found = []
    for i in left.tolist():
        others = right[(right > i) & (part[right] != part[i])] if one else right[part[right] != part[i]]
        others = others[np.minimum(size[others], size[i]) * 100 >= np.maximum(size[others], size[i]) * PERCENT]
        others = others[(sketch[others] == sketch[i]).sum(1) >= LEAST * PERMS]
        if not len(others):
            continue
        mine = flat[offs[i] : offs[i + 1]]
        many = np.concatenate([flat[offs[j] : offs[j + 1]] for j in others.tolist()])
        # Sets are held as unsigned numbers in order, and read as signed ones.
        mine = np.sort(mine)
        hit = mine[np.minimum(np.searchsorted(mine, many), len(mine) - 1)] == many
        common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[others])[:-1]]), dtype=np.int64)
        for j in others[common * 100 >= (size[others] + size[i] - common) * PERCENT].tolist():
            if part[j] != part[i]:
                found.append((own[i], own[j]))
                part[part == part[j]] = part[i]
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def _open(rows: DataFrame) -> DataFrame:
    """rows (lead, node, component, size) of the groups that hold several components, with the group's figures."""
    each = rows.groupBy("lead", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"))
    stats = each.groupBy("lead").agg(F.sum("m").alias("members"), F.sum("s").alias("shingles"), F.max(F.struct("m", "component", "s")).alias("main")).where("main.m < members")
    return rows.join(stats, "lead")


def _listed(live: DataFrame) -> DataFrame:
    """(a, b, ca, cb): all pairs between components in groups of SMALL members at most, but those looked at before."""
    few = live.where(F.col("members") <= SMALL).groupBy("lead").agg(F.sort_array(F.collect_list(F.struct("node", "component", "tried"))).alias("m"))
    new = lambda x, y: (y["component"] != x["component"]) & ~((x["node"] == F.col("lead")) & y["tried"])
    pair = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(F.slice("m", i + 2, SMALL), lambda y: new(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), x["component"].alias("ca"), y["component"].alias("cb")))))
    return few.select(F.inline(pair)).distinct()


def _in_blocks(live: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between components in larger groups.

    The members outside a group's largest component are dealt into blocks; each block meets itself, every
    other such block, and every block of the largest component. So a row of that component, which may
    have most of all rows, is sent as often as there are blocks of others: mostly once. Blocks are made for about
    BLOCK rows and BLOCK_SHINGLES shingles at most.
    """
    many = live.where(F.col("members") > SMALL)
    blocks_of = lambda n, shingles: F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    many = many.withColumn("p", blocks_of(F.col("members") - F.col("main.m"), F.col("shingles") - F.col("main.s"))).withColumn("q", blocks_of(F.col("main.m"), F.col("main.s")))
    is_main = F.col("component") == F.col("main.component")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("q")).otherwise(F.col("p"))).cast("int")
    many = many.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("p") - 1).otherwise(F.col("p") + F.col("q") - 1))))
    low = F.when(is_main, F.col("other")).otherwise(F.least("own", "other"))
    high = F.when(is_main, F.col("p") + F.col("own")).otherwise(F.greatest("own", "other"))
    side = (is_main | (F.col("own") > F.col("other"))).cast("int")
    ids = small(many.select("node").distinct(), "ids")
    many = many.select("lead", "node", "component", low.alias("bi"), high.alias("bj"), side.alias("side"))
    content = nodes.select("node", "sketch").join(ids, "node", "left_semi").join(sets.select("node", "values").join(ids, "node", "left_semi"), "node")
    many = many.join(content, "node")
    return many.groupBy("lead", "bi", "bj").applyInArrow(_joined, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id and kept (the component's smallest key) of every row; the key is a unique integer.

    Rows of equal sets are one class first, so copies never meet each other below. A class's signature is
    cut into bands; in each bucket of a band a class is first verified against the smallest one it meets.
    What buckets with the same smallest class still hold in different components is then compared: small
    groups by all such pairs, large ones block by block, where a worker compares signatures, then full
    sets, and returns only links that join components. Every link is confirmed on full sets, and no
    candidate is dropped. Null, empty and blank texts
    have no set and are linked with nothing. Other columns aren't read. Rows that repeat a key come back
    each and count as one document; a row with a null key has its class's component, or null.

    Steps with two readers are tables in the shared folder, deleted once their last reader is written.
    """
    python_ready(docs.sparkSession)
    seen = written(sketches(docs, key, text), "sketches")
    classes = written(seen.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("n")), "classes")
    nodes = written(seen.join(classes.select("node").hint("merge"), seen["key"] == classes["node"]).select("node", F.col("n_shingles").alias("size"), "sketch", "bands"), "nodes")
    rows = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1").drop("n")
    # Members of a bucket share its smallest one; buckets with the same one are one group, so bands repeat little.
    met = written(rows.join(shared, "bucket").groupBy("node").agg(F.max("size").alias("size"), F.array_sort(F.collect_set("first")).alias("leads")), "met")
    firsts = met.select("node", F.get("leads", F.lit(0)).alias("first"), F.array_contains("leads", F.col("node")).alias("leads"))
    hot = small(firsts.where("first < node").groupBy("first").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).where("parts > 1"), "hot")
    one = F.lit(1).cast("bigint")
    firsts = firsts.join(hot, "first", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", one))).drop("parts")
    firsts = firsts.join(hot.withColumnRenamed("first", "node"), "node", "left").withColumn("parts", F.coalesce("parts", one))
    sets = written(full_sets(docs, key, text, small(firsts, "firsts")), "sets")
    parts = components(_first_links(sets))
    groups = met.join(parts, "node", "left").select(F.posexplode("leads").alias("place", "lead"), "node", F.coalesce("component", "node").alias("component"), "size")
    live = written(_open(groups.withColumn("tried", F.col("place") == 0).drop("place")), "live")
    new = verified(small(_listed(live), "listed"), sets).select(F.col("ca").alias("a"), F.col("cb").alias("b")).unionByName(_in_blocks(live, nodes, sets))
    above = components(new).select(F.col("node").alias("component"), F.col("component").alias("above"))
    known = classes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).join(above, "component", "left")
    known = written(known.select("set_id", "n", F.coalesce("above", "component").alias("component")), "known")
    dropped(classes, nodes, met, sets, parts, live, above)
    out = lookup(seen.select("key", "n_shingles", "set_id"), known, "set_id", "n")
    out = out.withColumn("component_id", F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest key. Rows that repeat it stay, as do rows with a null key."""
    gone = near_duplicates(docs, key, text).where(~F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias("gone"))
    return without_keys(docs, key, gone, "gone")


def oracle() -> str:
    """DuckDB SQL of `near_duplicates` over documents: pairs by their common shingles, and all that a row reaches."""
    return rf"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n AS u ON u.doc_id = a JOIN n AS v ON v.doc_id = b WHERE 100 * c >= 75 * (u.n + v.n - c)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id),
    k AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""
