"""Token ids in binary shards, compressed by Re-Pair grammars with random access by document."""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import wordnum
from corvane.llm.common import blocks, buffers, giving_back, python_ready, text_or_empty, written

#: The id that ends each document.
END = 2
#: A shard's most ids before compression: bounds what a worker holds; a partition writes as many shards as it needs.
SHARD_IDS = 4 << 20
#: Pairs in a round, and the fewest occurrences worth a rule.
PER_ROUND, LEAST = 4096, 8
#: Different pieces that a worker keeps with their ids: about 80 MB.
KEPT_WORDS = 3_000_000
#: Bytes of pieces: all but spaces and line breaks.
PIECE = np.ones(256, bool)
PIECE[[0x20, 0x0A]] = False
MAGIC = b"RPG1"


def repair(ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, each document's end among them, and the rules (left, right); rule k makes symbol vocabulary + k.

    Each round counts all neighbouring pairs, takes the most frequent ones of which none can overlap
    another (no symbol is the left of one and the right of another), and replaces their occurrences.
    Rounds end when no pair is left that occurs LEAST times, or no number for a symbol. No pair goes
    over a document's end.
    """
    seq = ids.astype(np.uint16)
    rules: list[tuple[int, int]] = []
    room = 65536 - vocabulary
    while len(seq) > 1 and len(rules) < room:
        codes = seq[:-1].astype(np.uint32) << np.uint32(16) | seq[1:]
        inner = ends[:-1] - 1
        codes[inner] = 0xFFFFFFFF
        ordered = np.sort(codes)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts, values = np.diff(np.append(first, len(ordered))), ordered[first]
        good = np.flatnonzero((counts >= LEAST) & (values != 0xFFFFFFFF))
        good = good[np.argsort(-counts[good], kind="stable")][:PER_ROUND]
        lefts, rights, slots, clashing, chosen = set(), set(), {}, [], []
        for code in values[good].tolist():
            a, b = code >> 16, code & 0xFFFF
            slot = (code * 2654435761 & 0xFFFFFFFF) >> 12
            if a in rights or b in lefts or (a == b and (a in lefts or b in rights)) or len(rules) + len(chosen) >= room:
                continue
            lefts.add(a)
            rights.add(b)
            if slots.setdefault(slot, len(chosen)) != len(chosen):
                clashing.append(len(chosen))
            chosen.append(code)
        if not chosen:
            break
        # A table by a hash of the pair, then a look whether it is that pair; the few whose slot is taken are sought one by one.
        table = np.zeros(1 << 20, np.uint16)
        table[list(slots)] = list(slots.values())
        own = np.array(chosen, np.uint32)
        which = table[(codes * np.uint32(2654435761)) >> np.uint32(12)]
        for k in clashing:
            which[codes == own[k]] = k
        at = np.flatnonzero(own[which] == codes)
        # Only a pair of equal symbols can overlap itself: of its places in a row, every other one counts.
        row = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        at = at[(np.arange(len(at)) - np.repeat(row, np.diff(np.append(row, len(at))))) % 2 == 0]
        seq[at] = vocabulary + len(rules) + which[at]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        ends = ends - np.searchsorted(at + 1, ends)
        seq = seq[keep]
        rules += [(c >> 16, c & 0xFFFF) for c in chosen]
    return seq, ends, np.array(rules, np.uint16).reshape(-1, 2)


def expansions(rules: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """All symbols' ids, joined, and the offsets into them."""
    parts: list[list[int]] = []
    for a, b in rules.tolist():
        parts.append((parts[a - vocabulary] if a >= vocabulary else [a]) + (parts[b - vocabulary] if b >= vocabulary else [b]))
    length = np.concatenate([np.ones(vocabulary, np.int64), np.array([len(p) for p in parts], np.int64)])
    flat = np.concatenate([np.arange(vocabulary), *[np.array(p) for p in parts]]).astype(np.uint16)
    return flat, np.concatenate([[0], np.cumsum(length)])


def pack(keys: np.ndarray, ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> bytes:
    """A shard: header, keys, each document's ids so far and symbols so far, rules, their lengths, symbols."""
    seq, places, rules = repair(ids, ends, vocabulary)
    offs = expansions(rules, vocabulary)[1]
    head = MAGIC + struct.pack("<IIIQ", vocabulary, len(keys), len(rules), len(seq))
    return b"".join([head, keys.astype("<i8").tobytes(), ends.astype("<u8").tobytes(), places.astype("<u8").tobytes(), rules.astype("<u2").tobytes(), np.diff(offs)[vocabulary:].astype("<u4").tobytes(), seq.astype("<u2").tobytes()])


class Shard:
    """A packed shard, read in place."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        self.vocabulary, n, r, m = struct.unpack_from("<IIIQ", data, 4)
        at = 4 + struct.calcsize("<IIIQ")
        take = lambda kind, size, at: (np.frombuffer(data, kind, size, at), at + size * np.dtype(kind).itemsize)
        self.keys, at = take("<i8", n, at)
        self.ends, at = take("<u8", n, at)
        self.places, at = take("<u8", n, at)
        self.rules, at = take("<u2", 2 * r, at)
        self.lengths, at = take("<u4", r, at)
        self.symbols, at = take("<u2", m, at)
        self.flat, self.offs = expansions(self.rules.reshape(-1, 2), self.vocabulary)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = np.diff(self.offs)[symbols]
        last = np.cumsum(size)
        return self.flat[np.arange(last[-1] if len(last) else 0) + np.repeat(self.offs[symbols] - (last - size), size)]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, without expanding any other."""
        return self.expand(self.symbols[int(self.places[k - 1]) if k else 0 : int(self.places[k])])

    def all(self) -> np.ndarray:
        step = 1 << 20
        return np.concatenate([np.empty(0, np.uint16), *[self.expand(self.symbols[i : i + step]) for i in range(0, len(self.symbols), step)]])


class WordEncoder:
    """Ids of texts, word by word: the tokenizer's pattern takes no white space into a token.

    So a text's ids are those of its pieces between spaces and line breaks, one after the other, and a
    piece that was met before isn't encoded again. Pieces are looked up by 64-bit hashes, kept sorted
    with the places of their ids, by binary search over a block's different pieces; each is then compared by its length and a
    second hash, of its own byte values. A piece that differs in them from the one kept under its hash is
    encoded on its own, whenever it comes.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.number = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.flat, self.used = np.empty(1 << 20, np.uint16), 0
        self.offs, self.known = np.zeros(1 << 18, np.int64), 0
        self.second = np.empty(0, np.uint64)
        self.size = np.empty(0, np.int32)
        self.clashing: dict[bytes, int] = {}

    def _learn(self, words: list[str]) -> None:
        while self.known + len(words) + 1 > len(self.offs):
            self.offs = np.concatenate([self.offs, np.zeros_like(self.offs)])
        for i in range(0, len(words), 128):
            some = words[i : i + 128]
            done = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(done.ids, np.uint16)
            first = np.fromiter((a for a, _ in done.offsets), np.int64, len(ids))
            at = np.searchsorted(first, np.cumsum([len(w) + 1 for w in some]), "left")
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.offs[self.known + 1 : self.known + 1 + len(some)] = self.used + at
            self.used += len(ids)
            self.known += len(some)

    def numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece; new ones are encoded."""
        if self.known > KEPT_WORDS:
            self._clear()
        # The tokenizer lower-cases; doing so here first makes fewer pieces, but might make a special token's name.
        fold = b"<|" not in raw.tobytes()
        h, second = (wordnum.word_hashes(raw, starts, ends, fold, v) for v in (wordnum.BYTE, wordnum.BYTE_2))
        size = (ends - starts).astype(np.int32)
        order = np.argsort(h)
        ordered = h[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        one = np.flatnonzero(fresh)
        different = ordered[one]
        at = np.searchsorted(self.hashes, different)
        missing = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != different) if len(self.hashes) else np.arange(len(different))
        if len(missing):
            some = order[one[missing]]
            data = (wordnum.LOWER[raw] if fold else raw).tobytes()
            base = self.known
            self._learn([data[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            self._remember(second[some], size[some])
            self.hashes = np.insert(self.hashes, at[missing], different[missing])
            self.number = np.insert(self.number, at[missing], np.arange(base, self.known, dtype=np.int32))
            at = np.searchsorted(self.hashes, different)
        out = np.empty(len(h), np.int32)
        out[order] = np.repeat(self.number[at], np.diff(np.append(one, len(h))))
        for k in np.flatnonzero((self.second[out] != second) | (self.size[out] != size)).tolist():
            piece = (wordnum.LOWER[raw[starts[k] : ends[k]]] if fold else raw[starts[k] : ends[k]]).tobytes()
            if piece not in self.clashing:
                self.clashing[piece] = self.known
                self._learn([piece.decode()])
                self._remember(second[k : k + 1], size[k : k + 1])
            out[k] = self.clashing[piece]
        return out

    def _remember(self, second: np.ndarray, size: np.ndarray) -> None:
        """Second hashes and lengths of the pieces learned last, by their numbers."""
        self.second, self.size = np.concatenate([self.second, second]), np.concatenate([self.size, size])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, joined, each with END behind it, and the ends of the texts among them."""
        raw, at = buffers(texts)
        starts, stops, offs = wordnum.words(raw, at, PIECE)
        if not len(starts):
            return np.full(len(texts), END, np.uint16), np.arange(1, len(texts) + 1)
        n = self.numbers(raw, starts, stops)
        size = (self.offs[1 : self.known + 1] - self.offs[: self.known])[n]
        last = np.cumsum(size)
        ids = self.flat[np.arange(last[-1]) + np.repeat(self.offs[n] - (last - size), size)]
        ends = np.concatenate([[0], last])[offs[1:]]
        return np.insert(ids, ends, END), ends + np.arange(1, len(ends) + 1)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


#: Ranges of the key, by its quantiles, from which the ranges of one partition are made up.
FINE = 4


def search(column: str, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below a column's value: a tree of comparisons, as deep as their number's logarithm."""

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"IF({column} <= CAST('{bounds[middle]}' AS BIGINT), {tree(low, middle)}, {tree(middle + 1, high)})"

    return F.expr(tree(0, len(bounds)))


def in_key_order(docs: DataFrame) -> DataFrame:
    """docs (key, text) dealt into shuffle partitions by ranges of the key, each sorted, rows of equal keys by their texts' hashes.

    Ranges have like numbers of bytes: those between fine quantiles of the key are weighed, and neighbours are put together. A key
    that several quantiles fall on has as many ranges of its own, by its texts' hashes, so a third of all rows without a key is not one task.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / (FINE * n) for i in range(1, FINE * n)]
    quantiles = docs.agg(F.percentile_approx("key", shares, 10 * max(FINE * n, 1000)).alias("b")).first()["b"] or [0]
    bounds = sorted(map(int, set(quantiles)))
    often = {v: c // FINE for v, c in Counter(map(int, quantiles)).items() if c >= 2 * FINE}
    place = search("key", bounds)
    heavy = F.col("key").isin(*often) if often else F.lit(False)
    weights = {r["b"]: r["w"] for r in docs.where(~heavy).groupBy(place.alias("b")).agg(F.sum(F.octet_length("text") + 8).alias("w")).collect()}
    most = max(1, sum(weights.values()) // n)
    ids, at, held = [], 0, 0
    for k in range(len(bounds) + 1):
        weight = weights.get(k, 0)
        if held and held + weight > most:
            at, held = at + 1, 0
        ids.append(at)
        held += weight
        if k < len(bounds) and bounds[k] in often:  # its own rows follow the smaller keys of their range
            at, held = at + 1 + often[bounds[k]], 0
    own = F.get(F.array(*map(F.lit, ids)), place)
    for value, count in often.items():
        share = F.least(F.floor((F.xxhash64("text") / 2.0**64 + 0.5) * count), F.lit(count - 1)).cast("int")
        own = F.when(F.col("key") == value, ids[bounds.index(value)] + 1 + share).otherwise(own)
    return docs.withColumn("shard_place", own).repartitionById(max(n, at + 1), F.col("shard_place")).sortWithinPartitions("key", F.xxhash64("text"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(place, part, n_ids, shard): every text's ids in the order of the keys, written and read again.

    Shards are written as rows of Parquet files in the shared folder; `shard` holds the binary form of
    `pack`. A null or empty text is the end id alone; a null key counts as the smallest and is stored as
    -2^63. Rows that repeat a key are all kept, in the order of their texts' hashes. An empty table gives no shard.
    """
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, keys, held, place, part = encoder(path), [], [], None, 0

        def out() -> pa.RecordBatch:
            nonlocal keys, held, part
            sizes = np.concatenate([np.diff(e, prepend=0) for _, e in held])
            ids = np.concatenate([i for i, _ in held])
            data = pack(np.concatenate(keys), ids, np.cumsum(sizes), use.vocabulary)
            keys, held, part = [], [], part + 1
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["place", "part", "n_ids", "shard"])

        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column("shard_place")[0].as_py() if place is None else place
            for block in blocks(iter([batch]), "text", 2 << 20):
                held.append(use.encode(block.column("text")))
                keys.append(block.column("key").to_numpy(zero_copy_only=False))
                count += len(held[-1][0])
                if count >= SHARD_IDS:
                    yield out()
                    count = 0
        if held:
            yield out()

    rows = in_key_order(docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("key"), text_or_empty(text).alias("text")))
    return written(rows.mapInArrow(giving_back(run), "place int, part int, n_ids bigint, shard binary"), "shards")


def read_shards(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before it), n_tokens and ids_crc32, from the shards' bytes."""
    python_ready(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, part, data in zip(batch.column("place").to_pylist(), batch.column("part").to_pylist(), batch.column("shard"), strict=True):
                shard = Shard(data.as_py())
                ids = shard.all().astype("<u4")
                ends = shard.ends.astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array([place] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(shard.keys.astype(np.int64)), pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())], ["place", "part", "key", "begin", "n_tokens", "ids_crc32"])

    rows = shards.select("place", "part", "shard").mapInArrow(giving_back(run), "place int, part int, key bigint, begin bigint, n_tokens bigint, ids_crc32 bigint")
    # One small row per shard of millions of ids.
    before = Window.orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("place", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, ["place", "part"]).select(F.col("key").alias(key), (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
