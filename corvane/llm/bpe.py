"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import wordnum
from corvane.llm.common import blocks, buffers, giving_back, lookup, python_ready, text_or_empty, written
from corvane.llm.pieces import Pieces

#: A cut follows where the hash of the WINDOW bytes before it has MASK's bits clear; LONGEST bytes without one are cut too.
WINDOW, MASK, LONGEST = 24, (1 << 9) - 1, 1 << 13
#: Bytes of chunks and ids that a worker keeps for reuse.
KEPT_BYTES = 16 << 20
#: Different words behind a space that it keeps with their ids.
KEPT_WORDS = 100_000


def safe_places(raw: np.ndarray) -> np.ndarray:
    """Places before a space or line break that follows a visible ASCII character.

    The pre-tokenizer's pattern looks at no text before a token's start, and no token goes from a
    visible character on to white space, so a cut there never changes an id.
    """
    before, after = raw[:-1], raw[1:]
    return np.flatnonzero(((after == 0x20) | (after == 0x0A)) & (before > 0x20) & (before < 0x7F)) + 1


def cuts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends of a block's texts by a rolling hash of its bytes, and whether each is a safe place.

    A cut moves on to the next safe place, if there is one before the next cut; else it stays, at a character's start.
    """
    n = len(raw)
    if n <= WINDOW:
        return at[1:], np.ones(len(at) - 1, bool)
    power, inverse = wordnum._tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(wordnum.BYTE[raw] * power[:n], out=sums[1:])
    rolling = (sums[WINDOW:] - sums[:-WINDOW]) * inverse[: n + 1 - WINDOW]
    spots = np.flatnonzero((rolling >> np.uint64(40) & np.uint64(MASK)) == 0) + WINDOW
    spots = spots[np.searchsorted(at, spots, "right") == np.searchsorted(at, spots - WINDOW, "right")]  # the window lies in one text
    edges = np.unique(np.concatenate([at, spots]))
    gaps = np.diff(edges)
    if len(gaps) and gaps.max() > LONGEST:
        long = np.flatnonzero(gaps > LONGEST)
        edges = np.unique(np.concatenate([edges, *[np.arange(edges[i], edges[i + 1], LONGEST) for i in long.tolist()]]))
    inner = edges[~np.isin(edges, at)]
    safe = safe_places(raw)
    k = np.searchsorted(safe, inner)
    there = np.where(k < len(safe), safe[np.minimum(k, max(len(safe) - 1, 0))], n) if len(safe) else np.full(len(inner), n)
    following = edges[np.minimum(np.searchsorted(edges, inner, "right"), len(edges) - 1)]
    ok = there < following
    moved = np.where(ok, there, inner)
    for _ in range(3):  # not inside a character
        moved = moved + (~ok & (raw[np.minimum(moved, n - 1)] >> 6 == 2))
    ends = np.concatenate([moved, at[1:]])
    kind = np.concatenate([ok, np.ones(len(at) - 1, bool)])
    order = np.argsort(ends, kind="stable")
    return ends[order], kind[order]


class Codec:
    """A tokenizer file, the text of its ids, and the chunks encoded so far."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spaced = Pieces(self.tokenizer, " ", KEPT_WORDS)
        self.new = self.reused = 0
        self.forget()
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.digits = [str(i) for i in range(n)]
        self.bytes = self._bytes(n)

    def forget(self) -> None:
        """Drop chunks and words: a task's end, as the worker may serve other stages next."""
        self.spaced.clear()
        self.kept: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.size = 0

    def _bytes(self, n: int) -> list[bytes]:
        """The bytes of each id, by the byte-level alphabet's rule: visible Latin-1 as is, the rest from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        out = []
        for i in range(n):
            token = self.tokenizer.id_to_token(i) or ""
            out.append(bytes(back[c] for c in token) if all(c in back for c in token) else token.encode())
        return out

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, by the tokenizer at once."""
        done = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in done]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, word by word where that can't change them, from words met before.

        A token begins with a space or has none, so a text may be cut before every space behind which
        stands no white space. Texts with others are encoded as a whole.
        """
        split = [t.decode().split(" ") for t in texts]
        starts = [w[0] for w in split]
        rest = self.spaced.numbers([w[1:] for w in split])
        many = np.concatenate([np.empty(0, np.int32), *rest])
        ids, last = self.spaced.ids(many)
        ends = np.concatenate([[0], last])[np.cumsum([0, *[len(r) for r in rest]])].tolist()
        out: list[np.ndarray | None] = []
        odd = np.zeros(self.spaced.known, bool)
        odd[list(self.spaced.odd)] = True
        bad = np.concatenate([[0], np.cumsum(odd[many])])[np.cumsum([0, *[len(r) for r in rest]])].tolist()
        own = {w: k for k, w in enumerate(dict.fromkeys(w for w in starts if w))}
        head = self.first(list(own))
        for k, w in enumerate(starts):
            if bad[k + 1] > bad[k]:
                out.append(None)
            elif w:
                out.append(np.concatenate([head[own[w]], ids[ends[k] : ends[k + 1]]]).astype(np.uint32))
            else:
                out.append(ids[ends[k] : ends[k + 1]].astype(np.uint32))
        left = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(left, self.whole([texts[k] for k in left]), strict=True):
            out[k] = x
        return out

    def first(self, words: list[str]) -> list[np.ndarray]:
        """The ids of words that start a text: each on its own, without a space before it."""
        done = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, np.uint16) for e in done]

    def chunks(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of each chunk: one that was met before isn't encoded again."""
        have: dict[bytes, np.ndarray] = {}
        missing: list[bytes] = []
        for p in parts:
            if p in have:
                continue
            ids = self.kept.get(p)
            if ids is None:
                missing.append(p)
                have[p] = np.empty(0, np.uint32)
            else:
                self.kept.move_to_end(p)
                have[p] = ids
        for p, ids in zip(missing, self.encode(missing), strict=True):
            have[p] = self.kept[p] = ids
            self.size += len(p) + ids.nbytes + 300
        while self.size > KEPT_BYTES:
            p, ids = self.kept.popitem(last=False)
            self.size -= len(p) + ids.nbytes + 300
        self.new += len(missing)
        self.reused += len(parts) - len(missing)
        return [have[p] for p in parts]

    def mended(self, text: bytes, ends: list[int], safe: list[bool], ids: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of a text with unsafe joins: around each, from a safe place before it to one behind it, encoded anew.

        What the new piece replaces must be the end of the left chunk's ids and the start of the right
        one's; where it isn't, the piece grows to the next safe places, to the whole text at most.
        """
        places = [0, *safe_places(np.frombuffer(text, np.uint8)).tolist(), len(text)]
        grid = np.array(places)
        begins = [0, *ends[:-1]]
        wide = 1
        while True:
            regions: list[list[int]] = []
            for c, ok in zip(ends[:-1], safe[:-1], strict=True):
                if ok:
                    continue
                p = places[max(0, int(np.searchsorted(grid, c, "right")) - wide)]
                q = places[min(len(places) - 1, int(np.searchsorted(grid, c, "left")) + wide - 1)]
                if regions and p <= regions[-1][1]:
                    regions[-1][1] = max(q, regions[-1][1])
                else:
                    regions.append([p, q])
            out, agree, at = [], True, 0
            spans = [x for r in regions for x in ((at, r[0], False), (r[0], r[1], True)) if not (at := r[1] if x[2] else at) < 0]
            spans.append((at, len(text), False))
            for a, b, anew in spans:
                if a >= b:
                    continue
                if anew:
                    out.append(self.encode([text[a:b]])[0])
                    continue
                for s, e, own in zip(begins, ends, ids, strict=True):
                    lo, hi = max(s, a), min(e, b)
                    if lo >= hi:
                        continue
                    if s < lo:
                        gone = self.encode([text[s:lo]])[0]
                        agree &= len(gone) <= len(own) and bool((own[: len(gone)] == gone).all())
                        own = own[len(gone) :]
                    if hi < e:
                        gone = self.encode([text[hi:e]])[0]
                        agree &= len(gone) <= len(own) and bool((own[len(own) - len(gone) :] == gone).all())
                        own = own[: len(own) - len(gone)]
                    out.append(own)
            if agree:
                return out
            wide *= 2
            if wide > 2 * len(places):
                return self.encode([text])

    def block(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column."""
        raw, at = buffers(column)
        ends, safe = cuts(raw, at)
        data = raw.tobytes()
        begins = np.concatenate([[0], ends[:-1]])
        ids = self.chunks([data[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
        # A text's chunks are those that end after its start, up to its end; an empty text's is empty.
        first = np.searchsorted(ends, at[:-1], "right").tolist()
        last = np.searchsorted(ends, at[1:], "right").tolist()
        bad = np.concatenate([[0], np.cumsum(~safe)])
        out = []
        for k, (i, j) in enumerate(zip(first, last, strict=True)):
            a, b = int(at[k]), int(at[k + 1])
            if a == b:
                out.append(np.empty(0, np.uint32))
            elif bad[j] > bad[i]:
                out.append(np.concatenate(self.mended(data[a:b], (ends[i:j] - a).tolist(), safe[i:j].tolist(), ids[i:j])))
            else:
                out.append(ids[i] if j == i + 1 else np.concatenate(ids[i:j]))
        return out

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This process's codec of a file; it lives as long as the worker, its chunks and words as long as a task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _mapped(docs: DataFrame, key: str, text: str, path: str, cols: str, made) -> DataFrame:
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for block in blocks(batches, "text"):
            arrays = made(use, use.block(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("key"), *arrays.values()], ["key", *arrays])
        use.forget()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), text_or_empty(text).alias("text")).mapInArrow(giving_back(run), f"key {kind}, {cols}").withColumnRenamed("key", key)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, token_ids (array of int) and decoded (the ids' text) of every row.

    Ids are those of the tokenizers library for the whole text. A null or empty text has no ids. Texts
    are cut into chunks by a rolling hash of their own bytes, so that a passage is cut alike wherever it
    stands; a task encodes a chunk once and reuses it for every document that it meets (KEPT_BYTES of chunks are kept,
    the least recently used go). Cuts lie at places that can't change an id; where a long run has none,
    the join is mended by encoding its surroundings anew. No shuffle.
    """

    def made(use: Codec, ids: list[np.ndarray]) -> dict[str, pa.Array]:
        flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32))
        offs = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
        return {"token_ids": pa.ListArray.from_arrays(offs, flat), "decoded": pa.array([use.decode(x.tolist()).decode("utf-8", "replace") for x in ids], pa.string())}

    return _mapped(docs, key, text, path, "token_ids array<int>, decoded string", made)


def encode_digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As `encode`, with n_tokens and the SHA-256 of ids and decoded text in place of both: nothing long leaves the worker."""

    def made(use: Codec, ids: list[np.ndarray]) -> dict[str, pa.Array]:
        shas, texts = [], []
        for x in ids:
            values, digits = x.tolist(), use.digits
            shas.append(hashlib.sha256(",".join([digits[i] for i in values]).encode()).hexdigest())
            texts.append(hashlib.sha256(use.decode(values).decode("utf-8", "replace").encode()).hexdigest())
        return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(texts, pa.string())}

    return _mapped(docs, key, text, path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", made)


def _cut(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row, key, k, safe and chunk of every content-defined chunk; a text without any has one empty chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            raw, at = buffers(block.column("text"))
            ends, safe = cuts(raw, at)
            data = raw.tobytes()
            first = np.searchsorted(ends, at[:-1], "right")
            last = np.maximum(np.searchsorted(ends, at[1:], "right"), first)
            empty = at[1:] == at[:-1]
            size = np.where(empty, 1, last - first)
            own = np.repeat(np.arange(len(size)), size)
            k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            place = np.minimum(first[own] + k, max(len(ends) - 1, 0))
            starts = np.concatenate([[0], ends])[place] if len(ends) else np.zeros(len(own), np.int64)
            stops = ends[place] if len(ends) else starts
            parts = [b"" if e else data[a:b] for a, b, e in zip(starts.tolist(), stops.tolist(), empty[own].tolist(), strict=True)]
            ok = np.where(empty[own] | (k == size[own] - 1), True, safe[place] if len(safe) else True)
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays([block.column("row").take(take), block.column("key").take(take), pa.array(k.astype(np.int32)), pa.array(ok), pa.array(parts, pa.binary())], ["row", "key", "k", "safe", "chunk"])

    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(giving_back(run), f"row bigint, key {docs.schema[key].dataType.simpleString()}, k int, safe boolean, chunk binary")


def encode_shared(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and token_ids of every row, where a chunk is encoded once over all documents.

    Chunks go to a table of different ones by their SHA-256, which is encoded and looked up again by every place that has
    the chunk (one that stands in a third of all places is no hot key: see `lookup`). A text's ids come
    together by its row's own number; texts with a join that isn't safe bring their chunks along, and the join is mended
    as in `encode`. The same ids as `encode`, for more shuffle: it pays where documents repeat each other far more than they differ.
    """
    python_ready(docs.sparkSession)
    parts = written(_cut(docs, key, text).withColumn("digest", F.sha2("chunk", 256)), "chunks")

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for block in blocks(batches, "chunk"):
            ids = use.encode([bytes(c) for c in block.column("chunk").to_pylist()])
            yield pa.RecordBatch.from_arrays([block.column("digest"), block.column("n"), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["digest", "n", "ids"])
        use.forget()

    distinct = parts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.any_value("chunk").alias("chunk"))
    table = written(distinct.select("digest", "n", "chunk").mapInArrow(giving_back(learnt), "digest string, n bigint, ids binary"), "chunk-ids")
    odd = parts.where(~F.col("safe")).select("row").distinct().withColumn("odd", F.lit(True))
    placed = parts.select("row", "key", "k", "safe", "digest", "chunk").join(odd, "row", "left").withColumn("chunk", F.when(F.col("odd"), F.col("chunk"))).drop("odd")
    whole = lookup(placed, table, "digest", "n").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "safe", "chunk", "ids", "key"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for batch in batches:
            out = []
            for p in batch.column("parts").to_pylist():
                ids = [np.frombuffer(x["ids"], "<u4") for x in p]
                if not all(x["safe"] for x in p):
                    pieces = [x["chunk"] for x in p]
                    ids = use.mended(b"".join(pieces), np.cumsum([len(c) for c in pieces]).tolist(), [x["safe"] for x in p], ids)
                out.append(np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.int32()))], ["key", "token_ids"])
        use.forget()

    kind = docs.schema[key].dataType.simpleString()
    return whole.select(F.col("parts")[0]["key"].alias("key"), "parts").mapInArrow(giving_back(joined), f"key {kind}, token_ids array<int>").withColumnRenamed("key", key)
