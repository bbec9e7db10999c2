"""Byte-level BPE by a file of ranks: overlapping chunks, stitched where their pre-token boundaries meet again."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import buffers, giving_back, python_ready, shared_dir, text_or_empty, written

#: Characters of a chunk without its overlap, and of the overlap; longer texts go through the chunk table.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Characters before a chunk's end in which a boundary may still depend on what follows: a match looks at the character
#: behind it, and at most two characters behind an apostrophe.
BLIND = 4
#: Different pre-tokens that a worker keeps with their ids, and the longest kept (characters).
KEPT, LONGEST_KEPT = 300_000, 64


class Classes:
    """Pre-tokenises as the rank library does, whose letters and digits are those of its own Unicode version.

    `regex` knows other versions' characters: those on which both disagree are looked up once, from the library itself, and
    replaced in the text that is split (a letter for a letter, a digit for a digit) at their own places.
    """

    STAND_INS = {"L": "z", "N": "0", "": "#"}

    def __init__(self, pattern: str) -> None:
        import regex
        import tiktoken

        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        single = {bytes([b]): b for b in range(256)}
        own: dict[str, str] = {}
        odd: set[str] = set()
        for name in ("L", "N"):
            theirs = tiktoken.Encoding(f"class-{name}", pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={})
            there = set(bytes(theirs.encode_ordinary(every)).decode())
            odd |= there ^ set(regex.findall(rf"\p{{{name}}}", every))
            own |= dict.fromkeys(there, name)
        self.table = {ord(c): self.STAND_INS[own.get(c, "")] for c in odd}
        codes = np.array(sorted(map(ord, odd)), np.int64)
        runs = np.split(codes, np.flatnonzero(np.diff(codes) != 1) + 1) if len(codes) else []
        self.odd = re.compile("[" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs) + "]") if runs else None
        # White space is the property: `regex` counts four control characters among \s, the library doesn't.
        white = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(white).findall

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens; together they are the text."""
        if self.odd is None or text.isascii() or not self.odd.search(text):
            return self.split(text)
        sizes = [len(p) for p in self.split(text.translate(self.table))]
        ends = list(accumulate(sizes))
        return [text[e - n : e] for e, n in zip(ends, sizes, strict=True)]


class _Ids(dict):
    """The ids of a pre-token, by the rank library's merges on first sight."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode(piece))
        if len(piece) <= LONGEST_KEPT:
            self[piece] = ids
        return ids


class Ranks:
    """A rank file: pre-tokens of a text, their ids, and the bytes of ids."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.classes = Classes(pattern)
        self.known = _Ids(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece)
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.digits = {rank: str(rank) for rank in ranks.values()}

    def forget(self) -> None:
        """Drop pre-tokens: a task's end, as the worker may serve other stages next."""
        self.known.clear()

    def ids(self, pieces: list[str]) -> list[int]:
        if len(self.known) > KEPT:
            self.known.clear()
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def said(self, ids: list[int]) -> str:
        return " ".join(map(self.digits.__getitem__, ids))


_ranks: dict[tuple[str, str], Ranks] = {}


def ranks(path: str, pattern: str) -> Ranks:
    """This process's table of a rank file."""
    if (path, pattern) not in _ranks:
        _ranks[path, pattern] = Ranks(path, pattern)
    return _ranks[path, pattern]


def _texts(column: pa.Array) -> Iterator[str]:
    """Texts one by one; bytes that aren't UTF-8 become replacement characters."""
    raw, at = buffers(column)
    data = raw.tobytes()
    return (data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _chunked(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """row, key, k, start, last, body of every chunk of `chunk` characters and the `overlap` behind it. row: a number per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, key, text in zip(batch.column("row").to_pylist(), batch.column("key").to_pylist(), _texts(batch.column("text")), strict=True):
                for k, start in enumerate(range(0, max(1, len(text)), chunk)):
                    made = [[row], [key], [k], [start], [start + chunk >= len(text)], [text[start : start + chunk + overlap]]]
                    kinds = [pa.int64(), batch.column("key").type, pa.int32(), pa.int64(), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, kinds, strict=True)], ["row", "key", "k", "start", "last", "body"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(giving_back(run), f"row bigint, key {kind}, k int, start bigint, last boolean, body string")


_GROUP = "row bigint, lead int, next int, start bigint, last boolean, body string"
_SPLIT = "lengths binary, head array<bigint>, tail array<bigint>"


def _bounded(chunks: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """lengths: of each pre-token of a body, in characters, packed; head and tail: where pre-tokens end in the overlaps, in the whole text.

    chunks: key, row, lead, next, start, last, body, where a body reaches `overlap` characters into the chunk `next`. The tail
    leaves out what may still depend on characters behind the body.
    """
    kept = ["key", *[c.split()[0] for c in _GROUP.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = ranks(path, pattern)
        for batch in batches:
            lengths, heads, tails = [], [], []
            for start, following, body in zip(batch.column("start").to_pylist(), batch.column("next").to_pylist(), _texts(batch.column("body")), strict=True):
                size = np.fromiter(map(len, use.classes.pieces(body)), "<u4")
                at = np.cumsum(size, dtype=np.int64) + start
                border = following * chunk
                lengths.append(size.tobytes())
                heads.append(np.concatenate([[start], at[at <= start + overlap]]))
                tails.append(at[(at >= border) & (at <= min(border + overlap, start + len(body) - BLIND))])
            made = [pa.array(lengths, pa.binary()), *[pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], [*kept, "lengths", "head", "tail"])

    return chunks.select(kept).mapInArrow(giving_back(run), f"key {chunks.schema['key'].dataType.simpleString()}, {_GROUP}, {_SPLIT}")


def stitched(chunks: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """key, row, lead, body, start, lengths, since, until: groups of chunks whose pre-tokens in (since, until] are those of the whole text.

    Every chunk is split on its own. Where a chunk and the next one have a boundary in common within their overlap,
    the text is split alike from there on, as a match depends on nothing before it: the first such place is where one
    hands over to the other. Chunks that have none (a pre-token longer than the overlap) are joined to the
    ones before them and split again, until every join agrees; a text's start needs no agreement. Only
    joined groups are split again, and their size is that of the long pre-tokens in them. Boundaries meet in a join without
    the texts; the texts follow once all joins agree.
    """
    groups = written(_bounded(chunks, path, pattern, chunk, overlap), "pretokens")
    while True:
        sure = groups.where(~F.col("last")).select("row", F.col("next").alias("lead"), F.col("tail").alias("sure"))
        meet = F.when(F.col("lead") == 0, F.lit(0).cast("bigint")).otherwise(F.array_min(F.array_intersect("head", "sure")))
        met = written(groups.select("row", "lead", "next", "head").join(sure, ["row", "lead"], "left").select("row", "lead", "next", meet.alias("since")), "joins")
        if met.where(F.col("since").isNull()).isEmpty():
            break
        # Small rows: a few numbers per group of a text.
        before = Window.partitionBy("row").orderBy("lead")
        marks = met.withColumn("to", F.last(F.when(F.col("since").isNotNull(), F.col("lead")), ignorenulls=True).over(before))
        crowd = marks.select("row", "lead", "to", F.count(F.lit(1)).over(Window.partitionBy("row", "to")).alias("members"))
        mine = groups.join(crowd, ["row", "lead"])
        alone = mine.where("members = 1").select(groups.columns)
        part = F.struct("lead", "next", "start", "last", "body", "key")
        merged = mine.where("members > 1").groupBy("row", F.col("to").alias("lead")).agg(F.array_sort(F.collect_list(part)).alias("parts")).withColumn("end", F.element_at("parts", -1))
        # A body without its overlap, and the last one whole.
        own = lambda p: F.when(p["next"] == F.col("end.next"), p["body"]).otherwise(F.substring(p["body"], F.lit(1), ((p["next"] - p["lead"]) * chunk).cast("int")))
        whole = merged.select("end.key", "row", "lead", "end.next", F.col("parts")[0]["start"].alias("start"), "end.last", F.array_join(F.transform("parts", own), "").alias("body"))
        groups = written(alone.unionByName(_bounded(whole, path, pattern, chunk, overlap)), "pretokens")
    following = met.select("row", F.col("since").alias("until"), F.col("lead").alias("next"))
    spans = met.join(following, ["row", "next"], "left").select("row", "lead", "since", "until")
    return groups.select("key", "row", "lead", "body", "start", "lengths").join(spans, ["row", "lead"])


def _pieces(body: str, start: int, lengths: bytes, since: int, until: int | None) -> list[str]:
    """The pre-tokens of a body between two places of the text that are boundaries in it; without `until`, to its end."""
    at = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64)])
    at = at[(at >= since - start) & (at <= (len(body) if until is None else until - start))].tolist()
    return [body[a:b] for a, b in zip(at, at[1:])]


def _encoded(pieces: DataFrame, path: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = ranks(path, pattern)
        for batch in batches:
            rows = zip(_texts(batch.column("body")), *(batch.column(c).to_pylist() for c in ("start", "lengths", "since", "until")), strict=True)
            ids = [use.ids(_pieces(*r)) for r in rows]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "lead", "key")], pa.array(ids, pa.list_(pa.int32()))], ["row", "lead", "key", "ids"])
        use.forget()

    return pieces.mapInArrow(giving_back(run), f"row bigint, lead int, key {pieces.schema['key'].dataType.simpleString()}, ids array<int>")


def _long(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """row, lead, key, ids of every group of chunks."""
    if not 0 < overlap < chunk:
        raise ValueError("an overlap is shorter than a chunk")
    # Chunks of one long text go to all tasks.
    chunks = _chunked(texts, chunk, overlap).repartition("row", "k")
    named = chunks.select("key", "row", F.col("k").alias("lead"), (F.col("k") + 1).alias("next"), "start", "last", "body")
    return _encoded(stitched(named, path, pattern, chunk, overlap), path, pattern)


def _parted(docs: DataFrame, key: str, text: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    python_ready(docs.sparkSession)
    shared_dir(docs.sparkSession)
    texts = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    long = F.char_length("text") > chunk
    return texts.where(~long), texts.where(long)


def _whole(texts: DataFrame, path: str, pattern: str, cols: str, made) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = ranks(path, pattern)
        for batch in batches:
            arrays = made(use, [use.ids(use.classes.pieces(t)) for t in _texts(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays.values()], ["key", *arrays])
        use.forget()

    return texts.mapInArrow(giving_back(run), f"key {texts.schema['key'].dataType.simpleString()}, {cols}")


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, token_ids (array of int) and decoded (the ids' bytes, binary) of every row, whatever its key.

    Ids are those that the rank library gives each match of the pattern, special tokens' strings being
    ordinary text. A null or empty text has none. Texts up to `chunk` characters are one chunk and are encoded where
    they lie, without a shuffle. Longer ones are cut into chunks that overlap, which are split in parallel,
    stitched (see `stitched`) and encoded in parallel; a text's ids are put together by its own number, so repeated and null
    keys stay apart. The pattern must not look behind a match's start, and at most BLIND - 1 characters ahead of its end.
    """
    short, long = _parted(docs, key, text, chunk)

    def made(use: Ranks, ids: list[list[int]]) -> dict[str, pa.Array]:
        return {"token_ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([use.decode(x) for x in ids], pa.binary())}

    joined = _long(long, path, pattern, chunk, overlap).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("lead", "ids", "key"))).alias("parts"))
    ids = joined.select(F.col("parts")[0]["key"].alias("key"), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("token_ids"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = ranks(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([use.decode(x) for x in batch.column("token_ids").to_pylist()], pa.binary())], ["key", "token_ids", "decoded"])

    cols = "token_ids array<int>, decoded binary"
    rest = ids.mapInArrow(giving_back(back), f"key {ids.schema['key'].dataType.simpleString()}, {cols}")
    return _whole(short, path, pattern, cols, made).unionByName(rest).withColumnRenamed("key", key)


def encode_digest(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """As `encode`, with n_tokens and the SHA-256 of ids (joined by a space) and decoded bytes in place of both.

    A long text's groups reach one task in their order and are hashed as they come: it never holds all ids.
    """
    short, long = _parted(docs, key, text, chunk)
    cols = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def columns(rows: list[tuple[int, str, str]]) -> dict[str, pa.Array]:
        counts, shas, texts = zip(*rows, strict=True) if rows else ((), (), ())
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(texts, pa.string())}

    def made(use: Ranks, ids: list[list[int]]) -> dict[str, pa.Array]:
        return columns([(len(x), hashlib.sha256(use.said(x).encode()).hexdigest(), hashlib.sha256(use.decode(x)).hexdigest()) for x in ids])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, row, own, n, said, texts = ranks(path, pattern), None, None, 0, None, None

        def ended(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), *columns([x[1:] for x in done]).values()], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            kind, done = batch.column("key").type, []
            for r, key_, ids in zip(*(batch.column(c).to_pylist() for c in ("row", "key", "ids")), strict=True):
                if r != row:
                    if row is not None:
                        done.append((own, n, said.hexdigest(), texts.hexdigest()))
                    row, own, n, said, texts = r, key_, 0, hashlib.sha256(), hashlib.sha256()
                if ids:
                    said.update(((" " if n else "") + use.said(ids)).encode())
                    texts.update(use.decode(ids))
                    n += len(ids)
            yield ended(done)
        if row is not None:
            yield ended([(own, n, said.hexdigest(), texts.hexdigest())])

    ordered = _long(long, path, pattern, chunk, overlap).repartition("row").sortWithinPartitions("row", "lead")
    rest = ordered.mapInArrow(giving_back(hashed), f"key {long.schema['key'].dataType.simpleString()}, {cols}")
    return _whole(short, path, pattern, cols, made).unionByName(rest).withColumnRenamed("key", key)
