"""Secrets in texts, and who owns them: copied examples against credentials of one owner."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import fresh, giving_back, lookup, python_ready, text_or_empty, written

#: The base kinds in their order, then the kinds that the method adds.
BASE = ("assign", "access", "hex")
ADDED = ("bearer", "vendor", "pem")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_BEARER = re.compile(r"[Bb]earer\x20+([A-Za-z0-9+/_.=-]{16,})")
_VENDOR = re.compile(r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza)[A-Za-z0-9_-]{16,}")
#: Up to so many spans (about 80 MB as a hash table) are sent to every task when texts are masked; more are joined by a shuffle.
BROADCAST_SPANS = 500_000
#: A key's header; its footer, sought before any further header; and lines of a body without one: headers of the key, then base64.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_GAP = re.compile(r"(?:\s|\\r|\\n)*")
_PEM_HEADERS = re.compile(r"(?:[A-Za-z][A-Za-z0-9-]*:[ \t][^\n]*(?:\n|$))+\s*")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}(?:(?:\s|\\r|\\n)+[A-Za-z0-9+/=]{16,})*(?:(?:\s|\\r|\\n)+[A-Za-z0-9+/]{1,15}={1,2}(?![A-Za-z0-9+/=]))?")
_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)


def keys(text: str) -> list[tuple[int, int, int, str]]:
    """Private keys, each from its header to its footer, or to the end of its base64 if no footer comes before the next
    header; the secret is the body between them without white space, or the header of a key without a body."""
    out, at = [], 0
    while m := _PEM.search(text, at):
        end = _PEM_END.search(text, m.end())
        if end and end[1] == "END":
            stop, body = end.end(), text[m.end() : end.start()]
        else:
            begin = _PEM_GAP.match(text, m.end()).end()
            if head := _PEM_HEADERS.match(text, begin):
                begin = head.end()
            run = _PEM_BODY.match(text, begin)
            stop, body = (run.end(), text[m.end() : run.end()]) if run else (m.end(), "")
        out.append((m.start(), stop, 5, re.sub(r"\s|\\r|\\n", "", body) or m[0]))
        at = stop
    return out


def found(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind's place, secret) of a text, by start, then kind; offsets in code points."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), 1, m[0]) for m in _ACCESS.finditer(text)]
    out += [(*m.span(), 2, m[0]) for m in _HEX.finditer(text)]
    if "earer " in text:
        out += [(*m.span(), 3, m[1]) for m in _BEARER.finditer(text)]
    out += [(*m.span(), 4, m[0]) for m in _VENDOR.finditer(text)] if "_" in text or "-" in text or "AIza" in text else []
    if "PRIVATE KEY" in text:
        out += keys(text)
    return sorted(out, key=lambda x: (x[0], x[2]))


_FOUND = "array<struct<start:int,end:int,kind:string,hash:string>>"


def scan(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns `keep`, row, text_id and found: every candidate's span, kind and the secret's SHA-256, never itself.

    row is a number of the row's own, whatever its key; text_id is the text's SHA-256, null without candidates.
    A null or empty text has none. No shuffle.
    """
    python_ready(docs.sparkSession)
    keep = keep or ["doc_id"]
    names = BASE + ADDED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("hash", pa.string())]))
        for batch in batches:
            texts = batch.column("scanned_text").to_pylist()
            rows = [[{"start": a, "end": b, "kind": names[k], "hash": hashlib.sha256(s.encode()).hexdigest()} for a, b, k, s in found(t)] for t in texts]
            own = pa.array([hashlib.sha256(t.encode()).hexdigest() if r else None for t, r in zip(texts, rows, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], batch.column("row"), own, pa.array(rows, kind)], [*keep, "row", "text_id", "found"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.monotonically_increasing_id().alias("row"), text_or_empty(text).alias("scanned_text")).mapInArrow(giving_back(run), f"{schema}, row bigint, text_id string, found {_FOUND}")


def ownership(candidates: DataFrame, owners: int = 3, repositories: int = 5) -> DataFrame:
    """hash, n_rows, n_owners, n_repositories, copied: a secret of that many owners, or repositories, is an example.

    candidates: rows of (hash, owner, repository). Each pair is counted once before the second grouping,
    so a hash in a third of all rows is a few rows by then. A null owner or repository counts as none.
    """
    pairs = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    # Of each pair, the first row of an owner counts for it: no set of owners is gathered.
    by_owner = pairs.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("repository").alias("r"))
    return (
        by_owner.groupBy("hash")
        .agg(F.sum("n").alias("n_rows"), F.count("owner").alias("n_owners"), F.sum("r").alias("n_repositories"))
        .withColumn("copied", (F.col("n_owners") >= owners) | (F.col("n_repositories") >= repositories))
    )


def judged(docs: DataFrame, owner: Column, repository: Column, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The scan of every document (key, row, text_id, found), and its candidates with their hash's ownership: row, start, end, kind, hash, copied."""
    marked = docs.select(F.col(key).alias("key"), "text", owner.alias("secret_owner"), repository.alias("secret_repo"))
    scanned = written(scan(marked, ["key", "secret_owner", "secret_repo"]), "secrets")
    flat = scanned.where(F.size("found") > 0).select("row", F.col("secret_owner").alias("owner"), F.col("secret_repo").alias("repository"), F.inline("found"))
    known = written(ownership(flat), "owners").select("hash", "n_owners", "n_repositories", "copied", "n_rows")
    return scanned, lookup(flat.select("row", "start", "end", "kind", "hash"), known, "hash", "n_rows")


def secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, key: str = "doc_id") -> DataFrame:
    """One row per document: key, text_id (the text's SHA-256, null without spans) and spans, each with `copied`: a widely copied example.

    owner: by default the source; repository: the source and the language. Other columns may have any
    names. Every row comes back with the spans of its own text, whether its key is null or repeated; documents
    without a candidate, or with a null or empty text, have an empty list.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    scanned, spans = judged(docs, owner, repository, key)
    per = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", _order(F.col("kind")).alias("place"), "end", "kind", "hash", "copied"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,hash:string,copied:boolean>>")
    return scanned.select("key", "row", "text_id").join(per, "row", "left").select(F.col("key").alias(key), "text_id", F.coalesce("spans", empty).alias("spans"))


def _order(kind: Column) -> Column:
    out = F.lit(len(BASE + ADDED))
    for k, name in enumerate(BASE + ADDED):
        out = F.when(kind == name, k).otherwise(out)
    return out


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns of what `secrets` returns."""
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        key,
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.concat_ws(",", F.transform(base, said)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", said)).alias("spans"),
        F.size(F.filter("spans", lambda x: ~x["copied"])).cast("bigint").alias("n_live"),
        F.size(F.filter("spans", lambda x: x["copied"])).cast("bigint").alias("n_copied"),
    )


def masked(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by a mark that tells its kind and the verdict.

    found: what `secrets` returned for them. A text's spans and verdicts depend on the text and on hashes alone, so both
    meet by the text's SHA-256, never by a key: rows with null or repeated keys are masked like any other. Overlapping spans
    become one mark, of the first. Rows and other columns stay as they are; a null text stays null.
    """
    python_ready(docs.sparkSession)
    columns = docs.columns
    own, marks, many = (fresh(columns, c) for c in ("span_text", "span_marks", "span_rows"))
    only = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["copied"].alias("copied")))
    spans = found.where(F.size("spans") > 0).groupBy(F.col("text_id").alias(own)).agg(F.any_value(only).alias(marks), F.count(F.lit(1)).alias(many))
    with_id = docs.withColumn(own, F.sha2(text, 256))
    if found.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_SPANS:
        joined = with_id.join(F.broadcast(spans.drop(many)), own, "left").select(*columns, marks)
    else:  # a text may be a third of all rows
        joined = lookup(with_id, written(spans, "marks"), own, many).select(*columns, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(text).to_pylist(), batch.column(marks).to_pylist(), strict=True)
            new = pa.array([_masked(t, m) if t is not None and m else t for t, m in rows], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text else batch.column(c) for c in columns], columns)

    return joined.mapInArrow(giving_back(run), docs.schema)


def _masked(text: str, marks: list[dict]) -> str:
    out, at = [], 0
    for m in marks:
        if m["start"] >= at:
            out += [text[at : m["start"]], f"<{'EXAMPLE' if m['copied'] else 'LIVE'}_{m['kind'].upper()}>"]
        at = max(at, m["end"])
    return "".join([*out, text[at:]])
