"""Language ID: text likelihoods fused with declared language, address and host priors by Bayes' rule."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import wordnum
from corvane.llm.common import blocks, buffers, giving_back, lookup, python_ready, written

LANGS = ("de", "en", "es", "fr")
#: Rows of hashed three-byte pieces; pieces of a text that count in full, beyond which evidence grows no more.
ROWS, FULL = 1 << 15, 60.0
#: Rows' worth of the level above in a host's, a domain's and a suffix's prior; what a table's cell starts from.
WEIGHT, START = 8.0, 1.0
#: Where a tag, a comment or an entity may begin, by its kind; and what ends each kind that reaches over a tag.
_OPENS = re.compile(r"<(?:(?P<raw>script|style)\b|(?P<comment>!--))?|&\w{1,8};", re.I)
_ENTITY = re.compile(r"&\w{1,8};")
_ENDS = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "comment": re.compile("-->"), "tag": re.compile(">")}
#: The language that <html ...> declares: an attribute of that very name.
_HTML, _LANG = re.compile(r"<html(?=[\s/>])", re.I), re.compile(r"""[\s"'/]lang\s*=\s*["']?([a-z]{2,3})""", re.I)


def stripped(html: str) -> str:
    """The visible text of a page, roughly: tags, scripts, styles, comments and entities are a space each; what isn't closed stays.

    Each kind of end is sought from a place only if one may still follow: once there is none behind a place, it isn't sought again.
    So a page takes time in proportion to its length, however broken.
    """
    out, at, none = [], 0, set()

    def end(kind: str, start: int) -> int:
        if kind in none:
            return -1
        found = _ENDS[kind].search(html, start)
        if found is None:
            none.add(kind)
            return -1
        return found.end()

    search = _OPENS.search
    m = search(html)
    while m:
        stop = -1
        if m[0][0] == "&":
            stop = m.end()
        elif m.lastgroup == "raw":
            stop = end(m["raw"].lower(), m.end())
        elif m.lastgroup == "comment":
            stop = end("comment", m.end())
        if stop < 0:
            stop = end("tag", m.start() + 1)
        if stop < 0:  # without a ">" nothing but entities ends any more
            return "".join([*out, _ENTITY.sub(" ", html[at:])])
        out += [html[at : m.start()], " "]
        at = stop
        m = search(html, at)
    return "".join([*out, html[at:]])


def declared(html: str) -> str:
    """The language in the first html tag that names one, lower-case; else empty."""
    at = 0
    while m := _HTML.search(html, at):
        close = html.find(">", m.end())
        at = close if close >= 0 else len(html)
        if found := _LANG.search(html, m.end(), at):
            return found[1].lower()
    return ""


def pieces(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the three-byte pieces of a block's texts, A-Z as a-z, and the n + 1 offsets; none reaches over a text's end."""
    low = wordnum.LOWER[raw].astype(np.uint32)
    if len(low) < 3:
        return np.empty(0, np.int64), np.zeros(len(at), np.int64)
    code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
    rows = (code * np.uint32(2654435761)) >> np.uint32(17)
    ok = np.ones(len(rows), bool)
    for k in (1, 2):
        edge = at[1:-1] - k
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    counted = np.concatenate([[0], np.cumsum(ok)])
    return rows[ok].astype(np.int64), counted[np.minimum(at, len(ok))]


def trained(docs: DataFrame, text: str, lang: str) -> np.ndarray:
    """Log probabilities of pieces by language, a row per language, from every labelled text. Its size is fixed."""
    places = {x: k for k, x in enumerate(LANGS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(LANGS) * ROWS, np.int64)
        for block in blocks(batches, "text"):
            rows, offs = pieces(*buffers(block.column("text")))
            own = np.array([places[x] for x in block.column("lang").to_pylist()], np.int64)
            sums += np.bincount(np.repeat(own, np.diff(offs)) * ROWS + rows, minlength=len(sums))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["cell", "n"])

    known = docs.where(F.col(lang).isin(*LANGS)).select(F.coalesce(text, F.lit("")).alias("text"), F.col(lang).alias("lang"))
    total = known.mapInArrow(giving_back(run), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.full(len(LANGS) * ROWS, 0.5)
    table[total["cell"]] += total["n"]
    table = table.reshape(len(LANGS), ROWS)
    return np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def likelihoods(rows: DataFrame, table: np.ndarray, keep: list[str], html: bool) -> DataFrame:
    """keep and ll_<lang>: each text's mean log likelihood of a piece, times its pieces up to FULL; 0 without pieces.

    With html the text is a page: its visible text counts, and `declared` becomes the language that it declares.
    """
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            column = block.column("text")
            own = {c: block.column(c) for c in keep}
            if html:
                texts = column.to_pylist()
                own["declared"] = pa.array([declared(t) for t in texts], pa.string())
                column = pa.array([stripped(t) for t in texts], pa.string())
            got, offs = pieces(*buffers(column))
            n = np.diff(offs)
            sums = np.zeros((len(n), len(LANGS)))
            full = np.flatnonzero(n)
            if len(full):
                sums[full] = np.add.reduceat(shared.value[got], offs[:-1][full], dtype=np.float64)
            sums *= (np.minimum(n, FULL) / np.maximum(n, 1))[:, None]
            sums -= sums.max(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*own.values(), *[pa.array(np.ascontiguousarray(sums[:, k])) for k in range(len(LANGS))]], [*keep, *[f"ll_{x}" for x in LANGS]])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "text").mapInArrow(giving_back(run), ", ".join([kept, *[f"ll_{x} double" for x in LANGS]]))


def _best(cols: list[Column]) -> Column:
    """The language of the largest value; ties to the first."""
    top = F.greatest(*cols)
    return F.coalesce(*[F.when(c == top, F.lit(x)) for c, x in zip(cols, LANGS, strict=True)])


def _table(rows: DataFrame, column: str, values: tuple[str, ...]) -> dict[str, dict[str, float]]:
    """P(column = value | language) from the texts' own best languages; a fixed number of values, others are one."""
    got = rows.groupBy(F.when(F.col(column).isin(*values), F.col(column)).otherwise("").alias("v"), "text_lang").agg(F.count(F.lit(1)).alias("n")).collect()
    count = {(r["v"], r["text_lang"]): r["n"] for r in got}
    out = {}
    for x in LANGS:
        total = sum(count.get((v, x), 0) + START for v in (*values, ""))
        out[x] = {v: (count.get((v, x), 0) + START) / total for v in (*values, "")}
    return out


def _evidence(column: str, table: dict[str, dict[str, float]], lang: str) -> Column:
    """log P(column | lang); an absent declaration says nothing."""
    out = F.lit(float(np.log(table[lang][""])))
    for v, p in table[lang].items():
        if v:
            out = F.when(F.col(column) == v, F.lit(float(np.log(p)))).otherwise(out)
    return F.when(F.col(column).isNull() | (F.col(column) == ""), F.lit(0.0)).otherwise(out)


def host_priors(rows: DataFrame) -> DataFrame:
    """host, n_host, prior_<lang>: host counts smoothed by the domain's, those by the suffix's, those by all rows'.

    rows: (host, domain, suffix, text_lang). Each level is one grouped aggregation of the level below,
    so it has a row per host at most; a host that holds a third of all rows is one row by then.
    """
    counts = [F.sum((F.col("text_lang") == x).cast("bigint")).alias(f"c_{x}") for x in LANGS]
    up = lambda df, *keys: df.groupBy(*keys).agg(*[F.sum(f"c_{x}").alias(f"c_{x}") for x in LANGS])
    host = written(rows.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("n_host"), *counts), "hosts")
    total = up(host).first()
    n = sum(total[f"c_{x}"] or 0 for x in LANGS)
    level = {x: F.lit(((total[f"c_{x}"] or 0) + START) / (n + START * len(LANGS))) for x in LANGS}
    size = lambda: sum((F.col(f"c_{x}") for x in LANGS[1:]), F.col(f"c_{LANGS[0]}"))
    smooth = lambda df, above, name: df.select(*[c for c in df.columns if c[:2] not in ("c_", "a_")], *[((F.col(f"c_{x}") + WEIGHT * above[x]) / (size() + WEIGHT)).alias(f"{name}{x}") for x in LANGS])
    above = {x: F.col(f"a_{x}") for x in LANGS}
    # A suffix may have most of all domains, a domain most of all hosts: both are looked up with hot keys apart.
    host = host.withColumn("place", F.concat_ws("\n", "suffix", "domain"))
    domain = host.groupBy("suffix", "place").agg(F.count(F.lit(1)).alias("n_hosts"), *[F.sum(f"c_{x}").alias(f"c_{x}") for x in LANGS])
    suffix = domain.groupBy("suffix").agg(F.count(F.lit(1)).alias("n_domains"), *[F.sum(f"c_{x}").alias(f"c_{x}") for x in LANGS])
    suffix = written(smooth(suffix, level, "a_"), "suffixes", 1)
    domain = written(smooth(lookup(domain, suffix, "suffix", "n_domains"), above, "b_").drop("suffix"), "domains", 1)
    domain = domain.withColumnsRenamed({f"b_{x}": f"a_{x}" for x in LANGS})
    return smooth(lookup(host, domain, "place", "n_hosts"), above, "prior_").drop("domain", "suffix", "place")


def identified(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, doc_id, page_id, lang, probability, text_lang and declared of every document and page.

    docs: (doc_id, text, lang, source): the declared language is lang, the host is the source, which is
    its own domain and has no suffix. For documents lang is so both the label that the text model learns
    and the declaration: a document's text and its declaration are no independent evidence. pages: (page_id, url, html): the declared language is html's lang
    attribute, the address's suffix is the host's last part and its path may name a language. The text
    model is learned from all documents of the languages LANGS. A null or empty text has the evidence
    of the rest only; a page without host shares one host "". Ties go to the first of LANGS. Every row
    comes back, repeated ones and those without a key too; other columns aren't read, so names can't clash.
    """
    spark = docs.sparkSession
    python_ready(spark)
    table = trained(docs, "text", "lang")
    known = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("page_id"), F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("path_lang"), F.coalesce("source", F.lit("")).alias("host"), F.coalesce("source", F.lit("")).alias("domain"), F.lit("").alias("suffix"), F.coalesce("text", F.lit("")).alias("text"))
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    web = pages.select(F.lit("page").alias("kind"), F.lit(None).cast("bigint").alias("doc_id"), F.col("page_id").cast("bigint").alias("page_id"), F.lit("").alias("declared"), F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[^:]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1).alias("path_lang"), host.alias("host"), F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host).alias("domain"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"), F.coalesce("html", F.lit("")).alias("text"))
    keep = ["kind", "doc_id", "page_id", "declared", "path_lang", "host", "domain", "suffix"]
    seen = likelihoods(known, table, keep, False).unionByName(likelihoods(web, table, keep, True))
    lls = [F.col(f"ll_{x}") for x in LANGS]
    seen = written(seen.withColumn("text_lang", _best(lls)), "likelihoods")
    tables = {c: {kind: _table(seen.where(F.col("kind") == kind), c, LANGS) for kind in ("document", "page")} for c in ("declared", "path_lang")}
    priors = written(host_priors(seen.where("host IS NOT NULL")), "priors")
    joined = lookup(seen, priors, "host", "n_host")
    logs = []
    for x in LANGS:
        said = [F.when(F.col("kind") == "page", _evidence(c, tables[c]["page"], x)).otherwise(_evidence(c, tables[c]["document"], x)) for c in ("declared", "path_lang")]
        logs.append((F.col(f"ll_{x}") + said[0] + said[1] + F.log(F.col(f"prior_{x}"))).alias(f"log_{x}"))
    out = joined.select("kind", "doc_id", "page_id", "declared", "text_lang", *logs)
    cols = [F.col(f"log_{x}") for x in LANGS]
    top = F.greatest(*cols)
    total = sum((F.exp(c - top) for c in cols[1:]), F.exp(cols[0] - top))
    return out.select("kind", "doc_id", "page_id", _best(cols).alias("lang"), (1 / total).alias("probability"), "text_lang", "declared")
