"""Whole queries on the smallest tables against plain Python: language ID, media, quotations; held-out accuracy of quality."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from corvane.llm import language_id, media, queries, quote_linking
from corvane.session import table
from tests.oracle import SF


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


def fold(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())


def rows_of(text):
    data = fold(text)
    return [((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 17 for i in range(len(data) - 2)]


def test_language_id(spark):
    langs = language_id.LANGS
    docs, pages = table(spark, SF, "documents").collect(), table(spark, SF, "pages").collect()
    counts = {x: Counter() for x in langs}
    for d in docs:
        if d.lang in langs:
            counts[d.lang].update(rows_of(d.text or ""))
    totals = {x: sum(counts[x].values()) + 0.5 * language_id.ROWS for x in langs}
    log = lambda x, r: math.log((counts[x][r] + 0.5) / totals[x])
    seen = []
    for d in docs:
        seen.append(("document", d.doc_id, d.text or "", (d.lang or "").lower() if d.lang is not None else None, None, d.source or "", d.source or "", ""))
    for p in pages:
        url, html = (p.url or "").lower(), p.html or ""
        m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url)
        host = m[1] if m else ""
        domain = re.search(r"[^.]+\.[^.]+$", host)
        said = re.search(r"""<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", html, re.I | re.S)
        path = re.match(r"[^:]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)", url)
        seen.append(("page", p.page_id, language_id.stripped(html), said[1].lower() if said else "", path[1] if path else "", host, domain[0] if domain else host, host.rsplit(".", 1)[-1]))
    lls, best = [], []
    for _, _, text, *_ in seen:
        r = rows_of(text)
        n = len(r)
        sums = [sum(log(x, i) for i in r) * min(n, language_id.FULL) / max(n, 1) for x in langs]
        lls.append([s - max(sums) for s in sums])
        best.append(langs[sums.index(max(sums))])
    tables = {}
    for kind in ("document", "page"):
        for k, c in ((3, "declared"), (4, "path")):
            n = Counter((s[k] if s[k] in langs else "", b) for s, b in zip(seen, best) if s[0] == kind)
            for x in langs:
                all_ = sum(n[v, x] + 1 for v in (*langs, ""))
                tables[kind, c, x] = {v: (n[v, x] + 1) / all_ for v in (*langs, "")}
    per = {k: defaultdict(Counter) for k in ("host", "domain", "suffix", "all")}
    for s, b in zip(seen, best):
        for k, key in (("host", s[5:8]), ("domain", s[6:8]), ("suffix", s[7]), ("all", 0)):
            per[k][key][b] += 1
    smooth = lambda count, above: {x: (count[x] + language_id.WEIGHT * above[x]) / (sum(count.values()) + language_id.WEIGHT) for x in langs}
    top = {x: (per["all"][0][x] + 1) / (len(seen) + len(langs)) for x in langs}
    got = {(r["kind"], r["doc_id"] if r["kind"] == "document" else r["page_id"]): r for r in run(spark, "op1_language_id")}
    assert len(got) == len(seen)
    for s, ll in zip(seen, lls):
        prior = smooth(per["host"][s[5:8]], smooth(per["domain"][s[6:8]], smooth(per["suffix"][s[7]], top)))
        value = []
        for k, x in enumerate(langs):
            said = [math.log(tables[s[0], c, x][v if v in langs else ""]) if v else 0.0 for c, v in (("declared", s[3]), ("path", s[4]))]
            value.append(ll[k] + sum(said) + math.log(prior[x]))
        r = got[s[0], s[1]]
        assert r["probability"] == pytest.approx(1 / sum(math.exp(v - max(value)) for v in value), abs=1e-4)
        second = sorted(value)[-2]
        assert r["lang"] == langs[value.index(max(value))] or max(value) - second < 1e-3


def adpcm(block):
    """One IMA ADPCM block, sample by sample, as the format says."""
    value, index, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            delta = (step >> 3) + (step >> 2 if code & 1 else 0) + (step >> 1 if code & 2 else 0) + (step if code & 4 else 0)
            value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_media(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    got = {r["doc_id"]: r for r in run(spark, "op7_media_columns")}
    assert got.keys() == texts.keys()
    mu, al = media.TABLES[media.MULAW].tolist(), media.TABLES[media.ALAW].tolist()
    for i, text in texts.items():
        data = text.encode()
        payload = data + b"\0" * (max(1, -(-len(data) // 64)) * 64 - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.wav(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        if i % 5:  # the decoders in plain Python are slow
            continue
        pcm = [mu[b] for b in payload]
        up = [v for k, x in enumerate(pcm) for v in (x, (x + (pcm[k + 1] if k + 1 < len(pcm) else x)) >> 1)]
        sums = sum(abs(v) for at in range(0, len(payload), 64) for v in adpcm(payload[at : at + 64]))
        turns = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        raw = b"".join(v.to_bytes(2, "little", signed=True) for v in up)
        assert r["feature"] == f"mulaw:{sum(map(abs, pcm))}|alaw:{sum(abs(al[b]) for b in payload)}|adpcm:{sums}|turns:{turns}|pcm16k:{zlib.crc32(raw)}"


def plain(text):
    return re.sub(r"\s+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)).strip(" ")


def test_quotations(spark):
    chats = table(spark, SF, "conversations").collect()
    mark = re.compile(quote_linking.MARKS.removeprefix("^"))
    own, runs = {}, {}
    for k, c in enumerate(chats):
        lines = (c.text or "").split("\n")
        found = [mark.match(x) for x in lines]
        levels = [m[1].count(">") if m else 0 for m in found]
        if not any(levels):
            own[k], runs[k] = c.text or "", []
            continue
        own[k] = "\n".join(x for x, n in zip(lines, levels) if not n).strip(" ")
        runs[k] = []
        for j, (x, m, n) in enumerate(zip(lines, found, levels)):
            if j and levels[j - 1] == n:
                runs[k][-1][1].append(x[m.end() :] if m else x)
            else:
                runs[k].append((n, [x[m.end() :] if m else x]))
        runs[k] = [(n, t) for n, t in runs[k] if n]
    here = {}
    for k, c in enumerate(chats):
        for part in {plain(x) for x in (own[k], *own[k].split("\n"))} - {""}:
            key = (part, c.conv_id)
            here[key] = min(here.get(key, c.turn), c.turn)
    convs = defaultdict(list)
    for (part, conv), turn in here.items():
        convs[part].append((conv, turn))
    convs = {p: sorted(v)[:2] for p, v in convs.items()}
    want = {}
    for k, c in enumerate(chats):
        best, places = None, set()
        for place, (n, lines) in enumerate(runs[k]):
            tried = list(dict.fromkeys([plain("\n".join(lines)), *map(plain, lines)]))
            for part, p in enumerate(tried):
                if not p:
                    continue
                turn = here.get((p, c.conv_id))
                outside = [x for x in convs.get(p, []) if x[0] != c.conv_id]
                link = (False, c.conv_id, turn) if turn is not None and turn < c.turn else (True, *outside[0]) if outside else None
                if link:
                    places.add(place)
                    best = min(best or (9e9,), (n, place, part, *link))
        want[k] = (best[4], best[5], len(places)) if best else (None, None, 0)
    got = Counter((r["conv_id"], r["turn"], r["role"], r["text"], r["source_conv"], r["source_turn"], r["n_linked"]) for r in run(spark, "op5_quote_linking"))
    assert got == Counter((c.conv_id, c.turn, c.role, own[k], *want[k]) for k, c in enumerate(chats))


def test_quality_on_held_out_rows(spark):
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = run(spark, "op4_quality_classifier")
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and label.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert good and bad
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad) > 0.8
