"""Every score of the quality query again in plain Python: words one by one, their vectors, a text's features, the network."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from corvane.llm import quality, queries, wordnum
from corvane.session import table
from tests.oracle import SF


def rows_of(text):
    """A text's words and their forms as rows of the vector table."""
    out = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        raw = np.frombuffer(w, np.uint8)
        word = int(wordnum.word_hashes(raw, np.array([0]), np.array([len(w)]))[0]) % quality.WORDS
        kind = lambda b: 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b > 127 else 3 if 48 <= b <= 57 else b
        form = ((kind(w[0]) * 257 + kind(w[-1])) * 257 + kind(w[-2] if len(w) > 1 else w[0])) * 257 + min(len(w), 23) // 4
        out.append((word, quality.WORDS + int(wordnum.mixed(np.array([form], np.uint64))[0]) % quality.FORMS))
    return out


def features(seen, vectors):
    n = len(seen)
    out = []
    for k in (0, 1):
        v = [vectors[r[k]].astype(float) for r in seen]
        mean = sum(v) / n if n else np.zeros(quality.DIM)
        spread = np.sqrt(np.maximum(sum(x * x for x in v) / n - mean * mean, 0)) if n else mean
        out += [*mean, *spread]
    words = [r[0] for r in seen]
    out += [sum(a == b for a, b in zip(words, words[d:])) / n if n else 0.0 for d in (1, 2)]
    return np.array([*out, math.log1p(n), float(n == 0)])


def test_scores_again(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.train(docs.select("doc_id", "text"), labels)
    seen = {r.doc_id: rows_of(r.text) for r in docs.collect()}
    sums, count = np.zeros((quality.ROWS, quality.DIM)), Counter()
    for rows in seen.values():
        for k in (0, 1):
            count.update(r[k] for r in rows)
            for (a, b) in zip(rows, rows[1:]):
                for own, other in ((a[k], b[k]), (b[k], a[k])):
                    sums[own, quality._PLACE[other]] += quality._SIGN[other]
    total = sum(count.values()) / 2
    for r in list(count)[:2000]:
        own = np.zeros(quality.DIM)
        own[quality._PLACE[r]] = quality._SIGN[r]
        unit = sums[r] / max(np.linalg.norm(sums[r]), 1e-9)
        assert np.abs((unit + own / 2) * 0.01 / (0.01 + count[r] / total) - model.vectors[r]).max() < 1e-5
    a, b, c, d = model.layers
    for r in queries.op4_quality_classifier(spark, SF).collect():
        z = (features(seen[r.doc_id], model.vectors) - model.mean) / model.scale
        logit = sum(math.tanh(float(z @ a[:, j]) + b[j]) * c[j] for j in range(len(c))) + float(d)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit / model.temperature)))), abs=2e-4)
