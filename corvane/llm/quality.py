"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import wordnum
from corvane.llm.common import blocks, buffers, giving_back, python_ready, text_or_empty

#: Size of a vector, places of an index vector that aren't 0, rows for hashed words, rows for word forms.
DIM, PLACES, WORDS, FORMS = 32, 4, 1 << 14, 1 << 12
ROWS = WORDS + FORMS
#: Features of a text: means and deviations of two vectors, two shares of repetition, its length, and whether it is empty.
FEATURES = 4 * DIM + 4
#: At most so many labelled rows are learned from (those of the smallest hashes), 20 % of them for the temperature.
MOST_LABELLED = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 48, 40, 256, 3e-3, 1e-4

_rng = np.random.Generator(np.random.PCG64(11))
#: A random index vector for each row, as its places and signs.
_PLACE = np.stack([_rng.permutation(DIM)[:PLACES] for _ in range(ROWS)]).astype(np.int64)
_SIGN = _rng.choice([-1.0, 1.0], (ROWS, PLACES))
#: A byte's class: letters by case, digits, letters beyond ASCII; each other sign is its own class.
_CLASS = np.arange(256, dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' rows, their forms' rows, and the n + 1 offsets of the texts among them."""
    starts, ends, offs = wordnum.words(raw, at, wordnum.SPACED)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), offs
    words = (wordnum.word_hashes(raw, starts, ends) & np.uint64(WORDS - 1)).astype(np.int64)
    size = ends - starts
    form = ((_CLASS[raw[starts]] * 257 + _CLASS[raw[ends - 1]]) * 257 + _CLASS[raw[np.maximum(starts, ends - 2)]]) * 257 + np.minimum(size, 23) // 4
    return words, WORDS + (wordnum.mixed(form.astype(np.uint64)) & np.uint64(FORMS - 1)).astype(np.int64), offs


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The context vectors of all rows and how often each occurs, over every word of every text.

    A word's vector is the sum of the index vectors of the words beside it; a form's, of the forms
    beside it. Each task adds up its own texts; the partial sums, whole numbers, are added by Spark, so
    the result doesn't depend on the partitions. It has ROWS rows at any size of the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros(ROWS * DIM), np.zeros(ROWS, np.int64)
        for block in blocks(batches, "text"):
            words, forms, offs = tokens(*buffers(block.column("text")))
            beside = np.ones(max(len(words) - 1, 0), bool)
            inner = offs[1:-1] - 1
            beside[inner[(inner >= 0) & (inner < len(beside))]] = False
            for rows in (words, forms):
                count += np.bincount(rows, minlength=ROWS)
                a, b = rows[:-1][beside], rows[1:][beside]
                for own, other in ((a, b), (b, a)):
                    for k in range(PLACES):
                        sums += np.bincount(own * DIM + _PLACE[other, k], _SIGN[other, k], ROWS * DIM)
        used = np.flatnonzero(count)
        if len(used):
            table = sums.reshape(ROWS, DIM)[used].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *[pa.array(table[:, d]) for d in range(DIM)]], ["row", "n", *[f"d{d}" for d in range(DIM)]])

    cols = ", ".join(["row bigint", "n bigint", *[f"d{d} bigint" for d in range(DIM)]])
    parts = docs.select(text_or_empty(text).alias("text")).mapInArrow(giving_back(run), cols)
    total = parts.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM)]).toPandas()
    vectors, count = np.zeros((ROWS, DIM)), np.zeros(ROWS, np.int64)
    count[total["row"]] = total["n"]
    vectors[total["row"]] = total[[f"d{d}" for d in range(DIM)]].to_numpy()
    return vectors, count


@dataclass
class Model:
    """Word vectors with their weights in pooling, the features' scale, the network and its temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def features(self, column: pa.Array) -> np.ndarray:
        return pooled(column, self.vectors)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Of each text, means and deviations of its words' and its forms' vectors, how alike neighbours are, and its length; zeros without words."""
    words, forms, offs = tokens(*buffers(column))
    n = np.diff(offs)
    out = np.zeros((len(n), FEATURES))
    full = np.flatnonzero(n > 0)
    if len(full):
        begin, size = offs[:-1][full], n[full][:, None]
        for k, rows in enumerate((words, forms)):
            v = vectors[rows]
            mean = np.add.reduceat(v, begin, dtype=np.float64) / size
            square = np.add.reduceat(v * v, begin, dtype=np.float64) / size
            out[full, 2 * k * DIM : (2 * k + 1) * DIM] = mean
            out[full, (2 * k + 1) * DIM : (2 * k + 2) * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
        same = np.zeros((2, len(words)))
        same[0, 1:] = words[1:] == words[:-1]
        same[1, 2:] = words[2:] == words[:-2]
        same[0, begin] = same[1, begin] = 0
        same[1, np.minimum(begin + 1, len(words) - 1)] = 0
        out[full, -4:-2] = np.stack([np.add.reduceat(s, begin) for s in same], 1) / size
    out[:, -2] = np.log1p(n)
    out[:, -1] = n == 0
    return out


def scaled(vectors: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Unit context vectors and the row's own index vector, frequent rows weighted down."""
    own = np.zeros((ROWS, DIM))
    np.put_along_axis(own, _PLACE, _SIGN, 1)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = count / max(count.sum() / 2, 1)
    return ((unit + own / np.sqrt(PLACES)) * (1e-2 / (1e-2 + share))[:, None]).astype(np.float32)


def fitted(x: np.ndarray, y: np.ndarray, tune: np.ndarray, vectors: np.ndarray) -> Model:
    """A network learned by Adam on the rows outside `tune`, its temperature by the loss on those inside."""
    rng = np.random.Generator(np.random.PCG64(5))
    fit = np.flatnonzero(~tune) if (~tune).any() else np.arange(len(y))
    mean, scale = (x[fit].mean(0, dtype=np.float64), x[fit].std(0, dtype=np.float64) + 1e-3) if len(fit) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    z = (x - mean.astype(x.dtype)) / scale.astype(x.dtype)
    for epoch in range(EPOCHS if len(fit) else 0):
        order = rng.permutation(fit)
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            b = order[i : i + BATCH]
            h = np.tanh(z[b] @ layers[0] + layers[1])
            g = (1 / (1 + np.exp(-(h @ layers[2] + layers[3]))) - y[b]) / len(b)
            back = np.outer(g, layers[2]) * (1 - h * h)
            grads = [z[b].T @ back + DECAY * layers[0], back.sum(0), h.T @ g + DECAY * layers[2], g.sum()]
            t += 1
            for k, w in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * w
                v[k] = 0.999 * v[k] + 0.001 * w * w
                layers[k] = layers[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model = Model(vectors, mean, scale, layers, 1.0)
    rows = np.flatnonzero(tune) if tune.any() else fit
    if len(rows):
        logit, target = model.logits(x[rows]), y[rows]
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.mean(np.logaddexp(0, logit / g) - target * logit / g) for g in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> Model:
    """A model from all texts' word vectors and `most` labelled rows at most, of those with crc32(key) mod 5 not 0.

    Null labels and labels of keys without a row are left out. Without any label every score is a half.
    """
    python_ready(docs.sparkSession)
    vectors = scaled(*word_vectors(docs, text))
    known = labels.where(F.col(label).isNotNull() & (F.crc32(F.col(key).cast("string")) % 5 != 0)).groupBy(F.col(key).alias("labelled")).agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("labelled")).orderBy("h", "labelled").limit(most)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            x = pooled(block.column("text"), shared.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([block.column("h"), block.column("y"), pa.array([row.tobytes() for row in x], pa.binary())], ["h", "y", "x"])

    rows = docs.select(docs[key].alias("labelled"), text_or_empty(text).alias("text")).join(F.broadcast(known), "labelled")
    got = rows.select("h", "y", "text").mapInArrow(giving_back(run), "h bigint, y int, x binary").toArrow().combine_chunks()
    shared.destroy()
    h, y = got["h"].to_numpy(), got["y"].to_numpy()
    order = np.lexsort((y, h))
    x = np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in got["x"]])[order] if len(h) else np.zeros((0, FEATURES), np.float32)
    return fitted(x, y[order].astype(np.float64), h[order] % 5 == 1, vectors)


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the model's probability of label 1 for each whole text; null and empty texts have one too.

    A column of docs that is named `name` is replaced. No shuffle.
    """
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c.lower() != name.lower() or c == text]
    if name.lower() == text.lower():
        raise ValueError("the score can't take the text's name")
    docs = docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, 1 << 19):
            score = shared.value.score(shared.value.features(block.column(text)))
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in columns], pa.array(score)], [*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(giving_back(run), f"{schema}, `{name}` double")


def classified(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's rows: key, held_out, score, predicted."""
    model = train(docs, labels, key)
    return scored(docs.select(key, "text"), model).select(
        key, (F.crc32(F.col(key).cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
