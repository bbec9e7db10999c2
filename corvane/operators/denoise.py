"""A denoising state machine per trajectory: which masked places are filled in each step, by a pluggable kernel.

The kernel stands for a model: it maps token ids to (proposed ids, confidences). Steps depend on each
other, so a trajectory runs inside one Arrow-batched group function; trajectories are independent, and a
seed belongs to a row, so neither batch nor partition changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Kernel = Callable[[np.ndarray, int, int], tuple[np.ndarray, np.ndarray]]


def times(steps: int, eps: float = 1e-3) -> np.ndarray:
    return np.linspace(1.0, eps, steps + 1)


def step(ids: np.ndarray, at: int, steps: int, mask: int, seed: int, kernel: Kernel, eps: float = 1e-3, heat: float = 0.0) -> np.ndarray:
    """One step: the most confident masked places take their proposals; ties go to the lowest place; the last step fills all.

    With `heat`, places are drawn without replacement in proportion to exp(confidence / heat).
    """
    masked = np.flatnonzero(ids == mask)
    t = times(steps, eps)
    n = len(masked) if at == steps - 1 else int(len(masked) * (1 - t[at + 1] / t[at]))
    if n <= 0:
        return ids
    proposed, confidence = kernel(ids, at, seed)
    rank = confidence[masked]
    if heat > 0:
        rank = rank / heat + _gumbel(len(masked), seed, at, 1)
    chosen = masked[np.argsort(-rank, kind="stable")[:n]]
    out = ids.copy()
    out[chosen] = proposed[chosen]
    return out


def run(states: DataFrame, steps: int, mask: int, kernel: Kernel, until: int | None = None, heat: float = 0.0) -> DataFrame:
    """states (x array<int>, next_step int, seed bigint, others) advanced to step `until`: running on later gives the same ids."""
    last = steps if until is None else until

    def advance(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done = []
            for x, at, seed in zip(pdf["x"], pdf["next_step"], pdf["seed"], strict=True):
                ids = np.array(x, np.int64)
                for k in range(int(at), last):
                    ids = step(ids, k, steps, mask, int(seed), kernel, heat=heat)
                done.append(ids.tolist())
            yield pdf.assign(x=done, next_step=np.maximum(pdf["next_step"], last))

    return states.mapInPandas(advance, states.schema)


def _gumbel(shape: int | tuple[int, ...], seed: int, at: int, what: int) -> np.ndarray:
    """Noise whose largest sums with log weights are draws without replacement; it depends on (seed, step, use) alone."""
    return np.random.Generator(np.random.Philox([seed & (2**64 - 1), at << 8 | what])).gumbel(size=shape)


#: How sure a distribution over tokens is of the token taken.
CONFIDENCE: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "probability": lambda p, taken: p[np.arange(len(p)), taken],
    "margin": lambda p, taken: np.diff(np.sort(p, axis=1)[:, -2:], axis=1)[:, 0],
    "entropy": lambda p, taken: (p * np.log(p + 1e-10)).sum(axis=1),
}


def nucleus(logits: np.ndarray, share: float = 1.0, top: int | None = None) -> np.ndarray:
    """logits with minus infinity outside the fewest best tokens that reach the share of probability, and outside the `top` best."""
    best = -np.sort(-logits, axis=1)
    weight = np.exp(best - best[:, :1])
    before = np.cumsum(weight, axis=1) - weight
    kept = (before <= share * weight.sum(axis=1, keepdims=True)).sum(axis=1)
    kept = kept if top is None else np.minimum(kept, top)
    return np.where(logits >= np.take_along_axis(best, kept[:, None] - 1, axis=1), logits, -np.inf)


def model_kernel(logits: Callable[[np.ndarray, int], np.ndarray], confidence: str = "probability", temperature: float = 0.0, share: float = 1.0, top: int | None = None) -> Kernel:
    """A kernel of a model: `logits` maps (ids, step) to a row of scores per place.

    Without temperature the best token is proposed, else one is drawn. Confidence is the token's probability, the lead
    of the best token over the next, or minus the entropy. Scores that give no probabilities are an error.
    """

    def kernel(ids: np.ndarray, at: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        scores = np.asarray(logits(ids, at), np.float64)
        scores = nucleus(scores / temperature if temperature > 0 else scores, share, top)
        top_score = scores.max(axis=1, keepdims=True)
        if not np.isfinite(top_score).all():
            raise FloatingPointError("scores give no probabilities")
        p = np.exp(scores - top_score)
        p /= p.sum(axis=1, keepdims=True)
        taken = (scores + _gumbel(scores.shape, seed, at, 0)).argmax(axis=1) if temperature > 0 else p.argmax(axis=1)
        return taken, CONFIDENCE[confidence](p, taken)

    return kernel


def toy_kernel(vocabulary: int) -> Kernel:
    """A deterministic stand-in: proposals and confidences by a hash of (seed, step, place)."""

    def kernel(ids: np.ndarray, at: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = (np.arange(len(ids), dtype=np.uint64) + np.uint64(at * 1009 + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed & (2**63 - 1))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return (h % np.uint64(vocabulary)).astype(np.int64), (h >> np.uint64(11)).astype(np.float64)

    return kernel
