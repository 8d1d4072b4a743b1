"""A hashed linear scorer over word and character n-grams, with calibrated probabilities.

A text has four families of features: single words, word pairs, and character n-grams of two lengths.
Each family is a frequency distribution, so the length of a text does not matter. The fit runs on a
bounded sample in numpy; scoring is a table lookup per n-gram inside Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 18
SCALE = 20.0  # frequencies are small; this brings them near one
CHAR_SIZES = (2, 4)
_FAMILIES = 2 + len(CHAR_SIZES)
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def families(text: bytes, hashes: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Feature numbers by family; a family has its own range of 2 ** bits."""
    from reviewmill.llm.measures import shingle_hashes

    down = np.uint64(64 - bits)
    out = [(hashes * np.uint64(0x9E3779B97F4A7C15)) >> down]
    out.append((shingle_hashes(hashes, 2) * np.uint64(0x9E3779B97F4A7C15)) >> down if len(hashes) > 1 else hashes[:0])
    codes = np.frombuffer(text, np.uint8).astype(np.uint32)
    for size in CHAR_SIZES:
        count = max(0, len(codes) - size + 1)
        mixed = np.zeros(count, np.uint32)
        for step in range(size):
            mixed += codes[step : step + count] * _MULTIPLIERS[step]
        mixed ^= mixed >> np.uint32(15)
        out.append((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits))
    return [f.astype(np.int64) + (i << bits) for i, f in enumerate(out)]


def sparse(text: bytes, hashes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of one text, each number once."""
    numbers, values = [], []
    for family in families(text, hashes, bits):
        if len(family):
            found, counts = np.unique(family, return_counts=True)
            numbers.append(found)
            values.append(counts * (SCALE / len(family)))
    if not numbers:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(numbers).astype(np.int32), np.concatenate(values).astype(np.float32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Scorer:
    """Weights, and the slope and shift that turn a score into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int = BITS

    def probability(self, text: bytes, hashes: np.ndarray, found: list[np.ndarray] | None = None) -> float:
        """``found`` are the families of the text, if they are known."""
        total = self.bias
        for family in families(text, hashes, self.bits) if found is None else found:
            if len(family):
                total += SCALE * float(self.weights.take(family).mean(dtype=np.float64))
        return float(sigmoid(self.slope * total + self.shift))


def _descend(rows, numbers, values, targets, weights, size, count, rounds, rate, penalty):
    """Full-batch AdaGrad on the log loss; targets may be probabilities."""
    w, bias = np.zeros(size, np.float32), 0.0
    squares, bias_square = np.full(size, 1e-8, np.float32), 1e-8
    total = weights.sum()
    rows, numbers = rows.astype(np.intp), numbers.astype(np.intp)  # as bincount wants them, once
    for _ in range(rounds):
        logits = np.bincount(rows, w[numbers] * values, count) + bias
        slope = (sigmoid(logits) - targets) * weights / total
        gradient = np.bincount(numbers, slope[rows] * values, size).astype(np.float32) + penalty * w
        squares += gradient**2
        w -= rate * gradient / np.sqrt(squares)
        step = slope.sum()
        bias_square += step**2
        bias -= rate * step / np.sqrt(bias_square)
    return w, bias


def _calibrate(scores: np.ndarray, targets: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method on the log loss, with smoothed targets."""
    good, bad = targets.sum(), (1 - targets).sum()
    aim = targets * (good + 1) / (good + 2) + (1 - targets) / (bad + 2)
    point = np.array([1.0, 0.0])
    design = np.stack([scores, np.ones_like(scores)], axis=1)
    for _ in range(30):
        p = sigmoid(design @ point)
        gradient = design.T @ (p - aim) + 1e-3 * (point - [1.0, 0.0])
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        point = point - np.clip(np.linalg.solve(curve, gradient), -2, 2)
    return float(point[0]), float(point[1])


def fit(
    features: list[tuple[np.ndarray, np.ndarray]],
    targets: np.ndarray,
    held_out: np.ndarray,
    bits: int = BITS,
    rounds: int = 60,
    rate: float = 0.1,
    penalty: float = 1e-7,
) -> Scorer:
    """Fit on the rows that are not ``held_out`` and calibrate on those that are.

    Without rows the scorer answers one half; with one class only, it answers near that class.
    """
    size = _FAMILIES << bits
    targets = np.asarray(targets, float)
    if not len(targets):
        return Scorer(np.zeros(size, np.float32), 0.0, 1.0, 0.0, bits)
    learn = ~held_out if (~held_out).any() else np.ones(len(targets), bool)
    chosen = np.flatnonzero(learn)
    rows = np.repeat(np.arange(len(chosen)), [len(features[i][0]) for i in chosen])
    numbers = np.concatenate([features[i][0] for i in chosen])
    values = np.concatenate([features[i][1] for i in chosen])
    weights, bias = _descend(rows, numbers, values, targets[chosen], np.ones(len(chosen)), size, len(chosen), rounds, rate, penalty)
    scorer = Scorer(weights, float(bias), 1.0, 0.0, bits)
    judged = np.flatnonzero(held_out) if held_out.any() else chosen
    scores = np.array([float((weights[features[i][0]] * features[i][1]).sum()) + scorer.bias for i in judged])
    scorer.slope, scorer.shift = _calibrate(scores, targets[judged])
    return scorer
