"""A gated recurrent language model in numpy: class-factored output, truncated backpropagation.

Words are numbered by frequency; number 0 stands for every word outside the vocabulary, number 1 for the
end of a text. A word's class is its number divided by the class size, so the output is two small softmax
layers. Texts run side by side in lanes, and the state of a lane is carried from window to window.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

np.seterr(over="ignore")  # of the gates' exponentials
OTHER, END = 0, 1


@dataclass
class Model:
    """All parameters. ``embed`` already holds what a word adds to the three gates."""

    embed: np.ndarray  # words x 3 hidden
    recur: np.ndarray  # hidden x 3 hidden
    class_weight: np.ndarray  # hidden x classes
    class_bias: np.ndarray
    word_weight: np.ndarray  # classes x hidden x class size
    word_bias: np.ndarray  # classes x class size

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def unflat(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Model(*out)


def new_model(masses: np.ndarray, classes: int, hidden: int, seed: int = 0) -> Model:
    """Small random weights, and output biases under which the model is the unigram model of ``masses``.

    ``masses`` has one weight per word number; its length is a multiple of ``classes``, padded with zeros.
    """
    rng = np.random.default_rng(seed)
    by_class = masses.reshape(classes, -1).astype(np.float64)
    total = by_class.sum(axis=1)
    tiny = 1e-30

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return Model(
        draw(masses.size, 3 * hidden, scale=0.1),
        draw(hidden, 3 * hidden, scale=hidden**-0.5),
        np.zeros((hidden, classes), np.float32),
        np.log(np.maximum(total / masses.sum(), tiny)).astype(np.float32),
        np.zeros((classes, hidden, by_class.shape[1]), np.float32),
        np.log(np.maximum(by_class / np.maximum(total, tiny)[:, None], tiny)).astype(np.float32),
    )


def _gates(model: Model, given: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Update gate z, reset gate r, q and candidate n. The gates' inputs are held with the sign turned."""
    width = h.shape[1]
    pushed = h @ model.recur
    zr = pushed[:, : 2 * width] + given[:, : 2 * width]
    np.exp(zr, out=zr)  # an overflow is a gate of zero
    zr += 1.0
    np.reciprocal(zr, out=zr)
    z, r, q = zr[:, :width], zr[:, width:], pushed[:, 2 * width :]
    n = r * q
    n += given[:, 2 * width :]
    return z, r, q, np.tanh(n, out=n)


def _exps(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, in place, and their sums by row; the limits keep both within single precision."""
    np.clip(logits, -80.0, 60.0, out=logits)
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], np.float32)


def _by_class(numbers: np.ndarray, size: int):
    """(order, class, from, to) of the classes that occur."""
    kinds = numbers // size
    order = np.argsort(kinds, kind="stable")
    bounds = np.searchsorted(kinds[order], np.arange(kinds.max() + 2)) if len(numbers) else np.zeros(1, int)
    return order, [(c, bounds[c], bounds[c + 1]) for c in range(len(bounds) - 1) if bounds[c] < bounds[c + 1]]


def log_probabilities(model: Model, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target word number after each state."""
    size = model.word_bias.shape[1]
    order, parts = _by_class(targets, size)
    states, wanted = states[order], targets[order]
    rows = np.arange(len(wanted))
    powers, sums = _exps(states @ model.class_weight + model.class_bias)
    chosen = powers[rows, wanted // size] / sums
    for c, lo, hi in parts:
        powers, sums = _exps(states[lo:hi] @ model.word_weight[c] + model.word_bias[c])
        chosen[lo:hi] *= powers[rows[: hi - lo], wanted[lo:hi] - c * size] / sums
    out = np.empty(len(wanted))
    out[order] = np.log(np.maximum(chosen, np.float32(1e-37)).astype(np.float64))
    return out


def gradients(model: Model, h: np.ndarray, given: np.ndarray, targets: np.ndarray, fresh: np.ndarray, valid: np.ndarray):
    """(loss per word, gradients, last state) of one window; arrays are steps x lanes."""
    steps, lanes = given.shape
    width = h.shape[1]
    inputs = model.embed[given]
    before, states, z, r, q, n = (np.empty((steps, lanes, width), np.float32) for _ in range(6))
    new = fresh.any(axis=1)
    for t in range(steps):
        if new[t]:
            h = np.where(fresh[t][:, None], np.float32(0), h)
        before[t] = h
        z[t], r[t], q[t], n[t] = _gates(model, inputs[t], h)
        h = h - n[t]
        h *= z[t]
        h += n[t]
        states[t] = h
    size = model.word_bias.shape[1]
    order, parts = _by_class(targets.ravel(), size)
    flat, wanted = states.reshape(-1, width)[order], targets.ravel()[order]
    used = valid.ravel()[order]
    count = max(1, int(used.sum()))
    rows = np.arange(len(wanted))
    grad = Model(*[np.zeros_like(a) for a in model.arrays()])

    def softmax(logits: np.ndarray, target: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of the target, gradient of the loss by the logits)."""
        powers, sums = _exps(logits)
        powers /= sums[:, None]
        at = (rows[: len(target)], target)
        right = powers[at]
        powers[at] -= 1
        if not keep.all():
            powers *= keep[:, None]
        return right, powers

    chosen, d_class = softmax(flat @ model.class_weight + model.class_bias, wanted // size, used)
    grad.class_weight[:] = flat.T @ d_class
    grad.class_bias[:] = d_class.sum(axis=0)
    d_flat = d_class @ model.class_weight.T
    for c, lo, hi in parts:
        right, d_word = softmax(flat[lo:hi] @ model.word_weight[c] + model.word_bias[c], wanted[lo:hi] - c * size, used[lo:hi])
        chosen[lo:hi] *= right
        grad.word_weight[c] = flat[lo:hi].T @ d_word
        grad.word_bias[c] = np.ones(hi - lo, np.float32) @ d_word
        d_flat[lo:hi] += d_word @ model.word_weight[c].T
    d_states = np.empty((steps * lanes, width), np.float32)
    d_states[order] = d_flat
    d_states = d_states.reshape(steps, lanes, width)
    # what a change of the state does to the inputs of the gates, for all steps at once
    from_z = (n - before) * z * (1 - z)
    from_n = (1 - z) * (1 - n * n)
    from_r = q * r * (r - 1)
    d_inputs = np.empty((steps, lanes, 3 * width), np.float32)
    gates_back, state_back = np.ascontiguousarray(model.recur[:, : 2 * width].T), np.ascontiguousarray(model.recur[:, 2 * width :].T)
    back = np.zeros((lanes, width), np.float32)
    for t in range(steps - 1, -1, -1):
        d = d_states[t]
        d += back
        here = d_inputs[t]
        np.multiply(d, from_z[t], out=here[:, :width])
        d_n = d * from_n[t]
        here[:, 2 * width :] = d_n
        np.multiply(d_n, from_r[t], out=here[:, width : 2 * width])
        d_n *= r[t]
        back = here[:, : 2 * width] @ gates_back
        back += d_n @ state_back
        d *= z[t]
        back += d
        if new[t]:
            back[fresh[t]] = 0
    pushed = d_inputs.copy()
    pushed[:, :, 2 * width :] *= r
    grad.recur[:] = before.reshape(-1, width).T @ pushed.reshape(-1, 3 * width)
    seen = given.ravel()
    sort = np.argsort(seen, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(seen[sort]) > 0])
    grad.embed[seen[sort][starts]] = np.add.reduceat(d_inputs.reshape(-1, 3 * width)[sort], starts, axis=0)
    for g in grad.arrays():
        g /= count
    loss = -np.log(np.maximum(chosen, np.float32(1e-37)))
    return float((loss * used).sum() / count), grad, h


class Adam:
    """Step sizes from running moments of the gradients."""

    def __init__(self, model: Model, rate: float):
        self.rate, self.count = rate, 0
        self.first = [np.zeros_like(a) for a in model.arrays()]
        self.second = [np.zeros_like(a) for a in model.arrays()]

    def step(self, model: Model, grad: Model) -> None:
        self.count += 1
        scale = self.rate * (1 - 0.99**self.count) ** 0.5 / (1 - 0.9**self.count)
        for a, g, m, v in zip(model.arrays(), grad.arrays(), self.first, self.second):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            a -= scale * m / (np.sqrt(v) + 1e-8)


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts dealt to lanes of near equal length, longest first; lanes sorted by length, longest first."""
    import heapq

    heap = [(0, i) for i in range(lanes)]
    dealt: list[list[int]] = [[] for _ in range(lanes)]
    for text in np.argsort(-lengths, kind="stable").tolist():
        held, lane = heapq.heappop(heap)
        dealt[lane].append(text)
        heapq.heappush(heap, (held + int(lengths[text]), lane))
    load = [sum(int(lengths[t]) for t in lane) for lane in dealt]
    return [dealt[i] for i in sorted(range(lanes), key=lambda i: -load[i]) if load[i]]


def lay_out(texts: list[np.ndarray], lanes: int) -> tuple[np.ndarray, ...]:
    """(given, targets, fresh, owner) as steps x lanes; owner is -1 where a lane has ended.

    A text's targets are its words; it is given the end of a text and then its own words but the last.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    dealt = lanes_of(lengths, max(1, min(lanes, len(texts))))
    steps = max((sum(int(lengths[t]) for t in lane) for lane in dealt), default=0)
    targets = np.full((steps, len(dealt)), END, np.int32)
    given = np.full((steps, len(dealt)), END, np.int32)
    fresh = np.zeros((steps, len(dealt)), bool)
    owner = np.full((steps, len(dealt)), -1, np.int32)
    for column, lane in enumerate(dealt):
        at = 0
        for text in lane:
            stop = at + len(texts[text])
            targets[at:stop, column] = texts[text]
            given[at + 1 : stop, column] = texts[text][:-1]
            fresh[at, column] = True
            owner[at:stop, column] = text
            at = stop
    return given, targets, fresh, owner


def train(model: Model, texts: list[np.ndarray], adam: Adam, window: int, lanes: int, longest: int = 1024) -> int:
    """One pass over the texts, in place; returns the number of words. Long texts are cut for the lanes."""
    pieces = [t[i : i + longest] for t in texts for i in range(0, len(t), longest)]
    given, targets, fresh, owner = lay_out(pieces, lanes)
    h = np.zeros((given.shape[1], model.recur.shape[0]), np.float32)
    for at in range(0, len(given), window):
        part = slice(at, at + window)
        _, grad, h = gradients(model, h, given[part], targets[part], fresh[part], owner[part] >= 0)
        adam.step(model, grad)
    return int((owner >= 0).sum())


def score(model: Model, texts: list[np.ndarray], lanes: int, window: int = 64) -> np.ndarray:
    """Natural log-probability of every whole text, the state carried through all its windows."""
    given, targets, fresh, owner = lay_out(texts, lanes)
    total = np.zeros(len(texts))
    width = model.recur.shape[0]
    h = np.zeros((given.shape[1], width), np.float32)
    for at in range(0, len(given), window):
        active = int((owner[at] >= 0).sum())  # lanes are sorted by length: the first ones still run
        h = h[:active]
        inputs = model.embed[given[at : at + window, :active]]
        states = np.empty((*inputs.shape[:2], width), np.float32)
        new = fresh[at : at + window, :active]
        any_new = new.any(axis=1)
        for t in range(len(inputs)):
            if any_new[t]:
                h = np.where(new[t][:, None], np.float32(0), h)
            z, _, _, n = _gates(model, inputs[t], h)
            h = n + z * (h - n)
            states[t] = h
        who = owner[at : at + window, :active].ravel()
        held = who >= 0
        logs = log_probabilities(model, states.reshape(-1, width)[held], targets[at : at + window, :active].ravel()[held])
        total += np.bincount(who[held], logs, len(texts))
    return total
