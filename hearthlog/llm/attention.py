"""A small causal self-attention model over subword ids, in numpy: forward pass, gradients, Adam.

The next id is predicted class first (``CLASSES`` classes of ``CLASS_SIZE`` ids), then within its class, so
a prediction costs two short softmaxes. Both start from the corpus's smoothed bigram counts; one attention
head over the last ``CONTEXT`` to ``2 * CONTEXT - 1`` ids adds to their logits.

A text is END, its ids, END. Windows of ``2 * CONTEXT`` ids start every ``CONTEXT`` ids, the first one half
before the text; each scores the ids that follow its second half. Windows overlap by half, every id is
scored exactly once, and each sees at least ``CONTEXT`` earlier ids where the text has them. A window is
one row of a batch; the mask hides ids after the scored one and places before the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from hearthlog.llm.subwords import END, SIZE

CONTEXT = 12
WIDTH = 16
CLASS_SIZE = 32
CLASSES = SIZE // CLASS_SIZE
BATCH = 512
PAD = -1

_SHAPES = {
    "embed": (SIZE, WIDTH),
    "place": (2 * CONTEXT, WIDTH),
    "query": (WIDTH, WIDTH),
    "key": (WIDTH, WIDTH),
    "value": (WIDTH, WIDTH),
    "out": (WIDTH, WIDTH),
    "class_out": (WIDTH, CLASSES),
    "inner_out": (CLASSES, WIDTH, CLASS_SIZE),
}
N_PARAMETERS = sum(int(np.prod(s)) for s in _SHAPES.values())
_CAUSAL = np.arange(2 * CONTEXT)[None, :] <= np.arange(CONTEXT, 2 * CONTEXT)[:, None]


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Named views into one parameter vector."""
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(seed: int = 7) -> np.ndarray:
    """Initial parameters; the output starts at zero, that is, at the bigram model."""
    flat = np.random.default_rng(seed).normal(0, 0.3, N_PARAMETERS).astype(np.float32)
    p = unpack(flat)
    p["class_out"][:] = 0
    p["inner_out"][:] = 0
    return flat


def bigram_logits(counts: np.ndarray, strength: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of class after id, and of id in its class after id, from (id, next) counts.

    Each backs off to the same without the id before, which backs off to equal shares.
    """
    counts = counts.reshape(SIZE, CLASSES, CLASS_SIZE).astype(np.float64)
    by_class = counts.sum(axis=2)
    class_share = by_class.sum(axis=0) + 0.5
    class_share /= class_share.sum()
    inner_share = counts.sum(axis=0) + 0.1
    inner_share /= inner_share.sum(axis=1, keepdims=True)
    outer = (by_class + strength * class_share) / (by_class.sum(axis=1, keepdims=True) + strength)
    inner = (counts + strength * inner_share) / (by_class[:, :, None] + strength)
    return np.log(outer).astype(np.float32), np.log(inner).astype(np.float32)


def windows(sequence: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, text): windows of ``2 * CONTEXT`` inputs and one more id, for texts that follow each other.

    ``sequence`` holds END, ids, END for every text; text k is ``sequence[borders[k]:borders[k + 1]]``.
    Places outside the text are ``PAD``. A call's texts have fewer than 2**31 ids.
    """
    return runs(sequence, borders, 1)


def runs(sequence: np.ndarray, borders: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, text): like ``windows``, with ``length`` windows of a text that follow each other in a row.

    They overlap, so a row holds their ids once. Windows behind the end of the text score nothing.
    """
    lengths = np.diff(borders)
    n = -(-(lengths - 1) // (length * CONTEXT))
    text = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    width = (length + 1) * CONTEXT + 1
    place = ((nth * length - 1) * CONTEXT).astype(np.int32)[:, None] + np.arange(width, dtype=np.int32)[None, :]
    inside = (place >= 0) & (place < lengths[text][:, None])
    place += borders[text].astype(np.int32)[:, None]
    place *= inside
    rows = sequence[place]
    rows[~inside] = PAD
    return rows, text


def windows_of(rows: np.ndarray) -> np.ndarray:
    """The windows of ``runs`` that score an id."""
    found = np.lib.stride_tricks.sliding_window_view(rows, 2 * CONTEXT + 1, axis=1)[:, ::CONTEXT]
    return found[found[:, :, CONTEXT + 1] >= 0]


_LATER = np.where(_CAUSAL, np.float32(0), np.float32(-1e9))
_LIMIT = np.float32(60)  # of logits: keeps exp() finite in single precision


def _softmax(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax at one place of each row; ``logits`` become the softmax."""
    np.minimum(logits, _LIMIT, out=logits)
    chosen = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    total = np.einsum("ij->i", logits)
    logits /= total[:, None]
    return chosen - np.log(total)


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax at one place of each row; ``logits`` is overwritten."""
    np.minimum(logits, _LIMIT, out=logits)
    chosen = logits[np.arange(len(at)), at]
    return chosen - np.log(np.einsum("ij->i", np.exp(logits, out=logits)))


class Model:
    """Parameters with the bigram tables they correct."""

    def __init__(self, flat: np.ndarray, class_table: np.ndarray, inner_table: np.ndarray) -> None:
        self.flat, self.p = flat, unpack(flat)
        self.class_table, self.inner_table = class_table, inner_table
        self._arrays: dict[str, np.ndarray] = {}

    def _array(self, name: str, *shape: int) -> np.ndarray:
        """A work array that is used again by the next batch: fresh ones cost more than the arithmetic."""
        size = int(np.prod(shape))
        held = self._arrays.get(name)
        if held is None or held.size < size:
            held = self._arrays[name] = np.empty(size, dtype=self.flat.dtype)
        return held[:size].reshape(shape)

    def _times(self, name: str, x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """``x @ matrix`` as one product instead of one per window."""
        out = self._array(name, *x.shape[:-1], matrix.shape[1])
        np.matmul(x.reshape(-1, x.shape[-1]), matrix, out=out.reshape(-1, matrix.shape[1]))
        return out

    def _attend(self, rows: np.ndarray) -> tuple:
        """Attention outputs for the second half of each window, and what the gradients need."""
        p, n = self.p, len(rows)
        inputs = rows[:, :-1]
        x = self._array("x", n, 2 * CONTEXT, WIDTH)
        np.take(p["embed"], np.maximum(inputs, 0), axis=0, out=x, mode="clip")
        x += p["place"]
        late = self._array("late", n, CONTEXT, WIDTH)
        late[:] = x[:, CONTEXT:]
        q = self._times("q", late, p["query"] / np.float32(np.sqrt(WIDTH)))
        k, v = self._times("k", x, p["key"]), self._times("v", x, p["value"])
        scores = np.matmul(q, k.transpose(0, 2, 1), out=self._array("scores", n, CONTEXT, 2 * CONTEXT))
        scores += _LATER
        outside = inputs < 0
        partly = np.flatnonzero(outside.any(axis=1))
        scores[partly] += np.where(outside[partly], np.float32(-1e9), np.float32(0))[:, None, :]
        np.minimum(scores, _LIMIT, out=scores)
        np.exp(scores, out=scores)
        scores /= np.einsum("bij->bi", scores)[:, :, None] + np.float32(1e-30)
        mixed = np.matmul(scores, v, out=self._array("mixed", n, CONTEXT, WIDTH))
        hidden = self._times("hidden", mixed, p["out"])
        hidden += late
        return x, late, q, k, v, scores, mixed, hidden

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Natural log-probability of every scored id, 0 where there is none: (windows, ``CONTEXT``)."""
        result = np.zeros((len(rows), CONTEXT), dtype=np.float64)
        for at in range(0, len(rows), BATCH):
            part = rows[at : at + BATCH]
            hidden = self._attend(part)[-1]
            own, t, group, _, _, outer, inner = self._by_class(hidden, part)
            value = _log_share(outer, group).astype(np.float64) + _log_share(inner, t % CLASS_SIZE)
            result[at : at + BATCH].ravel()[own] = value
        return result

    def _by_class(self, hidden: np.ndarray, rows: np.ndarray) -> tuple:
        """Of the scored ids in order of their class: places, ids, classes, ends of the classes, hidden states, logits."""
        target = rows[:, CONTEXT + 1 :].ravel()
        real = np.flatnonzero(target >= 0)
        t = target[real]
        group = (t // CLASS_SIZE).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        own = real[order]
        h = np.take(hidden.reshape(-1, WIDTH), own, axis=0, out=self._array("h", len(own), WIDTH), mode="clip")
        t, group = t[order].astype(np.int64), group[order].astype(np.int64)
        previous = rows[:, CONTEXT:-1].ravel()[own].astype(np.int64)
        outer = self._times("outer", h, self.p["class_out"])
        outer += np.take(self.class_table, previous, axis=0, out=self._array("bias", len(own), CLASSES), mode="clip")
        inner = self._array("inner", len(own), CLASS_SIZE)
        inner_table = self.inner_table.reshape(-1, CLASS_SIZE)
        np.take(inner_table, previous * CLASSES + group, axis=0, out=inner, mode="clip")
        ends = np.cumsum(np.bincount(group, minlength=CLASSES)).tolist()
        parts = [(c, lo, hi) for c, (lo, hi) in enumerate(zip([0, *ends], ends)) if hi > lo]
        for c, lo, hi in parts:
            inner[lo:hi] += h[lo:hi] @ self.p["inner_out"][c]
        return own, t, group, parts, h, outer, inner

    def gradient(self, rows: np.ndarray) -> tuple[float, np.ndarray]:
        """(mean loss, gradient) over the scored ids of some windows."""
        p, flat = self.p, np.zeros_like(self.flat)
        g = unpack(flat)
        x, late, q, k, v, weights, mixed, hidden = self._attend(rows)
        own, t, group, parts, h, outer, inner = self._by_class(hidden, rows)
        n, each = len(t), np.arange(len(t))
        loss = -float((_softmax(outer, group) + _softmax(inner, t % CLASS_SIZE)).mean())
        d_outer, d_inner = outer, inner
        for d, at in ((d_outer, group), (d_inner, t % CLASS_SIZE)):
            d[each, at] -= 1
            d /= n
        flat_of = lambda array: array.reshape(-1, WIDTH)
        g["class_out"][:] = h.T @ d_outer
        d_h = d_outer @ p["class_out"].T
        for c, lo, hi in parts:
            np.matmul(h[lo:hi].T, d_inner[lo:hi], out=g["inner_out"][c])
            d_h[lo:hi] += d_inner[lo:hi] @ p["inner_out"][c].T
        d_hidden = self._array("d_hidden", len(rows), CONTEXT, WIDTH)
        d_hidden[:] = 0
        flat_of(d_hidden)[own] = d_h
        g["out"][:] = flat_of(mixed).T @ flat_of(d_hidden)
        d_mixed = self._times("d_mixed", d_hidden, p["out"].T)
        d_scores = np.matmul(d_mixed, v.transpose(0, 2, 1), out=self._array("d_scores", *weights.shape))
        d_v = np.matmul(weights.transpose(0, 2, 1), d_mixed, out=self._array("d_v", *v.shape))
        d_scores -= np.einsum("bij,bij->bi", d_scores, weights)[:, :, None]
        d_scores *= weights
        # The scale of the scores is part of q.
        d_k = np.matmul(d_scores.transpose(0, 2, 1), q, out=self._array("d_k", *k.shape))
        d_q = np.matmul(d_scores, k, out=self._array("d_q", *q.shape))
        d_q /= np.float32(np.sqrt(WIDTH))
        g["query"][:] = flat_of(late).T @ flat_of(d_q)
        g["key"][:] = flat_of(x).T @ flat_of(d_k)
        g["value"][:] = flat_of(x).T @ flat_of(d_v)
        d_x = self._times("d_x", d_k, p["key"].T)
        d_x += self._times("d_x_v", d_v, p["value"].T)
        d_hidden += self._times("d_late", d_q, p["query"].T)
        d_x[:, CONTEXT:] += d_hidden
        inputs = rows[:, :-1]
        d_x[inputs < 0] = 0
        g["place"][:] = d_x.sum(axis=0)
        which = np.maximum(inputs, 0).ravel().astype(np.int64)
        cells = (which[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        g["embed"][:] = np.bincount(cells, weights=d_x.ravel(), minlength=SIZE * WIDTH).reshape(SIZE, WIDTH)
        return loss, flat


def train(model: Model, batches: Iterator[np.ndarray], rate: float) -> None:
    """One pass of Adam over batches of windows, in place."""
    first, second = np.zeros_like(model.flat), np.zeros_like(model.flat)
    for step, rows in enumerate(batches, 1):
        _, gradient = model.gradient(rows)
        first += 0.1 * (gradient - first)
        np.square(gradient, out=gradient)
        gradient -= second
        gradient *= 0.001
        second += gradient
        scaled = np.sqrt(np.divide(second, 1 - 0.999**step, out=gradient), out=gradient)
        scaled += 1e-8
        np.divide(first, scaled, out=scaled)
        scaled *= rate / (1 - 0.9**step)
        model.flat -= scaled


def join_texts(ids: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """END, ids, END for every text, and the new borders."""
    n = len(borders) - 1
    longer = borders + 2 * np.arange(n + 1)
    sequence = np.full(longer[-1], END, dtype=np.int16)
    sequence[np.arange(len(ids)) + np.repeat(2 * np.arange(n) + 1, np.diff(borders))] = ids
    return sequence, longer
