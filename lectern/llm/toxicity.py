"""Toxicity by a bidirectional gated recurrent network with attention pooling, over overlapping windows of words.

A word enters as the sum of a hashed word vector and the mean of hashed character vectors (prefixes and inner n-grams of
its UTF-8 bytes, A-Z as a-z). Two gated recurrent layers read a window forwards and backwards, attention pools their
states, and a logistic unit gives the window's logit. A text's windows overlap by half and cover all of its words; the
text's logit is the largest of its windows', put on a scale of probabilities by two numbers fitted on the training rows.

The network is trained in numpy by gradients of its own, on a bounded sample of labelled rows: at most `positives` and
`negatives` rows of least hash, each with at most `windows` windows spread over the whole text. Only training rows'
labels are read, and no column but the text enters a score.

Null texts count as empty; an empty text is one window without words and gets the network's score for that. Several
labels of one id count as toxic if one is, null labels are left out; without labels of both kinds the score is the
training share of toxic rows (0 without any). Equal rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, saved, small_batches, texts
from .textops import _BYTES, _LOWER, Words, mix, slices, split

WINDOW, STRIDE, EMBED, HIDDEN, WORD_ROWS, CHAR_ROWS = 64, 32, 16, 12, 1 << 14, 1 << 16
THRESHOLD, FOLDS, HELD_OUT = 0.7, 3, 1
PREFIXES, GRAMS = (4, 5, 6, 7), (4, 5)


@dataclass
class Plan:
    """Bounds of the sample that the network is trained on, and the training's length."""

    positives: int = 1500
    negatives: int = 3000
    windows: int = 6
    epochs: int = 6
    tuning: int = 3
    batch: int = 128
    rate: float = 0.03
    seed: int = 7


@dataclass
class Batch:
    """Windows of words: at[i, t] is the distinct word at place t of window i, or the last one (no word)."""

    at: np.ndarray
    word_row: np.ndarray
    feature: np.ndarray
    owner: np.ndarray
    share: np.ndarray
    doc: np.ndarray


def featured(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct words of w: inverse, row of the word vector, and (row of the character vector, its word)."""
    hashes = w.hashes(lower=True)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    start, end = w.start[first], w.end[first]
    up, down = _BYTES.get(len(w.buf) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[w.buf] * up[: len(w.buf)])])
    rows, owners = [], []
    for k in PREFIXES:
        on = np.flatnonzero(end - start >= k)
        s = start[on]
        rows.append(mix((total[s + k] - total[s]) * down[s] + np.uint64(k)))
        owners.append(on)
    for k in GRAMS:
        n = np.maximum(end - start - k + 1, 0)
        on = np.repeat(np.arange(len(start)), n)
        s = start[on] + np.arange(len(on)) - np.repeat(np.cumsum(n) - n, n)
        rows.append(mix((total[s + k] - total[s]) * down[s] + np.uint64(64 + k)))
        owners.append(on)
    row, owner = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return inverse, (hashes[first] % np.uint64(WORD_ROWS)).astype(np.int64), (row % np.uint64(CHAR_ROWS)).astype(np.int64)[order], owner[order]


def windowed(w: Words, window: int = WINDOW, stride: int = STRIDE) -> Batch:
    """All overlapping windows of the texts; a text without words has one empty window."""
    inverse, word_row, feature, owner = featured(w)
    sizes = np.diff(w.first)
    n = np.maximum(1, -(-(sizes - window) // stride) + 1)
    doc = np.repeat(np.arange(len(sizes)), n)
    begin = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * stride
    place = begin[:, None] + np.arange(window)[None, :]
    inside = place < sizes[doc][:, None]
    flat = np.minimum(w.first[doc][:, None] + place, max(0, len(inverse) - 1))
    at = np.where(inside, inverse[flat] if len(inverse) else 0, len(word_row))
    count = np.bincount(owner, minlength=len(word_row))
    return Batch(at, word_row, feature, owner, 1 / np.maximum(count, 1), doc)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Weights, and the slope and shift from a text's logit to its probability's logit."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        w = {"word": np.zeros((WORD_ROWS, EMBED), np.float32), "char": np.zeros((CHAR_ROWS, EMBED), np.float32)}
        for d in "fb":
            w |= {f"W{d}": draw(EMBED, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        w |= {"a": draw(2 * HIDDEN), "o": draw(2 * HIDDEN), "ob": np.full(1, -1, np.float32)}
        return Network(w)

    def inputs(self, x: Batch) -> np.ndarray:
        """The vector of each distinct word; a last row of zeros stands for no word."""
        n = len(x.word_row)
        out = np.zeros((n + 1, EMBED), np.float32)
        if len(x.owner):
            first = np.flatnonzero(np.r_[True, x.owner[1:] != x.owner[:-1]])
            out[x.owner[first]] = np.add.reduceat(self.weights["char"][x.feature], first, axis=0)
        out[:n] = out[:n] * x.share[:, None] + self.weights["word"][x.word_row]
        return out

    def layer(self, d: str, vectors: np.ndarray, at: np.ndarray, keep: bool):
        """States of one direction, time first: (window, rows, HIDDEN)."""
        w, h_size = self.weights, HIDDEN
        gates = vectors @ w[f"W{d}"] + w[f"b{d}"]
        none = len(vectors) - 1
        steps, rows = at.shape[1], at.shape[0]
        h = np.zeros((rows, h_size), np.float32)
        states = np.empty((steps, rows, h_size), np.float32)
        kept = []
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        for t in order:
            g = gates[at[:, t]]
            u = h @ w[f"U{d}"]
            rz = _sigmoid(g[:, : 2 * h_size] + u[:, : 2 * h_size])
            r, z = rz[:, :h_size], rz[:, h_size:]
            n = np.tanh(g[:, 2 * h_size :] + r * u[:, 2 * h_size :])
            on = (at[:, t] != none)[:, None]
            fresh = np.where(on, n + z * (h - n), h)
            if keep:
                kept.append((t, h, rz, n, u[:, 2 * h_size :], on))
            h = fresh
            states[t] = h
        return states, kept

    def logits(self, x: Batch, keep: bool = False):
        vectors = self.inputs(x)
        at = x.at
        forward, kf = self.layer("f", vectors, at, keep)
        backward, kb = self.layer("b", vectors, at, keep)
        states = np.concatenate([forward, backward], axis=2)
        on = (at != len(vectors) - 1).T
        score = states @ self.weights["a"]
        score = np.where(on, score, -1e9)
        score -= score.max(axis=0)
        alpha = np.exp(score) * on
        alpha /= np.maximum(alpha.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        logit = pooled @ self.weights["o"] + self.weights["ob"][0]
        return (logit, (vectors, states, alpha, pooled, kf, kb)) if keep else logit

    def train(self, x: Batch, label: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step of AdaGrad on windows of a batch."""
        logit, (vectors, states, alpha, pooled, kf, kb) = self.logits(x, keep=True)
        w, h_size = self.weights, HIDDEN
        d_logit = ((_sigmoid(logit) - label) * weight / len(label)).astype(np.float32)
        grad = {"o": pooled.T @ d_logit, "ob": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * w["o"]
        d_alpha = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        grad["a"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = alpha[:, :, None] * d_pooled + d_score[:, :, None] * w["a"]
        d_vectors = np.zeros_like(vectors)
        for d, kept, part in (("f", kf, slice(0, h_size)), ("b", kb, slice(h_size, None))):
            d_h = np.zeros((len(logit), h_size), np.float32)
            d_gates = np.zeros((x.at.shape[1], len(logit), 3 * h_size), np.float32)
            d_u = np.zeros_like(w[f"U{d}"])
            for t, h, rz, n, un, on in reversed(kept):
                d_h = d_h + d_states[t][:, part]
                r, z = rz[:, :h_size], rz[:, h_size:]
                live = d_h * on
                d_n = live * (1 - z) * (1 - n * n)
                d_r = d_n * un * r * (1 - r)
                d_z = live * (h - n) * z * (1 - z)
                d_gates[t] = np.concatenate([d_r, d_z, d_n], axis=1)
                d_hidden = np.concatenate([d_r, d_z, d_n * r], axis=1)
                d_u += h.T @ d_hidden
                d_h = d_h * ~on + live * z + d_hidden @ w[f"U{d}"].T
            flat = d_gates.reshape(-1, 3 * h_size)
            where = x.at.T.ravel()
            summed = np.stack([np.bincount(where, flat[:, k], len(vectors)) for k in range(3 * h_size)], axis=1).astype(np.float32)
            summed[-1] = 0
            grad |= {f"W{d}": vectors.T @ summed, f"U{d}": d_u, f"b{d}": flat.sum(axis=0)}
            d_vectors += summed @ w[f"W{d}"].T
        for k, g in grad.items():
            self._step(k, slice(None), g, rate)
        words, back = np.unique(x.word_row, return_inverse=True)
        self._step("word", words, np.stack([np.bincount(back, d_vectors[:-1, e], len(words)) for e in range(EMBED)], axis=1), rate)
        if len(x.feature):
            rows, back = np.unique(x.feature, return_inverse=True)
            part = d_vectors[x.owner] * x.share[x.owner][:, None]
            self._step("char", rows, np.stack([np.bincount(back, part[:, e], len(rows)) for e in range(EMBED)], axis=1), rate)

    def _step(self, name: str, rows, gradient: np.ndarray, rate: float) -> None:
        total = self.seen.setdefault(name, np.full_like(self.weights[name], 1e-8))
        gradient = gradient.astype(np.float32)
        total[rows] += gradient * gradient
        self.weights[name][rows] -= rate * gradient / np.sqrt(total[rows])

    def scores(self, w: Words) -> np.ndarray:
        """The probability of each text."""
        if self.constant is not None:
            return np.full(w.n_docs, self.constant)
        return _sigmoid(self.slope * self.text_logits(w) + self.shift)

    def text_logits(self, w: Words) -> np.ndarray:
        return self.worst_windows(w)[0]

    def worst_windows(self, w: Words, most: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the largest logit of its windows and the number of that window."""
        x = windowed(w)
        # the states of so many windows at a time: a long text takes no more memory than a slice of short ones
        parts = [Batch(x.at[i : i + most], x.word_row, x.feature, x.owner, x.share, x.doc[i : i + most]) for i in range(0, len(x.at), most)]
        z = np.concatenate([self.logits(part) for part in parts]).astype(np.float64)
        order = np.lexsort((-z, x.doc))
        first = np.flatnonzero(np.r_[True, np.diff(x.doc[order]) > 0])
        at = order[first]
        return z[at], at - np.searchsorted(x.doc, x.doc[at])


def _words(values: list[str]) -> Words:
    raw = [v.encode() for v in values]
    return split(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))


def fit(windows: list[list[str]], labels: list[int], plan: Plan | None = None) -> Network:
    """A network for texts given by some of their windows each. In each epoch after the first a toxic text counts by the
    window that the network finds most toxic, as the others may well be clean."""
    plan = plan or Plan()
    if not labels or min(labels) == max(labels):
        return Network({}, constant=float(np.mean(labels)) if labels else 0.0)
    net, rng = Network.fresh(plan.seed), np.random.default_rng(plan.seed)
    flat = [v for ws in windows for v in ws]
    doc = np.repeat(np.arange(len(windows)), [len(ws) for ws in windows])
    y = np.array(labels, dtype=np.float32)[doc]
    parts = [windowed(_words(flat[i : i + 512])) for i in range(0, len(flat), 512)]
    use = np.ones(len(flat), dtype=bool)
    for epoch in range(plan.epochs):
        if epoch:
            z = np.concatenate([net.logits(p) for p in parts])
            best = np.full(len(windows), -np.inf, dtype=np.float32)
            np.maximum.at(best, doc, z)
            use = (y == 0) & ((z > -4) | (rng.random(len(z)) < 0.3)) | (y == 1) & (z >= best[doc] - 1e-6)
        _epoch(net, flat, y, rng.permutation(np.flatnonzero(use)), plan, plan.rate * (1 - 0.7 * epoch / plan.epochs))
    return net


def _epoch(net: Network, windows: list[str], y: np.ndarray, order: np.ndarray, plan: Plan, rate: float) -> None:
    positive = max(1.0, float(y[order].sum()))
    up = min(8.0, max(1.0, (len(order) - positive) / positive) ** 0.5)
    for i in range(0, len(order), plan.batch):
        part = order[i : i + plan.batch]
        net.train(windowed(_words([windows[k] for k in part])), y[part], np.where(y[part] == 1, up, 1.0), rate)


def tune(net: Network, worst: list[str], labels: list[int], plan: Plan) -> None:
    """More epochs on the worst window of each whole text: the clean texts' are those most easily taken for toxic."""
    rng, y = np.random.default_rng(plan.seed + 1), np.array(labels, dtype=np.float32)
    for _ in range(plan.tuning):
        _epoch(net, worst, y, rng.permutation(len(worst)), plan, 0.3 * plan.rate)


def _calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one input, by Newton steps, with a weak pull to 1 and 0."""
    ab, pull, prior = np.array([1.0, 0.0]), 1.0, np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(30):
        p = _sigmoid(x @ ab)
        g = x.T @ (weight * (p - y)) + pull * (ab - prior)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(h, g), -2, 2)
    return max(0.1, float(ab[0])), float(ab[1])


def _spread(text: str, most: int) -> list[str]:
    """At most `most` windows of the whole text, the same distance apart."""
    words = text.encode().split()
    last = max(0, len(words) - WINDOW)
    n = min(most, last // STRIDE + 1 + (last % STRIDE > 0))
    starts = sorted({round(i * last / max(1, n - 1)) for i in range(n)})
    return [b" ".join(words[s : s + WINDOW]).decode() for s in starts]


def train(docs: DataFrame, labels: DataFrame, plan: Plan | None = None) -> Network:
    """A network fitted on the bounded sample of labelled training rows that `plan` describes."""
    plan = plan or Plan()
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {0: 0, 1: 0} | {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    pick = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, plan.positives), (0, plan.negatives))]
    sample = pick[0].unionByName(pick[1])

    @F.udf("array<string>")
    def spread(text):
        return _spread(text, plan.windows)

    # one row of each sampled id, chosen before anything is collected; the texts are read once
    joined = texts(docs).select("doc_id", "row_key", "text").join(F.broadcast(sample), "doc_id")
    inputs = saved(joined.groupBy("doc_id", "toxic").agg(F.min("row_key").alias("row_key"), F.min_by("text", "row_key").alias("text")), "sample")

    def collected(df: DataFrame) -> list:
        return sorted(df.collect(), key=lambda r: r.doc_id)

    rows = collected(inputs.select("doc_id", "toxic", spread("text").alias("windows")))
    net = fit([r.windows for r in rows], [r.toxic for r in rows], plan)
    if net.constant is None:
        rows = collected(_worst(inputs, net))
        tune(net, [r.window for r in rows], [r.toxic for r in rows], plan)
        rows = collected(_worst(inputs, net))
        y = np.array([r.toxic for r in rows])
        # a sampled row stands for as many labelled rows of its kind as the sample left out
        share = np.array([totals[k] / max(1, (y == k).sum()) for k in (0, 1)])
        net.slope, net.shift = _calibrated(np.array([r.logit for r in rows]), y.astype(float), share[y])
    net.seen = {}
    del rows
    freed()
    return net


def freed() -> None:
    """Gives what the fit has freed back to the system, where the C library can: the driver has other work to do."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _worst(inputs: DataFrame, net: Network) -> DataFrame:
    """doc_id, row_key, toxic, logit and window (the words of the window with that logit) of sampled rows, texts read whole."""
    shared = inputs.sparkSession.sparkContext.broadcast(Network(net.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            logits, found = [], []
            for _, _, w in slices(b.column("text"), 1 << 18):
                z, nth = own.worst_windows(w)
                logits += z.tolist()
                for d, k in enumerate(nth):
                    i, j = w.first[d] + k * STRIDE, min(w.first[d + 1], w.first[d] + k * STRIDE + WINDOW)
                    found.append(bytes(w.buf[w.start[i] : w.end[j - 1]]).decode() if i < j else "")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), b.column("toxic"), pa.array(logits, pa.float64()), pa.array(found, pa.string())], names=["doc_id", "row_key", "toxic", "logit", "window"])

    return inputs.select("doc_id", "row_key", "toxic", "text").mapInArrow(run, "doc_id bigint, row_key bigint, toxic int, logit double, window string")


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row_key, score and predicted of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            out = [own.scores(w) for _, _, w in slices(b.column("text"), 1 << 18)]
            s = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "row_key", "score", "predicted"])

    return texts(docs).select("doc_id", "row_key", "text").mapInArrow(run, "doc_id bigint, row_key bigint, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, plan: Plan | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    found = score(docs, train(docs, labels, plan), threshold)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, plan: Plan | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score `threshold` or more, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, plan))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            out = [own.scores(w) for _, _, w in slices(b.column("text"), 1 << 18)]
            yield b.filter(pa.array(np.concatenate(out) < threshold)) if out else b

    return docs.mapInArrow(run, docs.schema)
