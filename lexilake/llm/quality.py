"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features describe its bytes, its words and its repetition, and those of the
lines before and after it.  The chain's weights are learned on a bounded sample of labelled documents, whose
lines take the label of their document; forward-backward gives each line's marginal probability of being
good.  Marginals, weighted by line length, make the document's quality, which is calibrated on sampled
documents that did not set the weights.

Both passes run over all documents of a batch at once, line number by line number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexilake.llm.hashing import U, mix, text_bytes, word_hashes
from lexilake.llm.labelled import apply_logistic, logistic, sample
from lexilake.llm.shared import keep_rows, map_rows

SAMPLE_DOCUMENTS = 4_000
STEPS = 150
RIDGE = 1e-3
#: Marginals are smoothed by this many characters of an even line.
EVEN_CHARACTERS = 1.0

_CLASSES = np.full(256, 7, dtype=np.uint8)
for _kind, _bytes in enumerate((
        range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), [0x20, *range(0x09, 0x0E)], b".,", b"!?;:'\"-()",
        range(0x80, 0x100))):
    _CLASSES[list(_bytes)] = _kind
_KINDS = 8
N_FEATURES = 17


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (a row per line), lengths in bytes, and the n + 1 positions where each text's lines begin.

    Lines end at line feeds, so one at the end of a text begins an empty line; an empty text is one empty line.
    """
    data, offsets = text_bytes(texts)
    n_texts = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    breaks = np.concatenate([offsets[:-1], feeds + 1])
    # By text, then place: what follows a text's last line feed is its own empty line, though the next text starts there.
    order = np.lexsort((breaks, np.concatenate([np.arange(n_texts), np.searchsorted(offsets, feeds, "right") - 1])))
    start = breaks[order]
    first_line = np.flatnonzero(order < n_texts)
    at = np.append(first_line, len(start))
    end = np.append(start[1:], len(data))
    cut = np.zeros(len(start), dtype=bool)
    cut[:-1] = (start[1:] > start[:-1]) & (order[1:] >= n_texts)
    length = end - start - cut
    lines = len(start)
    size = np.maximum(length, 1).astype(float)
    line_of = np.repeat(np.arange(lines), end - start)
    kinds = np.bincount(line_of * _KINDS + _CLASSES[data], minlength=lines * _KINDS).reshape(lines, _KINDS).astype(float)
    kinds[:, 3] -= cut
    hashes, word_at = word_hashes(data, np.append(start, len(data)))
    words = np.diff(word_at)
    same = np.zeros(len(hashes) + 1)
    near = np.zeros(len(hashes) + 1)
    if len(hashes) > 2:
        inside = np.ones(len(hashes), dtype=bool)
        inside[word_at[:-1][words > 0]] = False
        repeat = np.zeros(len(hashes), dtype=bool)
        repeat[1:] = (hashes[1:] == hashes[:-1]) & inside[1:]
        again = repeat.copy()
        again[2:] |= (hashes[2:] == hashes[:-2]) & inside[2:] & inside[1:-1]
        np.cumsum(repeat, out=same[1:])
        np.cumsum(again, out=near[1:])
    some = np.maximum(words, 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes, out=sums[1:])
    text_of = np.repeat(np.arange(n_texts), np.diff(at))
    whole = mix((sums[word_at[1:]] - sums[word_at[:-1]]) ^ mix(text_of.astype(np.uint64) + U(1)))
    _, inverse, copies = np.unique(whole, return_inverse=True, return_counts=True)
    lasts = np.where(length > 0, data[np.maximum(start + length - 1, 0)] if len(data) else 0, 0)
    firsts = np.where(length > 0, data[np.minimum(start, max(0, len(data) - 1))] if len(data) else 0, 0)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 6], 1)
    features = np.column_stack([
        np.log1p(length) / 5, np.log1p(words) / 4, np.minimum(size / some, 40) / 10,
        kinds / size[:, None] * np.array([1, 4, 4, 2, 6, 6, 1, 6]),
        np.minimum(kinds[:, 7] / some, 4), (same[word_at[1:]] - same[word_at[:-1]]) / some,
        (near[word_at[1:]] - near[word_at[:-1]]) / some, np.isin(lasts, list(b".!?")).astype(float),
        ((_CLASSES[firsts] == 1) & (length > 0)).astype(float),
        np.minimum(np.log(copies[inverse]), 4) / 2 + kinds[:, 1] / letters])
    return features, length, at


def with_neighbours(features: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after, and whether there is none."""
    n = len(features)
    before, after = np.zeros((n, features.shape[1] + 1)), np.zeros((n, features.shape[1] + 1))
    before[1:, :-1], after[:-1, :-1] = features[:-1], features[1:]
    first, last = at[:-1], at[1:] - 1
    before[first, :-1], after[last, :-1] = 0, 0
    before[first, -1], after[last, -1] = 1, 1
    return np.column_stack([features, before, after, np.ones(n)])


class Chains:
    """The lines of a batch by line number: all first lines, then all second lines, of texts that have them."""

    def __init__(self, at: np.ndarray) -> None:
        counts = np.diff(at)
        order = np.argsort(-counts, kind="stable")
        self.first = at[:-1][order]
        ascending = counts[order][::-1]
        self.active = [len(counts) - int(np.searchsorted(ascending, t, "right")) for t in range(int(counts.max(initial=0)))]

    def marginals(self, odds: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, expected pair counts, and the log of the partition function."""
        n, steps = len(odds), len(self.active)
        forward = np.zeros((n, 2))
        scale = np.zeros(n)
        local = np.exp(np.column_stack([-odds / 2, odds / 2]))
        move = np.exp(pair)
        for t in range(steps):
            rows = self.first[:self.active[t]] + t
            f = local[rows] if t == 0 else (forward[rows - 1] @ move) * local[rows]
            s = f.sum(axis=1)
            forward[rows], scale[rows] = f / s[:, None], s
        backward = np.ones((n, 2))
        expected = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            rows = self.first[:self.active[t + 1]] + t
            following = local[rows + 1] * backward[rows + 1] / scale[rows + 1, None]
            backward[rows] = following @ move.T
            expected += (forward[rows].T @ following) * move
        both = forward * backward
        return both[:, 1] / both.sum(axis=1), expected, float(np.log(scale).sum())


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    calibration: np.ndarray

    def lines(self, features: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The marginal probability of each line being good."""
        x = with_neighbours((features - self.mean) / self.spread, at)
        return Chains(at).marginals(np.clip(x @ self.weights, -30, 30), self.pair)[0]

    def inputs(self, features: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What a document's quality is calibrated from: the length-weighted mean marginal, as log-odds, and size."""
        good = self.lines(features, at)
        weight = np.add.reduceat(length, at[:-1]) + EVEN_CHARACTERS
        mean = (np.add.reduceat(length * good, at[:-1]) + EVEN_CHARACTERS / 2) / weight
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.column_stack([np.log(mean / (1 - mean)), np.log1p(weight) / 5])


def fit_chain(features: np.ndarray, at: np.ndarray, good: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, ...]:
    """Weights, pair weights, feature means and spreads, by gradient ascent on the conditional likelihood."""
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-3
    x = with_neighbours((features - mean) / spread, at)
    chains, n = Chains(at), len(x)
    starts = np.zeros(n, dtype=bool)
    starts[at[:-1]] = True
    pairs_seen = np.zeros((2, 2))
    np.add.at(pairs_seen, (good[:-1][~starts[1:]].astype(int), good[1:][~starts[1:]].astype(int)), 1)
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, pair = theta[:-4], theta[-4:].reshape(2, 2)
        p, expected, _ = chains.marginals(np.clip(x @ w, -30, 30), pair)
        gradient = np.concatenate([x.T @ (good - p) / n, ((pairs_seen - expected) / n).ravel()]) - RIDGE * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        theta = theta + 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2), mean, spread


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE_DOCUMENTS,
          folds: int = 5, held_out: int = 0) -> Model:
    """Learn from about ``bound`` labelled documents outside the held-out fold; tasks make the features.

    Two thirds set the chain's weights, the rest calibrates.  With no labels every document scores one half.
    """
    rows = sample(docs, labels, label, bound, folds, held_out)

    def make():
        def run(b: pa.RecordBatch) -> dict:
            features, length, at = line_features(b.column(1))
            return {"id": b.column(0), "label": b.column(2), "n": np.diff(at),
                    "features": [features[s:e].astype(np.float32).tobytes() for s, e in zip(at, at[1:])],
                    "length": [length[s:e].astype(np.int64).tobytes() for s, e in zip(at, at[1:])]}

        return run

    found = map_rows(rows.select("id", "text", "label"), make,
                     "id long, label int, n long, features binary, length binary", "text").toPandas().sort_values("id")
    if not len(found):
        return Model(np.zeros(3 * N_FEATURES + 3), np.zeros((2, 2)), np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(3))
    to_fit = (mix(found["id"].to_numpy(np.int64).view(np.uint64)) % U(3)).astype(int) > 0
    to_fit = np.ones(len(found), dtype=bool) if to_fit.all() or not to_fit.any() else to_fit

    def gathered(part):
        n = part["n"].to_numpy(np.int64)
        return (np.frombuffer(b"".join(part["features"]), np.float32).reshape(-1, N_FEATURES).astype(float),
                np.frombuffer(b"".join(part["length"]), np.int64), np.concatenate([[0], np.cumsum(n)]),
                part["label"].to_numpy(float))

    features, _, at, good = gathered(found[to_fit])
    model = Model(*fit_chain(features, at, np.repeat(good, np.diff(at))), np.zeros(3))
    rest = found[~to_fit] if (~to_fit).any() else found
    features, length, at, good = gathered(rest)
    model.calibration = logistic(model.inputs(features, length, at), good)
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, n_lines, bad_lines): the probability that a document is good.

    Null and empty texts are one empty line and score as such; repeated rows and null keys are scored row by
    row; columns besides key and text are not read.
    """
    def make():
        def run(b: pa.RecordBatch) -> dict:
            features, length, at = line_features(b.column(1))
            bad = np.concatenate([[0], np.cumsum(model.lines(features, at) < 0.5)])
            return {key: b.column(0), "score": apply_logistic(model.inputs(features, length, at), model.calibration),
                    "n_lines": np.diff(at), "bad_lines": bad[at[1:]] - bad[at[:-1]]}

        return run

    return map_rows(docs.select(key, text), make,
                    f"{key} {docs.schema[key].dataType.simpleString()}, score double, n_lines long, bad_lines long", text)


def keep_documents(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows, with all their columns, of documents that are good with at least the probability ``least``."""
    at = docs.columns.index(text)

    def make():
        return lambda b: apply_logistic(model.inputs(*line_features(b.column(at))), model.calibration) >= least

    return keep_rows(docs, make, text)
