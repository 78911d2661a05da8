"""Toxic passages by maximum-scoring segments of token log-odds.

Learning, on a bounded sample of labelled documents: for tokens and their prefixes of 4, 5 and 6 bytes, the
log-odds of occurring in toxic rather than other documents, under a Dirichlet prior in proportion to how
often the feature occurs at all, so rare ones shrink to nothing.  A token scores the log-odds of its most
specific significant feature less a drift, so ordinary text has negative sums.

Scoring: one linear scan finds all maximal segments of positive score (every toxic passage, disjoint and
in order).  In ordinary text of n tokens the best segment exceeds x with probability 1 - exp(-K n exp(-L x));
L solves the moment equation of the token scores of clean documents, K is its maximum-likelihood estimate
there.  Passages with expected count below a bound are significant; evidence, in natural-log units of that
count, is calibrated to a probability on sampled documents that did not set the log-odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.llm.hashing import U, Spans, mix, text_bytes, words_in
from lexilake.llm.labelled import apply_logistic, logistic, sample
from lexilake.llm.shared import keep_rows, map_rows

SAMPLE_DOCUMENTS = 12_000
PREFIXES = (0, 6, 5, 4)
PRIOR_SHARE = 0.1
SIGNIFICANT = 3.0
DRIFT = 0.25
TOP_SCORE = 6.0
EXPECTED = 0.05

_WORD = np.zeros(256, dtype=bool)
for _range in (range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100)):
    _WORD[list(_range)] = True


def tokens(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes (a row of arrays, most specific first), token starts, ends and each text's first token.

    A token is a run of letters, digits and non-ASCII bytes.  Prefixes of tokens too short are the token.
    """
    data, offsets = text_bytes(texts)
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return [none.view(np.uint64)] * len(PREFIXES), none, none, np.zeros(len(offsets), dtype=np.int64)
    start, end = words_in(data, offsets, _WORD[data])
    spans = Spans(data)
    features = [spans.hash(start, np.minimum(end, start + n) if n else end) ^ mix(np.array([n + 1], dtype=np.uint64))
                for n in PREFIXES]
    return features, start - offsets[np.searchsorted(offsets, start, "right") - 1], end - start, np.searchsorted(start, offsets)


@dataclass
class Model:
    hashes: np.ndarray
    odds: np.ndarray
    decay: float = 1.0
    k: float = 0.1
    weights: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.hashes >> U(44)).astype(np.int64)] = True

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        """Log-odds less the drift of each token."""
        out = np.full(len(features[0]), -DRIFT)
        if not len(self.hashes):
            return out
        for level in reversed(features):
            maybe = np.flatnonzero(self.seen[(level >> U(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, level[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == level[maybe]
            out[maybe[hit]] = self.odds[at[hit]] - DRIFT
        return out

    def evidence(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Minus the log of the expected number of segments that score as much in n tokens of clean text."""
        return self.decay * score - np.log(self.k * np.maximum(n, 1))


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end) of a score sequence, in one linear scan.

    Candidates on the stack hold the sum before them and the sum at their end.  A new positive token joins the
    stack from the nearest candidate whose start sum is lower, if that one's end sum is lower too.
    """
    positive = np.flatnonzero(scores > 0)
    sums = np.cumsum(scores)
    stack: list[tuple[float, float, int, int, int]] = []
    for i in positive.tolist():
        left, right, start = float(sums[i] - scores[i]), float(sums[i]), i
        at = len(stack) - 1
        while True:
            while at >= 0 and stack[at][0] >= left:
                at = stack[at][4]
            if at < 0 or stack[at][1] >= right:
                stack.append((left, right, start, i + 1, at))
                break
            left, start = stack[at][0], stack[at][2]
            del stack[at:]
            at = len(stack) - 1
    return [(b - a, s, e) for a, b, s, e, _ in stack]


def _count_features(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents with each feature, summed in tasks first."""
    def make():
        def run(b: pa.RecordBatch) -> dict:
            features, _, _, at = tokens(b.column(0))
            toxic = np.array(b.column(1).to_pylist(), dtype=bool)
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            found, counts = [], []
            for level in features:
                order = np.lexsort((doc, level))
                f, d = level[order], doc[order]
                new = np.ones(len(f), dtype=bool)
                new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
                f, t = f[new], toxic[d[new]]
                kinds, first = np.unique(f, return_index=True)
                if len(kinds):
                    found.append(kinds)
                    counts.append(np.column_stack([np.add.reduceat(t, first, dtype=np.int64),
                                                   np.add.reduceat(~t, first, dtype=np.int64)]))
            if not found:
                return {"feature": [], "toxic": [], "clean": []}
            both = np.concatenate(counts)
            return {"feature": np.concatenate(found).view(np.int64), "toxic": both[:, 0], "clean": both[:, 1]}

        return run

    counted = map_rows(rows.select("text", "label"), make, "feature long, toxic long, clean long", "text")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def scan(texts: pa.Array, model: Model) -> dict:
    """Per text: tokens, best score, total evidence, positive tokens and their sum, significant passages."""
    features, start, length, at = tokens(texts)
    scores = model.scores(features)
    n = np.diff(at)
    positive = np.concatenate([[0], np.cumsum(scores > 0)])
    hits = positive[at[1:]] - positive[at[:-1]]
    best, total, sums, found = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n)), [[] for _ in n]
    for d in np.flatnonzero(hits).tolist():
        a, z = at[d], at[d + 1]
        own = scores[a:z]
        sums[d] = own[own > 0].sum()
        for score, s, e in segments(own):
            evidence = float(model.evidence(np.float64(score), np.float64(z - a)))
            best[d] = max(best[d], score)
            if evidence > -np.log(EXPECTED):
                total[d] += evidence
                first = int(start[a + s])
                found[d].append({"start": first, "length": int(start[a + e - 1] + length[a + e - 1]) - first,
                                 "score": score, "expected": float(np.exp(-evidence))})
    return {"n_tokens": n, "best": best, "total": total, "n_positive": hits, "positive_sum": sums, "passages": found}


def passages(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document: key, n_tokens, best score, total evidence, positive tokens, their sum, passages.

    A passage has its byte offset and length in the text, its score and its expected count in clean text.
    """
    kind = docs.schema[key].dataType.simpleString()
    ddl = (f"{key} {kind}, n_tokens long, best double, total double, n_positive long, positive_sum double, "
           "passages array<struct<start:long,length:long,score:double,expected:double>>")
    return map_rows(docs.select(key, text), lambda: lambda b: {key: b.column(0), **scan(b.column(1), model)}, ddl, text)


def _inputs(model: Model, n: np.ndarray, best: np.ndarray, total: np.ndarray) -> np.ndarray:
    has = best > 0
    return np.column_stack([has, np.where(has, np.clip(model.evidence(best, n), -10, 20) / 5, 0.0), np.log1p(total)])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE_DOCUMENTS,
          folds: int = 4, held_out: int = 2) -> Model:
    """Learn from about ``bound`` labelled documents outside the held-out fold.

    Three quarters set the log-odds; the rest, and the clean documents in it, set L, K and the calibration.
    With no labels of one kind nothing is toxic.
    """
    rows = sample(docs, labels, label, bound, folds, held_out)
    for_odds = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) > 0
    sizes = {r["label"]: r["n"] for r in rows.filter(for_odds).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic_n, clean_n = sizes.get(1, 0), sizes.get(0, 0)
    # Only features of several toxic documents can be significant; the filter keeps what comes back small.
    counted = _count_features(rows.filter(for_odds)).filter("toxic >= 3 AND toxic * {} > clean * {}".format(
        max(1, clean_n), max(1, toxic_n))).toPandas()
    y1, y0 = counted["toxic"].to_numpy(float), counted["clean"].to_numpy(float)
    prior = PRIOR_SHARE * (y1 + y0)
    a1, a0 = PRIOR_SHARE * max(1, toxic_n), PRIOR_SHARE * max(1, clean_n)
    p1, p0 = prior * a1 / (a1 + a0), prior * a0 / (a1 + a0)
    odds = np.log((y1 + p1) / (toxic_n + a1)) - np.log((y0 + p0) / (clean_n + a0)) if len(y1) else y1
    spread = np.sqrt(1 / (y1 + p1) + 1 / (y0 + p0)) if len(y1) else y1
    keep = odds > np.maximum(SIGNIFICANT * spread, 1.0) if len(y1) else np.zeros(0, dtype=bool)
    hashes = counted["feature"].to_numpy(np.int64)[keep].view(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], np.minimum(odds[keep][order], TOP_SCORE))
    found = passages(rows.filter(~for_odds), model, key="id").join(rows.select("id", "label").distinct(), "id").select(
        "label", "n_tokens", "best", "total", "n_positive", "positive_sum").toPandas()
    clean = found[found["label"] == 0]
    n = max(1.0, float(clean["n_tokens"].sum()))
    hits = float(clean["n_positive"].sum()) + 0.5
    mean = (float(clean["positive_sum"].sum()) + 0.5 * TOP_SCORE / 2) / hits
    low, high = 1e-3, 50.0
    for _ in range(100):
        middle = (low + high) / 2
        moment = hits / n * np.exp(min(600.0, middle * mean)) + (1 - min(0.5, hits / n)) * np.exp(-middle * DRIFT)
        low, high = (middle, high) if moment < 1 else (low, middle)
    model.decay = (low + high) / 2
    if len(clean):
        model.k = min(1.0, max(1e-6, len(clean) / max(1e-9, float((clean["n_tokens"].clip(lower=1) * np.exp(
            -model.decay * clean["best"])).sum()))))
    again = passages(rows.filter(~for_odds), model, key="id").join(rows.select("id", "label").distinct(), "id").select(
        "label", "n_tokens", "best", "total").toPandas()
    x = _inputs(model, again["n_tokens"].to_numpy(float), again["best"].to_numpy(), again["total"].to_numpy())
    model.weights = logistic(x, again["label"].to_numpy(float)) if len(x) else np.array([0, 0, 0, -6.0])
    return model


def probabilities(found: dict, model: Model) -> np.ndarray:
    return apply_logistic(_inputs(model, found["n_tokens"], found["best"], found["total"]), model.weights)


def score_documents(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, n_passages): the calibrated probability that a document is toxic.

    Null and empty texts have no tokens and score as a document without any hit; repeated rows and null keys
    are scored row by row; columns besides key and text are not read.
    """
    def run(b: pa.RecordBatch) -> dict:
        found = scan(b.column(1), model)
        return {key: b.column(0), "score": probabilities(found, model), "n_passages": list(map(len, found["passages"]))}

    return map_rows(docs.select(key, text), lambda: run,
                    f"{key} {docs.schema[key].dataType.simpleString()}, score double, n_passages long", text)


def keep_documents(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows, with all their columns, of documents that are toxic with less than the probability ``least``."""
    at = docs.columns.index(text)
    return keep_rows(docs, lambda: lambda b: probabilities(scan(b.column(at), model), model) < least, text)
