"""Quality by a linear-chain conditional random field over a document's lines.

Every line is good or bad.  Its features are those of the line and of its two neighbours; transitions tie neighbouring
labels.  Forward and backward passes give each line's marginal, and the length-weighted mean of the lines' marginals,
mapped by one fitted curve, is the document's score.

Labels are of documents.  Lines of good documents are good; lines of bad documents start as bad, and after a first fit
those that the model takes for good are relabelled, for a bad document may hold good lines.  Training takes at most
TRAIN_DOCUMENTS labelled documents (chosen by a hash of the id, outside the held-out fold), so it fits on the driver.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import documents, map_slices, slices

#: Bound of the labelled sample.
TRAIN_DOCUMENTS = 1_500
FOLDS, HELD_OUT = 4, 2
PREDICT_AT = 0.7
SYMBOLS = re.compile(r"[#*$%&|<>]")
RATIOS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)
STEPS, TURNS = 120, 2
#: Lines whose features are held at once in scoring.
LINES = 1 << 14


def line_values(line: str) -> list[float]:
    """Plain measurements of one line, each in 0 to 1 but for the logarithms."""
    n = len(line)
    words = line.split()
    k = len(words)
    if not k:
        return [0.0] * 11 + [1.0]
    letters = sum(map(len, words))
    same = sum(map(str.__eq__, words, words[1:]))
    symbols = len(SYMBOLS.findall(line))
    marked = sum(not w[-1].isalnum() for w in words)
    shouted = sum(w.isupper() and len(w) > 1 for w in words)
    digits = sum(w[0].isdigit() for w in words)
    return [
        math.log1p(n) / 8, math.log1p(k) / 6, letters / k / 20, symbols / n * 5, marked / k, shouted / k, digits / k, same / k, 1 - len(set(words)) / k,
        float(line[0].isupper()), float(words[-1][-1] in ".!?"), 0.0,
    ]


BINNED = (3, 4, 5, 6, 7, 8)
OWN = 12 + len(BINNED) * len(RATIOS)


def line_features(lines: list[str]) -> np.ndarray:
    values = np.array([line_values(x) for x in lines], np.float32)
    bins = [(values[:, c : c + 1] > np.array(RATIOS, np.float32)).astype(np.float32) for c in BINNED]
    return np.concatenate([values, *bins], 1)


def chained(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features with those of the line before and after in the same document (zeros at its ends), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[starts] = 0
    after[starts[starts > 0] - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], 1)


class Crf:
    """Two labels: a line's score for label 1 (good) is x . w against 0; t[a, b] is added from label a to b."""

    def __init__(self, width: int):
        self.w, self.t = np.zeros(width), np.zeros((2, 2))

    def marginals(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line, the sums of pairwise marginals, and each document's log of the normaliser.

        All documents advance together, the longest first, one position a step; messages are normalised."""
        order = np.argsort(-lengths, kind="stable")
        at, size = starts[order], lengths[order]
        n, longest = len(order), int(size[0]) if len(size) else 0
        e = np.exp(self.t)
        shift = np.maximum(scores, 0)
        unary = np.stack([np.exp(-shift), np.exp(scores - shift)], 1)
        fwd, bwd, norm, log_z = np.empty((len(scores), 2)), np.ones((len(scores), 2)), np.empty(len(scores)), np.zeros(n)
        active = [int(np.searchsorted(-size, -p, "left")) for p in range(longest + 1)]
        for p in range(longest):
            k = active[p]
            i = at[:k] + p
            a = unary[i] if not p else (fwd[i - 1] @ e) * unary[i]
            norm[i] = z = a.sum(1)
            fwd[i] = a / z[:, None]
            log_z[:k] += np.log(z) + shift[i]
        pair = np.zeros((2, 2))
        for p in range(longest - 2, -1, -1):
            k = active[p + 1]
            i = at[:k] + p
            b = unary[i + 1] * bwd[i + 1] / norm[i + 1][:, None]
            bwd[i] = b @ e.T
            pair += e * (fwd[i].T @ b)
        both = fwd * bwd
        out = np.empty(n)
        out[order] = log_z
        return both[:, 1] / both.sum(1), pair, out

    def fit(self, x: np.ndarray, y: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weight: np.ndarray, steps: int = STEPS, l2: float = 1e-3) -> None:
        """Adam on the mean log-likelihood; ``weight`` balances the lines of the two labels in the unary part."""
        inner = np.ones(len(y), bool)
        inner[starts] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
        total = weight.sum()
        theta = np.concatenate([self.w, self.t.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            self.w, self.t = theta[:-4], theta[-4:].reshape(2, 2)
            p, pair, _ = self.marginals(x @ self.w, starts, lengths)
            g = np.concatenate([x.T @ (weight * (y - p)) / total - l2 * self.w, ((seen - pair) / max(len(y), 1) - l2 * self.t).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        self.w, self.t = theta[:-4], theta[-4:].reshape(2, 2)


def line_scores(lines: list[str], starts: np.ndarray, w: np.ndarray, most: int = LINES) -> np.ndarray:
    """Each line's score for label 1, features times ``w``, in blocks that see the line before and the one after."""
    out = np.empty(len(lines))
    for at in range(0, len(lines), most):
        a, b = max(0, at - 1), min(len(lines), at + most + 1)
        inside = starts[(starts >= a) & (starts < b)] - a
        out[at : at + most] = (chained(line_features(lines[a:b]), inside) @ w)[at - a : at - a + most]
    return out


def featured(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chained features of all lines, each document's first line and number of lines, and the lines' lengths.  An empty
    text is one empty line."""
    split = [x.split("\n") for x in texts]
    lengths = np.array([len(x) for x in split], np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = [line for x in split for line in x]
    return chained(line_features(flat), starts), starts, lengths, np.array([len(x) + 1 for x in flat], np.float64)


def document_means(p: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.add.reduceat(p * size, starts) / np.add.reduceat(size, starts)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Model:
    """A fitted field and the curve from a document's mean marginal to its score."""

    def __init__(self, crf: Crf | None, a: float, b: float):
        self.crf, self.a, self.b = crf, a, b

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.crf is None:
            return np.full(len(texts), self.b)
        split = [x.split("\n") for x in texts]
        lengths = np.array([len(x) for x in split], np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = [line for x in split for line in x]
        size = np.array([len(x) + 1 for x in flat], np.float64)
        p, _, _ = self.crf.marginals(line_scores(flat, starts, self.crf.w), starts, lengths)
        return 1 / (1 + np.exp(-(self.a * _logit(document_means(p, starts, size)) + self.b)))


def train(texts: list[str], labels: list[int]) -> Model:
    """With labels of one kind only, every score is the (smoothed) share of label 1."""
    if len(set(labels)) < 2:
        return Model(None, 0.0, (sum(labels) + 1) / (len(labels) + 2))
    x, starts, lengths, size = featured(texts)
    good = np.array(labels)
    y = np.repeat(good, lengths)
    crf = Crf(x.shape[1])
    for turn in range(TURNS):
        weight = size.clip(1, 400) ** 0.5
        for label in (0, 1):
            weight[y == label] *= 0.5 * weight.sum() / max(weight[y == label].sum(), 1e-9)
        crf = Crf(x.shape[1])
        crf.fit(x, y, starts, lengths, weight)
        if turn < TURNS - 1:
            p, _, _ = crf.marginals(x @ crf.w, starts, lengths)
            y = np.where(np.repeat(good, lengths) == 1, 1, (p > 0.5).astype(int))
            # A bad document keeps a bad line: its worst.
            worst = np.minimum.reduceat(p, starts)
            y[(np.repeat(good, lengths) == 0) & (p <= np.repeat(worst, lengths))] = 0
    p, _, _ = crf.marginals(x @ crf.w, starts, lengths)
    z = _logit(document_means(p, starts, size))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit with a little ridge
        q = 1 / (1 + np.exp(-(a * z + b)))
        s = q * (1 - q) + 1e-9
        g = np.array([((good - q) * z).sum() - 0.1 * (a - 1), (good - q).sum() - 0.1 * b])
        h = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return Model(crf, float(max(a, 0.05)), float(b))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_sample(df: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> list[tuple[str, int]]:
    """At most ``most`` labelled texts of the training folds, the first by a hash of the id; one row an id."""
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents(df).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    return [(r["text"], r["quality"]) for r in rows.orderBy("doc_id").collect()]


def keep_good(df: DataFrame, labelled: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """The rows of ``df`` (all its columns) whose score is at least PREDICT_AT; trained on texts of ``labelled``."""
    sample = training_sample(labelled, labels, most)
    model = train([t for t, _ in sample], [q for _, q in sample])

    def run(batches):
        for part in slices(batches, "text"):
            yield part.filter(pa.array(model([x or "" for x in part.column("text").to_pylist()]) >= PREDICT_AT))

    return df.mapInArrow(run, df.schema)


def quality_scores(df: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by its text alone.

    A null or empty text is one empty line and has its score.  A null doc_id is never held out.  Equal rows each give a
    row; other columns are not read.  Without labels of both kinds all scores are equal.
    """
    sample = training_sample(df, labels, most)
    model = train([t for t, _ in sample], [q for _, q in sample])

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "score": pa.array(model(part.column("text").to_pylist()), pa.float64())})

        return step

    scored = map_slices(documents(df, id_col, text_col), "text", "doc_id long, score double", work)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
