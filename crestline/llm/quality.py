"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's potential comes from features of its own and of the lines
before and after it, pairs of neighbouring labels have potentials of their own, and forward-backward
gives each line's probability of being good. A document's quality is the mean of these, weighted by the
lines' lengths; a logistic curve fitted on labelled documents turns it into the score.

Labels are of documents. The field is fitted in two steps on a bounded sample (SAMPLE documents of at
most FIT_LINES lines): a regression of the documents' labels on lines; then lines of bad documents that
it holds for good, and the other way round, take those labels (unless all of a document would), so that
labels change within documents, and the field's likelihood is maximised on them.

Cases: lines are cut at line feeds, blank ones do not count. Null, empty and blank texts have no lines and
score the share of good labels. Without labels of both classes fixed weights hold (PLAIN). A doc_id with
several labels is good if one says so; rows with one doc_id are documents of their own when scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.fitting import labelled_sample, logistic

#: Labelled documents of each class that the fit may use at most, and the lines that each may have for it.
SAMPLE, FIT_LINES = {1: 8_000, 0: 4_000}, 256
#: Characters of text whose lines are held at a time (at least a document).
SLICE = 1_000_000
#: Steps of the ascent, its rate, and the ridge on all weights of the field.
STEPS, RATE, RIDGE = 150, 0.05, 0.02

_ALL = bytes(range(256))
_LETTERS = bytes(b for b in _ALL if b > 0x7F or chr(b).isalpha())
_NOT_UPPER = bytes(b for b in _ALL if not 65 <= b <= 90)
_NOT_DIGITS = bytes(b for b in _ALL if not 48 <= b <= 57)
#: What prose has besides letters and digits.
_USUAL = b" \t\r.,;:'\"()-?"
NAMES = ("letters", "upper", "digits", "odd", "words", "word_length", "pair_repeats", "word_repeats", "doubled", "seen", "sentence_end", "short")
K = len(NAMES)
#: Weights of a line's own features (after the intercept) that hold without labels: marks that prose lacks, capitals, repeats.
PLAIN = dict(odd=-40.0, upper=-6.0, pair_repeats=-6.0, doubled=-10.0, seen=-1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lines_of(text: str | None) -> list[str]:
    return [x for x in text.split("\n") if x and not x.isspace()] if text else []


def line_features(lines: list[str]) -> np.ndarray:
    """NAMES of each line of one document."""
    out, seen = np.zeros((len(lines), K)), set()
    for i, line in enumerate(lines):
        raw, words = line.encode(), line.split()
        n, k = len(raw), len(words)
        rest = raw.translate(None, _LETTERS)
        letters, upper, digits = n - len(rest), len(raw.translate(None, _NOT_UPPER)), len(rest.translate(None, _NOT_DIGITS))
        odd = len(rest.translate(None, _USUAL)) - digits
        pairs = max(1, k - 1)
        out[i] = (
            letters / n, upper / max(1, letters), digits / n, odd / n, math.log1p(k) / 5, min(3.0, letters / k / 10),
            1 - len(set(zip(words, words[1:], strict=False))) / pairs if k > 1 else 0.0, 1 - len(set(words)) / k, sum(map(eq, words, words[1:])) / pairs,
            line in seen, raw.rstrip()[-1:] in b".?", k < 4,
        )
        seen.add(line)
    return out


class Chains:
    """Lines of documents that stand one after another in arrays: sums over all labellings by forward-backward, in log odds of good to bad."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")  # longest first: those with a line at a place are a beginning
        self.sizes, self.first = sizes, (np.cumsum(sizes) - sizes)[order]
        self.having = len(sizes) - np.cumsum(np.bincount(sizes, minlength=1))[:-1] if len(sizes) else np.zeros(0, int)

    def messages(self, own: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each line from all up to it (its own included), and from all after it. pair[i, j]: of label j after i."""
        up, down = own.copy(), np.zeros(len(own))
        (bb, bg), (gb, gg) = pair
        for place in range(1, len(self.having)):
            rows = self.first[: self.having[place]] + place
            before = up[rows - 1]
            up[rows] += np.logaddexp(bg, gg + before) - np.logaddexp(bb, gb + before)
        for place in range(len(self.having) - 2, -1, -1):
            rows = self.first[: self.having[place + 1]] + place
            after = own[rows + 1] + down[rows + 1]
            down[rows] = np.logaddexp(gb, gg + after) - np.logaddexp(bb, bg + after)
        return up, down

    def pairs(self) -> np.ndarray:
        """The lines that another line of their document follows."""
        last = np.cumsum(self.sizes)[self.sizes > 0] - 1
        return np.setdiff1d(np.arange(int(self.sizes.sum())), last)


@dataclass
class Model:
    """The field and the curve: how features are scaled; weights of those of the line before, the line and the line after; an intercept; pair potentials; curve; score without lines."""

    middle: np.ndarray
    spread: np.ndarray
    near: np.ndarray
    intercept: float
    pair: np.ndarray
    curve: np.ndarray
    none: float

    def own(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each line's potential for good; a neighbour that is not there is an average one."""
        before, own, after = ((features - self.middle) / self.spread @ w for w in self.near)
        out = own + self.intercept
        inner = Chains(sizes).pairs()
        out[inner + 1] += before[inner]
        out[inner] += after[inner + 1]
        return out

    def good(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        up, down = Chains(sizes).messages(self.own(features, sizes), self.pair)
        return _sigmoid(up + down)

    def qualities(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the mean probability of its lines, weighted by their lengths; nan without lines."""
        lines = [lines_of(t) for t in texts]
        sizes = np.array([len(x) for x in lines], np.int64)
        if not sizes.sum():
            return np.full(len(texts), np.nan)
        good = self.good(np.concatenate([line_features(x) for x in lines if x]), sizes)
        return _weighted(good, np.array([len(x) for one in lines for x in one], float), sizes)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        q = self.qualities(texts)
        return np.where(np.isnan(q), self.none, _sigmoid(self.curve[0] + self.curve[1] * np.nan_to_num(q)))


def _weighted(good: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    of = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(of, weights=lengths, minlength=len(sizes))
    with np.errstate(invalid="ignore"):
        return np.bincount(of, weights=good * lengths, minlength=len(sizes)) / total


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def plain_model() -> Model:
    near = np.zeros((3, K))
    near[1] = [PLAIN.get(name, 0.0) for name in NAMES]
    return Model(np.zeros(K), np.ones(K), near, 3.0, np.array([[0.5, 0.0], [0.0, 0.5]]), np.array([-4.0, 8.0]), 0.5)


def fit(features: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """The field and the curve from lines of documents (at least one each) with labels y and weights."""
    middle, spread = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = (features - middle) / spread
    chains, line_y, line_w = Chains(sizes), np.repeat(y, sizes).astype(float), np.repeat(weight / sizes, sizes)
    inner = chains.pairs()
    wide = np.ones((len(x), 3 * K + 1))
    wide[:, 1:] = 0
    wide[:, K + 1 : 2 * K + 1] = x
    wide[inner + 1, 1 : K + 1] = x[inner]
    wide[inner, 2 * K + 1 :] = x[inner + 1]
    w = logistic(wide, line_y, line_w, ridge=1.0)

    held = (wide @ w > 0).astype(float)
    document = np.repeat(np.arange(len(sizes)), sizes)
    agree = np.bincount(document, weights=held == line_y)
    line_y = np.where(agree[document] > 0, held, line_y)
    seen = np.array([[((line_y[inner] == i) & (line_y[inner + 1] == j)).astype(float) @ line_w[inner] for j in (0, 1)] for i in (0, 1)])
    pair = np.log((seen + 1) / (seen + 1).sum(axis=1, keepdims=True))
    pair -= pair.mean()

    # ascent on the field's likelihood with steps scaled by running squares of the gradient
    at = np.concatenate([w, pair.ravel()])
    mean, square, total = np.zeros(len(at)), np.zeros(len(at)), line_w.sum()
    target = wide.T @ (line_w * line_y)
    for step in range(1, STEPS + 1):
        own, p = wide @ at[: len(w)], at[len(w) :].reshape(2, 2)
        up, down = chains.messages(own, p)
        expected = wide.T @ (line_w * _sigmoid(up + down))
        after = own[inner + 1] + down[inner + 1]
        four = np.stack([p[i, j] + i * up[inner] + j * after for i in (0, 1) for j in (0, 1)])
        four = np.exp(four - np.logaddexp.reduce(four, axis=0))
        slope = np.concatenate([target - expected, seen.ravel() - four @ line_w[inner]]) / total - RIDGE / 10 * np.r_[0.0, at[1:]] / len(at)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        at += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) * (1 - step / (STEPS + 1))

    model = Model(middle, spread, at[1 : len(w)].reshape(3, K), float(at[0]), at[len(w) :].reshape(2, 2), np.zeros(2), 0.0)
    q = _weighted(model.good(features, sizes), lengths, sizes)
    model.curve = logistic(np.column_stack([np.ones(len(q)), q]), y.astype(float), weight)
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit the field and the curve on labelled documents that are not held out."""
    rows, counts = labelled_sample(docs, labels, label, held_out(F.col("doc_id")), SAMPLE)
    if not counts.get(0) or not counts.get(1):
        return plain_model()

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = [lines_of(t) for t in b.text]
            kept = [k for k, x in enumerate(lines) if 0 < len(x) <= FIT_LINES]
            yield pd.DataFrame({
                "doc_id": b.doc_id.iloc[kept], "y": b.y.iloc[kept],
                "features": [line_features(lines[k]).astype("<f4").tobytes() for k in kept],
                "lengths": [np.array([len(x) for x in lines[k]], "<i4").tobytes() for k in kept],
            })

    table = rows.mapInPandas(measured, "doc_id long, y int, features binary, lengths binary").toPandas().sort_values("doc_id")  # of the sampled rows, at most FIT_LINES lines each
    if table.y.nunique() < 2:
        return plain_model()
    lengths = [np.frombuffer(x, "<i4") for x in table.lengths]
    sizes, y = np.array([len(x) for x in lengths]), table.y.to_numpy()
    features = np.frombuffer(b"".join(table.features), "<f4").reshape(-1, K).astype(float)
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    model = fit(features, np.concatenate(lengths).astype(float), sizes, y, weight / weight.mean())
    model.none = counts[1] / (counts[0] + counts[1])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add `out` in 0..1 to docs, from whole texts; other columns stay."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts, found, at = s.tolist(), [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE):
                    size += len(texts[end] or "")
                    end += 1
                found.append(model.scores(texts[at:end]))
                at = end
            yield pd.Series(np.concatenate(found) if found else [], dtype="float64")

    return docs.withColumn(out, run(F.col(text)))
