"""Toxicity by classifier chains.

Categories are predicted one after another. Each is a linear model over the presence of words and the probabilities of the
categories before it. A model is trained with the out-of-fold probabilities of the earlier ones, which look like those of texts that
no model has seen. Every word counts that the labelled rows hold evidence on, however many there are; rows are sparse.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import cut, slices

#: Labelled rows on which the chain is fitted, at most: a documented bound.
SAMPLE_ROWS = 20_000
#: Labelled rows that hold a word, and its chi-squared with any category, from which on it is evidence (one word in a thousand
#: without any would pass): no bound on their number.
LEAST_ROWS, EVIDENCE = 3, 10.8
FOLDS = 5
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Chain:
    """Categories in order, the words, and for each category its weights: bias, words, earlier probabilities."""

    categories: tuple[str, ...]
    words: tuple[str, ...]
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.index = {w: i for i, w in enumerate(self.words)}

    def present(self, text: str | None) -> np.ndarray:
        """The places of the words that a text holds, in the whole text."""
        found = self.index.keys() & set(_WORD.findall((text or "").lower()))
        return np.array(sorted(self.index[w] for w in found), np.int64)

    def predict(self, present: np.ndarray) -> list[float]:
        out: list[float] = []
        for w in self.weights:
            score = w[0] + w[1 + present].sum() + (w[1 + len(self.words) :] * _logit(np.array(out))).sum()
            out.append(float(1 / (1 + np.exp(-np.clip(score, -500, 500)))))
        return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.001, 0.999)
    return np.log(p / (1 - p)) / 4


@dataclass
class Sparse:
    """Rows of presences: the places of row i are places[starts[i] : starts[i + 1]], of `width` columns."""

    starts: np.ndarray
    places: np.ndarray
    width: int

    def __post_init__(self):
        self.sizes = np.diff(self.starts)

    def times(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[self.places], dtype=np.float64)])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.places, np.repeat(r, self.sizes), self.width)

    def rows(self, some: np.ndarray) -> Sparse:
        """The rows where `some` is true."""
        sizes = self.sizes[some]
        return Sparse(np.concatenate([[0], np.cumsum(sizes)]), self.places[np.repeat(some, self.sizes)], self.width)


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def linear(x: Sparse, more: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Weights (bias, words, `more` dense columns) of a logistic regression with an L2 penalty, by accelerated gradient steps.

    Columns are scaled by their own curvature, so that rare words are fitted as soon as common ones. Dense columns are
    few and are summed without a matrix product, whose threads would cost more than they do.
    """
    n = x.width
    times = lambda w: w[0] + x.times(w[1 : 1 + n]) + (more * w[1 + n :]).sum(1)
    back = lambda r: np.concatenate([[r.sum()], x.back(r), (more * r[:, None]).sum(0)])
    keep = np.full(1 + n + more.shape[1], penalty)
    keep[0] = 0.0
    own = np.concatenate([[len(y)], np.bincount(x.places, minlength=n), (more * more).sum(0)])
    scale = 1 / np.sqrt(own / 4 + penalty)
    v, most = np.ones(len(scale)), 1.0
    for _ in range(10):  # the largest curvature, by the power method
        v = scale * (back(times(scale * v)) / 4 + keep * scale * v)
        most = np.linalg.norm(v) or 1.0
        v /= most
    u = last = np.zeros(len(scale))
    k = 0
    for _ in range(rounds):
        ahead = u + k / (k + 3) * (u - last)
        w = scale * ahead
        last, u = u, ahead - scale * (back(_probability(times(w)) - y) + keep * w) / (1.2 * most)
        k = 0 if ((ahead - u) * (u - last)).sum() > 0 else k + 1  # a step against the gradient starts anew
        if np.abs(scale * (u - last)).max() < 3e-4:
            break
    return scale * u


def chain(x: Sparse, labels: np.ndarray, fold: np.ndarray, penalty: float = 1.0) -> tuple[list[np.ndarray], np.ndarray]:
    """The weights of each category of `labels` (rows, categories), and all out-of-fold probabilities."""
    weights, held = [], np.zeros(labels.shape)
    for c in range(labels.shape[1]):
        more = _logit(held[:, :c])
        for f in np.unique(fold):
            w = linear(x.rows(fold != f), more[fold != f], labels[fold != f, c], penalty)
            held[fold == f, c] = _probability(w[0] + x.rows(fold == f).times(w[1 : 1 + x.width]) + (more[fold == f] * w[1 + x.width :]).sum(1))
        weights.append(linear(x, more, labels[:, c], penalty))
    return weights, held


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that gives the best F1, midway to the next lower one.

    A category without rows gets 2, so that it is never predicted; one that all rows have gets 0.5.
    """
    if not y.any() or y.all():
        return 0.5 if y.any() else 2.0
    order = np.argsort(-p, kind="stable")
    s, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal probabilities can't be parted
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def _words(df: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """`keep` and the distinct words of each text, as an array."""
    rows = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def each(batches):
        for b in slices(batches):
            found = [sorted(set(_WORD.findall((t.as_py() or "").lower()))) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.string()))], names=[*keep, "words"])

    return rows.mapInArrow(each, ", ".join([*fields, "words array<string>"]))


def _placed(rows: DataFrame, words: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """`keep` and the places of the words that each text holds, as an array."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields]
    index = {w: i for i, w in enumerate(words)}

    def each(batches):
        for b in slices(batches):
            found = [sorted(index[w] for w in x.as_py() if w in index) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names=[*keep, "places"])

    return rows.select(*keep, "words").mapInArrow(each, ", ".join([*fields, "places array<int>"]))


def sampled(truth: DataFrame, most: int) -> DataFrame:
    """The `most` rows of `truth` (id, ...) with the lowest hash of their id.

    A bound on the hash first leaves little more than the sample, so that no partition sends its own `most` rows to be sorted.
    """
    keyed = cut(truth.withColumn("h", F.xxhash64("id")))
    n = keyed.count()
    share = F.col("h").cast("double") / 2.0**64 + 0.5
    near = keyed.where(share * n <= 1.05 * most + 500) if n > most else keyed
    return near.orderBy("h", "id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, evidence: float = EVIDENCE, folds: int = FOLDS, penalty: float = 1.0) -> Chain:
    """The chain fitted on the `sample_rows` labelled rows with the lowest hash of their id.

    `categories` names conditions over the columns of `labels`, in the order of the chain; a null counts as no. Labels of one
    id count as one, the largest; so do its texts, the first in their order, so that the bound is one on rows. Words are counted
    by category on the executors; those in `LEAST_ROWS` rows or more whose chi-squared with any category is `evidence` or more are
    kept. What reaches the driver is bounded by the sample: these words, and their places in its rows.
    """
    names = tuple(categories)
    ys = [f"y{i}" for i in range(len(names))]
    # As one label for an id: the largest of its rows. Rows without an id have no text.
    truth = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.coalesce(F.expr(c), F.lit(False)).cast("int")).alias(y) for y, c in zip(ys, categories.values())])
    chosen = cut(sampled(truth, sample_rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    # The sample is bounded, so it is sent to the texts.
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", *ys).agg(F.min("text").alias("text"))
    rows = cut(_words(rows, "text", ("id", *ys)))
    totals = rows.agg(F.count("*"), *[F.coalesce(F.sum(y), F.lit(0)) for y in ys]).first()
    n = max(1, totals[0])
    counts = rows.select(F.explode("words").alias("w"), *ys).groupBy("w").agg(F.count("*").alias("n"), *[F.sum(y).alias(f"n{i}") for i, y in enumerate(ys)])
    score = F.lit(0.0)
    for i in range(len(names)):  # chi-squared: the rows times the squared correlation of word and category
        a, b, c = F.col(f"n{i}") / n, F.col("n") / n, totals[1 + i] / n
        score = F.greatest(score, n * F.pow(a - b * c, F.lit(2)) / (b * (1 - b) * c * (1 - c) + 1e-9))
    words = tuple(counts.where((F.col("n") >= LEAST_ROWS) & (score >= evidence)).select("w").toArrow().column(0).to_pylist())
    words = tuple(sorted(words))
    # In the order of a hash, so that folds have nothing to do with how labels are dealt over ids.
    found = _placed(rows, words, ("id", *ys)).orderBy(F.xxhash64("id"), "id").toArrow()
    places = found.column("places").combine_chunks()
    starts = np.concatenate([[0], np.cumsum(places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    x = Sparse(starts, places.flatten().to_numpy(zero_copy_only=False).astype(np.int64), len(words))
    y = np.stack([found.column(c).to_numpy().astype(np.float64) for c in ys], 1) if len(names) else np.zeros((found.num_rows, 0))
    out = Chain(names, words)
    out.weights, held = chain(x, y, np.arange(found.num_rows) % folds, penalty)
    out.thresholds = [best_threshold(held[:, c], y[:, c]) for c in range(len(names))]
    return out


def predict(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>, is_<category>, ...) of each row, from its whole text; a null text holds no words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", *[f"p_{c}" for c in model.categories]]

    def each(batches):
        for b in slices(batches):
            p = np.array([model.predict(model.present(t.as_py())) for t in b.column(1)], np.float64).reshape(-1, len(model.categories))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in p.T]], names=names)

    out = rows.mapInArrow(each, f"id {kind}, " + ", ".join(f"`{c}` double" for c in names[1:]))
    return out.select("*", *[(F.col(f"p_{c}") >= t).alias(f"is_{c}") for c, t in zip(model.categories, model.thresholds)])
