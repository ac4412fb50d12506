"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector w for all thresholds theta_0 < theta_1 < ...; x holds
the distinct words of a text and the word beginnings of 4, 5 and 6 bytes, hashed to 2^20 places. The model is fitted
on a bounded sample of labelled rows (SAMPLE of them, those with the smallest id hash, in the labels' proportions, but
LEAST_PER_CLASS of a rare class; texts that repeat count once), on the places whose log odds between the classes are Z standard errors from none, by
mini-batch AdaGrad with an L1 penalty. Thresholds are the first one and the logarithms of the steps to the next, so
they stay in order by themselves.
The thresholds are then moved by the classes' odds among all labels, as a rare class has more than its share of the sample.
The fit is one task on the sample. Scoring is one pass over whole texts with the model's weights (some thousands,
bounded by the sample) broadcast; no shuffle.

Labels say toxic or not, so the grades 1, 2 and 3 of toxic examples are thirds by the density of words that the
sample ties to toxicity (log odds of at least LOG_ODDS). They are thus made of the features that the model sees, and
say how dense a text is with such words, no more. Any other graded table can be given instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendlake.llm.words import ALNUM, U, mix, words

BITS = 20
PREFIXES = (4, 5, 6)
WORDS_AT_ONCE = 1 << 18
SAMPLE = 12000
LEAST_PER_CLASS = 1000
LOG_ODDS = 2.0
EPOCHS, BATCH, RATE, L1, LEAST_DOCS, Z = 60, 64, 0.1, 3e-4, 4, 2.5
#: A text is called toxic from this probability of a grade of 1 or above.
CUT = 0.3
OUT = {"p_toxic": T.DoubleType(), "severity": T.DoubleType(), "grade": T.IntegerType(), "toxic": T.BooleanType()}


@dataclass
class Model:
    places: np.ndarray
    values: np.ndarray  # weights of the places; all others are zero
    thresholds: np.ndarray  # ascending; one less than the grades

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.values
        return out

    def grades(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(grade >= 1), expected grade, grade: the most likely one above 0 from CUT on, else 0."""
        below = 1 / (1 + np.exp(np.clip(margin[:, None] - self.thresholds, -500, 500)))
        full = np.concatenate([below, np.ones((len(margin), 1))], axis=1)
        p = 1 - below[:, 0]
        return p, (1 - below).sum(axis=1), np.where(p >= CUT, 1 + np.diff(full, axis=1).argmax(axis=1), 0)


def features(w) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, place) of every word and word beginning of the texts of w, repeated ones included, in parts."""
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    for i in range(0, len(text), WORDS_AT_ONCE):
        part = slice(i, i + WORDS_AT_ONCE)
        rows, places = [text[part]], [mix(w.hash[part], 1) >> U(64 - BITS)]
        for n in PREFIXES:
            h = w.prefix(n, part)
            rows.append(text[part][h != 0])
            places.append(mix(h[h != 0], n) >> U(64 - BITS))
        yield np.concatenate(rows), np.concatenate(places).astype(np.int64)


def _distinct(parts: Iterator[tuple[np.ndarray, np.ndarray]], some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, place) of parts, by text and place; only places of which `some` is true."""
    seen = [np.zeros(0, np.int64)]
    for rows, places in parts:
        both = (rows.astype(np.int64) << BITS) | places
        seen.append(np.unique(both if some is None else both[some[places]]))
    both = np.unique(np.concatenate(seen))
    return both >> BITS, both & ((1 << BITS) - 1)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in words(batch.column(1), ALNUM):
            rows, places = _distinct(features(w))
            cut = np.searchsorted(rows, np.arange(b - a + 1))
            found = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(places.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), found], ["y", "places"])


def examples(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, least: int = LEAST_PER_CLASS) -> tuple[DataFrame, tuple[int, int]]:
    """(y, places) of the bounded sample, and how many labels there are of 0 and 1."""
    given = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    size = {y: max(most * n // sum(counts.values()), least) for y, n in counts.items()}
    chosen = given.filter("y = 1").orderBy(*order).limit(size.get(1, 0)).unionByName(given.filter("y = 0").orderBy(*order).limit(size.get(0, 0)))
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")  # most + 2 * least rows at most
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))  # one row an id, however often it repeats
    return texts.select("y", "text").mapInArrow(_sparse, "y int, places array<int>"), (counts.get(0, 0), counts.get(1, 0))


def _arrays(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct examples in an order of their own, so that a fit doesn't depend on how tasks ended."""
    rows = {(y, x.values.to_numpy().tobytes()) for y, x in zip(table.column("y").to_pylist(), table.column("places"), strict=True)}
    rows = sorted(rows, key=lambda r: (r[0], len(r[1]), r[1]))
    return np.array([y for y, _ in rows], int), [np.frombuffer(x, np.int32) for _, x in rows]


def severity_grades(y: np.ndarray, xs: list[np.ndarray]) -> np.ndarray:
    """0 for other than toxic examples; 1 to 3 by thirds of the density of tied places."""
    grade = y.copy()
    if not y.any() or y.all():
        return grade
    count = [np.bincount(np.concatenate([x for x, c in zip(xs, y, strict=True) if c == k]), minlength=1 << BITS) for k in (0, 1)]
    odds = np.log((count[1] + 0.5) / (y.sum() + 1)) - np.log((count[0] + 0.5) / ((1 - y).sum() + 1))
    tied = (odds >= LOG_ODDS) & (count[1] >= LEAST_DOCS)
    share = np.array([tied[x].sum() / max(1, len(x)) for x in xs])
    low, high = np.quantile(share[y == 1], [1 / 3, 2 / 3])
    grade[y == 1] = 1 + (share[y == 1] > low).astype(int) + (share[y == 1] > high)
    return grade


def telling(toxic: np.ndarray, xs: list[np.ndarray]) -> np.ndarray:
    """Places whose log odds between the classes are Z standard errors from none."""
    yes, no = (np.bincount(np.concatenate([x for x, c in zip(xs, toxic, strict=True) if c == k]), minlength=1 << BITS) for k in (True, False))
    n_yes, n_no = toxic.sum(), (~toxic).sum()
    odds = np.log((yes + 0.5) / (n_yes - yes + 0.5)) - np.log((no + 0.5) / (n_no - no + 0.5))
    error = np.sqrt(1 / (yes + 0.5) + 1 / (n_yes - yes + 0.5) + 1 / (no + 0.5) + 1 / (n_no - no + 0.5))
    return np.abs(odds) >= Z * error


def fit(grade: np.ndarray, xs: list[np.ndarray], prior: tuple[int, int], seed: int = 3) -> Model:
    """prior: how many labels of grade 0 and above there are in all, for the thresholds."""
    n_grades = max(2, int(grade.max(initial=0)) + 1)
    weights, theta = np.zeros(1 << BITS), np.linspace(0.5, 2.0, n_grades - 1)
    if not len(grade) or not (grade > 0).any() or (grade > 0).all():  # nothing to tell apart: all is as the labels are
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), theta + (-20.0 if len(grade) and (grade > 0).all() else 20.0))
    used = telling(grade > 0, xs)
    xs = [x[used[x]] for x in xs]
    g, gt, rng = np.full(1 << BITS, 1e-6), np.full(n_grades - 1, 1e-6), np.random.default_rng(seed)
    free = np.concatenate([theta[:1], np.log(np.diff(theta))])  # the first threshold, and logarithms of the steps
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(xs))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            lens = np.array([len(xs[j]) for j in at])
            x, row, y = np.concatenate([xs[j] for j in at]), np.repeat(np.arange(len(at)), lens), grade[at]
            m = np.bincount(row, weights[x], minlength=len(at))
            edges = np.concatenate([[-np.inf], theta, [np.inf]])
            hi, lo = sigmoid(edges[y + 1] - m), sigmoid(edges[y] - m)
            p = np.maximum(hi - lo, 1e-9)
            dm = (1 - hi - lo) / len(at)
            place, back = np.unique(x, return_inverse=True)
            d = np.bincount(back, dm[row], minlength=len(place))
            g[place] += d * d
            step = RATE / np.sqrt(g[place])
            new = weights[place] - step * d
            weights[place] = np.sign(new) * np.maximum(0, np.abs(new) - step * L1)
            dt = np.zeros(n_grades + 1)
            np.add.at(dt, y + 1, -hi * (1 - hi) / p / len(at))
            np.add.at(dt, y, lo * (1 - lo) / p / len(at))
            df = np.cumsum(dt[1:-1][::-1])[::-1] * np.concatenate([[1.0], np.exp(free[1:])])  # a step moves all thresholds after it
            gt += df**2
            free = free - RATE / np.sqrt(gt) * df
            theta = np.cumsum(np.concatenate([free[:1], np.exp(np.minimum(free[1:], 50.0))]))
    sample = ((grade == 0).sum(), (grade > 0).sum())
    shift = np.log((prior[0] / sample[0]) / (prior[1] / sample[1]))
    places = np.flatnonzero(weights)
    return Model(places.astype(np.int32), weights[places].astype(np.float32), theta + shift)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, least: int = LEAST_PER_CLASS) -> Model:
    """The model, fitted in a task: the sample's bound is the task's, and the driver gets the weights only."""
    sample, prior = examples(docs, labels, most, least)

    def fitted(rows: pa.Table) -> pa.Table:
        y, xs = _arrays(rows)
        m = fit(severity_grades(y, xs), xs, prior)
        return pa.table({"places": pa.array([m.places], pa.list_(pa.int32())), "values": pa.array([m.values], pa.list_(pa.float32())), "thresholds": pa.array([m.thresholds], pa.list_(pa.float64()))})

    got = sample.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(fitted, "places array<int>, values array<float>, thresholds array<double>").first()
    if got is None:  # no examples
        return fit(np.zeros(0, int), [], (0, 0))
    return Model(np.array(got["places"], np.int32), np.array(got["values"], np.float32), np.array(got["thresholds"]))


def margins(weights: np.ndarray, w) -> np.ndarray:
    rows, places = _distinct(features(w), weights != 0)
    return np.bincount(rows, weights[places].astype(float), minlength=len(w.first) - 1)


def _scorer(shared, at: int, n: int) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = model.dense()
        for batch in batches:
            for a, b, w in words(batch.column(at), ALNUM):
                p, severity, grade = model.grades(margins(weights, w))
                cols = [pa.array(p), pa.array(severity), pa.array(grade.astype(np.int32)), pa.array(p >= CUT)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:n]), *cols], [f"c{i}" for i in range(n + 4)])

    return score


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with p_toxic (P of grade 1 or above), severity (expected grade), toxic (p_toxic >= CUT) and grade (0 for what
    isn't toxic, else the most likely one above).

    Columns of df with these names (in any case of letters) are replaced. A null or empty text has no features and gets
    the scores of the thresholds alone. Rows that repeat score alike; an empty df gives an empty result. Labels of one
    class only make everything that class.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c.lower() not in OUT]
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(c, t) for c, t in OUT.items()]])
    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(_scorer(shared, keep.index(text), len(keep)), schema)
