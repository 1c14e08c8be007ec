"""Toxicity categories by a classifier chain of linear models.

The categories are predicted one after the other. Each logistic model sees the
words of the text and the probabilities of the categories before it; for
training, these are out-of-fold predictions, so that a later model learns from
probabilities as unsure as those it will meet.

The words' features are their counts, whole and by prefix, on a log scale. A
distributed count over the labelled sample screens them by how differently the
two classes use them; the models are then fitted to the screened features of
the sample, both of bounded size, and score all documents where these lie.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.llm.common import cut, slices

#: Bounds: labelled documents learnt from (about), features screened for each category; folds.
SAMPLE_ROWS, SCREENED, FOLDS = 6_000, 2_000, 3
PREFIXES = (3, 4, 5, 6, 7, 8)
LEAST_DOCUMENTS = 4
PENALTY, STEPS = 1e-4, 300
WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str | None) -> Counter[str]:
    return Counter(WORD.findall((text or "").lower()))


def features(text: str | None) -> Counter[str]:
    """How often each word (with a mark at its end) and each prefix occurs."""
    out: Counter[str] = Counter()
    for w, n in word_counts(text).items():
        out[w + "$"] += n
        for k in PREFIXES:
            if len(w) >= k:
                out[w[:k]] += n
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lasso(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic model on sparse rows, by accelerated proximal steps."""
    n = len(y)
    rate = 1 / (1 + 0.75 * np.bincount(rows, values**2, n).mean())
    w = at = np.zeros(width)
    b = b_at = 0.0
    t = 1.0
    for _ in range(STEPS):
        slope = (_sigmoid(np.bincount(rows, values * at[cols], n) + b_at) - y) / n
        step = at - rate * np.bincount(cols, values * slope[rows], width)
        new, b_new = np.sign(step) * np.maximum(np.abs(step) - rate * PENALTY, 0), b_at - rate * slope.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, b_at = new + (t - 1) / t_new * (new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = new, b_new, t_new
    return w, b


class Chain:
    """For each category in order: weights of features, an intercept, weights of the probabilities before."""

    def __init__(self, models: dict[str, tuple[dict[str, float], float, list[float]]]):
        self.models = models
        # the weights of all categories by feature, and the features of each length
        self.weights: dict[str, np.ndarray] = {}
        for k, (ws, _, _) in enumerate(models.values()):
            for f, w in ws.items():
                self.weights.setdefault(f, np.zeros(len(models)))[k] = w

    def probabilities(self, text: str | None) -> list[float]:
        found: dict[str, int] = {}
        weights = self.weights
        for w, n in word_counts(text).items():
            if (f := w + "$") in weights:
                found[f] = found.get(f, 0) + n
            for k in PREFIXES:
                if k > len(w):
                    break
                if (f := w[:k]) in weights:
                    found[f] = found.get(f, 0) + n
        total = np.zeros(len(self.models))
        for f, n in found.items():
            total += weights[f] * np.log1p(n)
        out: list[float] = []
        for (_, b, chained), s in zip(self.models.values(), total):
            out.append(float(_sigmoid(s + b + sum(c * p for c, p in zip(chained, out)))) if b > -np.inf else 0.0)
        return out

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id`` and ``p_<category>`` for every row of ``docs``, over its whole text.

        A null text has no words; repeated rows and null ids come out as they
        are; an empty table gives an empty one; other columns are not read; ids
        are cast to long. A category that the sample has in one class only has
        probability 0. A document counts as one of a category above 0.5; at 0.5
        it does not.
        """
        shared, names = docs.sparkSession.sparkContext.broadcast(self), [f"p_{c}" for c in self.models]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (part for batch in batches for part in slices(batch)):
                ps = np.array([shared.value.probabilities(t) for t in b.column(1).to_pylist()])
                yield pa.record_batch([b.column(0), *[pa.array(p) for p in ps.T]], names=["doc_id", *names])

        both = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        return both.mapInArrow(run, "doc_id long" + "".join(f", `{x}` double" for x in names))


def _screen(sample: DataFrame, categories: list[str], screened: int) -> dict[str, list[list[str]]]:
    """For each category the features whose share of documents differs most between its classes.

    The first list is of all documents; list f + 1 is of those outside fold f, so that a fold's
    out-of-fold predictions come from features that its own labels had no part in choosing.
    """
    names = ["n", *categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            ys = np.array([b.column(f"y_{c}").to_numpy(zero_copy_only=False) for c in categories]).T
            for text, fold, y in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), ys):
                one = np.zeros((FOLDS, len(names)))
                one[fold] = [1.0, *y]
                for f in features(text):
                    counts[f] = counts[f] + one if f in counts else one
        if counts:
            columns = np.array(list(counts.values())).reshape(len(counts), -1).T
            yield pa.record_batch([pa.array(list(counts)), *[pa.array(x) for x in columns]], names=["feature", *held])

    held = [f"{name}_{f}" for f in range(FOLDS) for name in names]
    table = sample.mapInArrow(run, "feature string" + "".join(f", `{x}` double" for x in held))
    table = cut(table.groupBy("feature").agg(*[F.sum(f"`{x}`").alias(x) for x in held]))
    whole = {r["fold"]: r for r in sample.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(f"y_{c}").alias(c) for c in categories]).collect()}
    kept: dict[str, list[list[str]]] = {c: [] for c in categories}
    for c in categories:
        for out in (None, *range(FOLDS)):
            folds = [f for f in range(FOLDS) if f != out]
            size, pos = (sum(whole[f][x] for f in folds if f in whole) for x in ("n", c))
            neg, found = size - pos, []
            if pos and neg:
                n, yes = (sum((F.col(f"`{x}_{f}`") for f in folds), F.lit(0.0)) for x in ("n", c))
                share = n / size
                z = F.abs(yes / pos - (n - yes) / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-12)
                found = [r["feature"] for r in table.where(n >= LEAST_DOCUMENTS).orderBy(z.desc(), "feature").select("feature").limit(screened).collect()]
            kept[c].append(found)
    return kept


def fit(
    docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS, screened: int = SCREENED,
) -> Chain:
    """A chain for the 0/1 columns ``categories`` of ``labels``, in that order.

    Learns from about ``sample_rows`` labelled documents, chosen by a hash of
    the id. Rows with a null id or label are not used.
    """
    named = labels.select(F.col(id_col).alias("label_id"), *[F.col(c).cast("double").alias(f"y_{c}") for c in categories]).dropna()
    part = min(1.0, sample_rows / max(1, named.count()))
    # bounded by sample_rows, so it may be broadcast
    named = named.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = rows.join(F.broadcast(named), F.col("doc_id") == F.col("label_id")).drop("label_id")
    # settled once: it is read for the screening and again for the features
    sample = cut(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")))
    kept = _screen(sample, categories, screened)
    place = {f: k for k, f in enumerate(sorted({f for lists in kept.values() for fs in lists for f in fs}))}
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, 1)):
            found = [{shared.value[f]: n for f, n in features(t).items() if f in shared.value} for t in b.column("text").to_pylist()]
            kept = [pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
            ys = [b.column(f"y_{c}") for c in categories]
            yield pa.record_batch([b.column("doc_id"), b.column("fold"), *ys, *kept], names=["doc_id", "fold", *[f"y_{c}" for c in categories], "cols", "counts"])

    schema = "doc_id long, fold int" + "".join(f", `y_{c}` double" for c in categories) + ", cols array<int>, counts array<int>"
    data = sample.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema).collect()
    data.sort(key=lambda r: (r["doc_id"], r["cols"]))
    return _fit(data, list(place), kept)


def _fit(data: list, names: list[str], kept: dict[str, list[list[str]]]) -> Chain:
    """The chain of the categories in ``kept``, each on its own screened features and the probabilities before."""
    n, width, categories = len(data), len(names), list(kept)
    fold = np.array([r["fold"] for r in data], int)
    rows = np.repeat(np.arange(n), [len(r["cols"]) for r in data]).astype(int)
    cols = np.array([c for r in data for c in r["cols"]], int)
    values = np.log1p(np.array([x for r in data for x in r["counts"]], float))
    models: dict[str, tuple[dict[str, float], float, list[float]]] = {}
    for k, c in enumerate(categories):
        y = np.array([r[f"y_{c}"] for r in data])

        def model(use, screened, y=y, k=k):
            """Weights from the rows in ``use`` and the features in ``screened``."""
            own = set(screened)
            allowed = np.array([f in own for f in names] + [True] * k, bool)
            here = use[rows] & allowed[cols]
            return lasso(np.cumsum(use)[rows[here]] - 1, cols[here], values[here], y[use], width + k)

        ahead = np.zeros(n)
        if n == 0 or y.min() == y.max():
            models[c] = {}, -np.inf, [0.0] * k
        else:
            w, b = model(np.ones(n, bool), kept[c][0])
            models[c] = {names[j]: float(w[j]) for j in np.flatnonzero(w[:width])}, float(b), [float(x) for x in w[width:]]
            for f in range(FOLDS):
                own = fold == f
                if own.any() and not own.all():
                    w, b = model(~own, kept[c][f + 1])
                    ahead[own] = _sigmoid(np.bincount(rows, values * w[cols], n) + b)[own]
        # the out-of-fold probability is one more column for the later models
        rows, cols, values = np.append(rows, np.arange(n)), np.append(cols, np.full(n, width + k)), np.append(values, ahead)
    return Chain(models)
