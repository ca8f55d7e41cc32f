"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import chosen, is_training_row, table, text_of

FEATURES = (
    "words", "word_length", "upper", "digits", "marks", "common_marks", "other_marks", "bars", "spaces", "line_length", "capital_words", "marked_words",
    "distinct", "top_word", "repeats", "long_run", "distinct_lines", "long_words", "short_words", "sentence_ends", "letters", "entropy", "pair_distinct",
)


def text_features(text: str) -> list[float]:
    """Shape of a text, from all of it: shares of kinds of characters and words, repetition, line and word lengths."""
    n, words, lines = max(1, len(text)), text.split(), text.split("\n")
    k, counts = max(1, len(words)), Counter(words)
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(re.findall("[A-Za-z]", text))
    upper, digits = sum(map(str.isupper, text)) if not text.isascii() else len(re.findall("[A-Z]", text)), len(re.findall(r"\d", text))
    spaces = len(re.findall(r"\s", text))
    common, bars = len(re.findall(r"[.,;:?'\"()\-]", text)), text.count("|")
    marks = max(0, n - letters - digits - spaces)
    same = [a == b for a, b in zip(words, words[1:], strict=False)]
    run = longest = 0
    for x in same:
        run = run + 1 if x else 0
        longest = max(longest, run)
    share = np.array(list(counts.values()), dtype=float) / k if words else np.ones(1)
    sizes = [len(w) for w in words] or [0]
    return [
        np.log1p(len(words)), sum(sizes) / k, upper / n, digits / n, marks / n, common / n, (marks - common - bars) / n, bars / n, spaces / n, np.log1p(n / max(1, len(lines))),
        sum(w[:1].isupper() for w in words) / k, sum(not w[-1].isalnum() for w in words) / k, len(counts) / k**0.8, float(share.max()), sum(same) / k, np.log1p(longest),
        len(set(lines)) / max(1, len(lines)), sum(x > 12 for x in sizes) / k, sum(x < 3 for x in sizes) / k, len(re.findall(r"[.!?](?:\s|$)", text)) / k, letters / n,
        float(-(share * np.log(share)).sum()) / np.log(k + 1.0) if words else 0.0, len(set(zip(words, words[1:], strict=False))) / k,
    ]


class WordBins(dict):
    """Bins of words by a hash, remembered for up to 200,000 words."""

    def __init__(self, bins: int):
        super().__init__()
        self.bins = bins

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = out = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.bins
        return out


def word_features(text: str, words: WordBins) -> tuple[np.ndarray, np.ndarray]:
    """Bins of a text's distinct words and their weights: log(1 + how often), to a sum of squares of 1."""
    counts = Counter(text.lower().split())
    weights = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    return np.fromiter(map(words.__getitem__, counts), dtype=np.int64, count=len(counts)), weights / max(1e-9, float(np.sqrt(weights @ weights)))


class Features:
    """Shapes of texts (a row each) and their hashed words (bins and weights, row after row)."""

    def __init__(self, shapes: np.ndarray, bins: list[np.ndarray], weights: list[np.ndarray]):
        self.shapes, self.bins, self.weights = shapes, bins, weights

    @staticmethod
    def of(texts: Iterable[str], words: WordBins) -> Features:
        texts = list(texts)
        found = [word_features(t, words) for t in texts]
        shapes = np.array([text_features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        return Features(shapes, [x[0] for x in found], [x[1] for x in found])

    def __len__(self) -> int:
        return len(self.shapes)

    def take(self, at: np.ndarray) -> Features:
        return Features(self.shapes[at], [self.bins[i] for i in at], [self.weights[i] for i in at])

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All bins, all weights and the row of each."""
        rows = np.repeat(np.arange(len(self)), [len(x) for x in self.bins])
        return np.concatenate([*self.bins, np.zeros(0, np.int64)]), np.concatenate([*self.weights, np.zeros(0)]), rows


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of decisions, and the direction in which a step goes down for each decision.

    With the logistic loss l the risk is ``prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])``. Where the second
    term is below 0, the step goes up its gradient instead, so that no negatives are fitted that aren't there.
    """
    loss = lambda z: np.logaddexp(0, z)
    negative = loss(unlabelled).mean() - prior * loss(positive).mean()
    risk = prior * loss(-positive).mean() + max(0.0, float(negative))
    if negative >= 0:
        return risk, prior * (-_sigmoid(-positive) - _sigmoid(positive)) / len(positive), _sigmoid(unlabelled) / len(unlabelled)
    return risk, prior * _sigmoid(positive) / len(positive), -_sigmoid(unlabelled) / len(unlabelled)


def _spread(x: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - center) / scale, -6, 6)
    return np.concatenate([z, z * z / 6], axis=1)


def fit_nnpu(positive: Features, unlabelled: Features, prior: float, bins: int, steps: int = 500, hidden: int = 24, rate: float = 0.01, batch: int = 1024, seed: int = 3) -> dict:
    """A network with one hidden layer on shapes and a weight a word bin, by steps down the non-negative risk (Adam)."""
    every = np.concatenate([positive.shapes, unlabelled.shapes])
    model = {"center": np.median(every, axis=0), "scale": every.std(axis=0) + 1e-6}
    rng, d = np.random.default_rng(seed), 2 * every.shape[1]
    w = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1), np.zeros(bins)]
    decay = [1e-4, 1e-4, 1e-4, 0.0, 1e-4]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, steps + 1):
        parts = []
        for x in (positive, unlabelled):
            x = x if len(x) <= batch else x.take(rng.integers(0, len(x), batch))
            shapes = _spread(x.shapes, model["center"], model["scale"])
            at, weight, row = x.flat()
            h = np.tanh(shapes @ w[0] + w[1])
            f = h @ w[2] + w[3] + np.bincount(row, weights=weight * w[4][at], minlength=len(x))
            parts.append((shapes, h, f, at, weight, row))
        _, *slopes = risk_slopes(parts[0][2], parts[1][2], prior)
        grads = [k * a for k, a in zip(decay, w, strict=True)]
        for (shapes, h, _, at, weight, row), g in zip(parts, slopes, strict=True):
            back = g[:, None] * w[2] * (1 - h * h)
            pieces = (shapes.T @ back, back.sum(0), h.T @ g, g.sum(keepdims=True), np.bincount(at, weights=weight * g[row], minlength=bins))
            grads = [a + b for a, b in zip(grads, pieces, strict=True)]
        for i in range(5):
            m[i] = 0.9 * m[i] + 0.1 * grads[i]
            v[i] = 0.999 * v[i] + 0.001 * grads[i] ** 2
            w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return model | {"w": w, "bins": bins}


def decision(model: dict, x: Features) -> np.ndarray:
    w = model["w"]
    at, weight, row = x.flat()
    words = np.bincount(row, weights=weight * w[4][at], minlength=len(x))
    return np.tanh(_spread(x.shapes, model["center"], model["scale"]) @ w[0] + w[1]) @ w[2] + w[3][0] + words


def scores(model: dict, x: Features) -> np.ndarray:
    return _sigmoid(decision(model, x))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the unlabelled, from decisions that were not fitted to these rows.

    Above any threshold lies at least ``prior`` times as large a share of the unlabelled as of the positives. The threshold
    is the one whose quotient has the least upper confidence bound (best bin estimation).
    """
    at = np.sort(np.concatenate([positive, unlabelled]))
    of_p = 1 - np.searchsorted(np.sort(positive), at, side="left") / len(positive)
    of_u = 1 - np.searchsorted(np.sort(unlabelled), at, side="left") / len(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / delta) / 2 / len(positive))
    enough = of_p > 0
    bound = of_u[enough] / of_p[enough] + (1 + gamma) / of_p[enough] * slack
    k = int(bound.argmin())
    return float(np.clip(of_u[enough][k] / of_p[enough][k], 0.05, 0.99))


def estimated_prior(positive: Features, unlabelled: Features, bins: int, seed: int = 5) -> float:
    """``class_prior`` by a classifier of positives against unlabelled rows: fitted on either half, held against the other."""
    rng, found = np.random.default_rng(seed), []
    halves = [np.array_split(rng.permutation(len(x)), 2) for x in (positive, unlabelled)]
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    for k in (0, 1):
        fitted = [x.take(h[k]) for x, h in zip((positive, unlabelled), halves, strict=True)]
        # With a prior of one half and the sign of plain two-class risk: positives against unlabelled rows.
        model = fit_nnpu(*fitted, 0.5, bins, steps=150)
        found.append(class_prior(*(decision(model, x.take(h[1 - k])) for x, h in zip((positive, unlabelled), halves, strict=True))))
    return float(np.mean(found))


def pick_rows(docs: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, label_col: str) -> DataFrame:
    """The rows of the training fold to learn from, with booleans __p (positive) and __u (unlabelled).

    A hash of the id picks about ``fit_rows`` of the ids with label 1, and as many of all rows, each by a share in double
    precision: at any size of the tables a bounded number, and all where there are fewer. So the picked ids, which are
    broadcast, are bounded too. Of several labels of an id the largest counts; null ids and labels are ignored.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__known")).agg(F.max(label_col).alias("__y"))
    positive = known.filter("__y > 0").filter(is_training_row("__known"))
    training = docs.filter(is_training_row(id_col))
    positive = positive.filter(chosen("positive", F.col("__known"), fit_rows, positive.count())).select("__known")
    out = training.withColumn("__u", chosen("unlabelled", F.col(id_col), fit_rows, training.count()))
    out = out.join(F.broadcast(positive.withColumn("__p", F.lit(True))), F.col(id_col) == F.col("__known"), "left")
    return out.withColumn("__p", F.coalesce("__p", F.lit(False))).filter("__p OR __u").drop("__known")


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = 6_000, bins: int = 4096, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict | None:
    """The model, from the rows of ``pick_rows``: positives and unlabelled text; negative labels are not used.

    The rows, about ``2 * fit_rows`` of them, come to the driver as features, 1 to 2 KB a text of the usual length. The class
    prior is estimated from the same rows. None without positives: then nothing can be learned. Null texts count
    as empty.
    """
    picked = pick_rows(docs, labels, fit_rows, id_col, label_col)

    def shape(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordBins(bins)
        for frame in frames:
            x = Features.of(frame["__text"], words)
            packed = {"__x": x.shapes, "__bins": x.bins, "__weights": x.weights}
            kinds = {"__x": "<f4", "__bins": "<i4", "__weights": "<f4"}
            yield frame[["__p", "__u"]].assign(**{k: [a.astype(kinds[k]).tobytes() for a in v] for k, v in packed.items()})

    rows = picked.select("__p", "__u", text_of(text_col).alias("__text"))
    rows = rows.mapInPandas(shape, "__p boolean, __u boolean, __x binary, __bins binary, __weights binary").toPandas()
    if not rows["__p"].any() or not rows["__u"].any():
        return None
    shapes = np.frombuffer(b"".join(rows["__x"]), "<f4").reshape(len(rows), len(FEATURES)).astype(float)
    x = Features(shapes, *([np.frombuffer(a, kind) for a in rows[c]] for c, kind in (("__bins", "<i4"), ("__weights", "<f4"))))
    order = np.lexsort(x.shapes.T)  # rows come in any order
    positive, unlabelled = (x.take(order[rows[c].to_numpy(dtype=bool)[order]]) for c in ("__p", "__u"))
    prior = estimated_prior(positive, unlabelled, bins)
    return fit_nnpu(positive, unlabelled, prior, bins) | {"prior": prior}


def score_quality(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id and score. Without a model every score is 1, so nothing is rejected.

    Null texts count as empty. Rows with equal texts have equal scores. An empty table gives an empty result.
    """

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordBins(model["bins"]) if model else None
        for frame in frames:
            found = scores(model, Features.of(frame["__text"], words)) if model and len(frame) else np.ones(len(frame))
            yield pd.DataFrame({"__id": frame["__id"], "score": found})

    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    return rows.mapInPandas(judged, f"__id {dict(docs.dtypes)[id_col]}, score double").withColumnRenamed("__id", id_col)


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **parameters) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all their columns; all rows without a model."""
    model = fit_quality(docs, labels, **parameters)
    if model is None:
        return docs
    text_col = parameters.get("text_col", "text")
    names, words = docs.columns, WordBins(model["bins"])

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(scores(model, Features.of(text, words)) if len(text) else [], dtype=float)

    return docs.filter(score(text_of(text_col)) >= threshold).select(*names)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (~is_training_row("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
