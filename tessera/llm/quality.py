"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text becomes a short vector of transformed statistics (rates of kinds of
characters, repetition, shape of words and lines).  Class means and
covariances come from sums over all labelled rows that may be learned from;
each covariance is shrunk towards the pooled one and its diagonal.  A score
is the logistic of the difference of the classes' log densities (Mahalanobis
distance through the cached Cholesky factor, log determinant, log prior).

Statistics are computed once per document and written narrow; labels join to
those vectors, never to texts.  Only sums (a few hundred numbers a class)
reach the driver.

Edge cases: NULL and empty texts have the statistics of an empty document and
get a score; rows whose label is NULL teach nothing; several labels of a
document count as their rounded mean; if a class has no rows, the score is the
smoothed share of class 1; repeated rows are scored each; a NULL doc_id counts
as held in but has no label; other columns of the inputs are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy, written

SHRINK_POOLED = 0.15
SHRINK_DIAGONAL = 0.10
RIDGE = 1e-3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\r\n\x0b\x0c"
_MARKS = b".,;:?'\"()-"
_ODD = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _MARKS and c != 33)
_ENDS = b".!?"

FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "marks", "odd", "not_ascii", "space", "word_length",
    "distinct_words", "top_word", "doubled", "odd_words", "one_char_words", "long_words",
    "lines", "distinct_lines", "upper_words", "sentence_ends",
)


def statistics(text: str | None) -> list[float]:
    """The document's statistics in the order of FEATURES; rates are square-rooted to spread small ones."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    words = raw.split()
    m = len(words)
    if not m:
        return [math.log1p(n), 0.0] + [0.0] * (len(FEATURES) - 2)
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    doubled = sum(map(bytes.__eq__, words, words[1:])) / max(1, m - 1)
    odd_end = one = long = upper_words = ends = 0
    for w, c in counts.items():
        size, last = len(w), w[-1]
        if last in _ODD:
            odd_end += c
        elif last in _ENDS:
            ends += c
        if size == 1:
            one += c
        else:
            if size > 18:
                long += c
            if w[0] in _UPPER and w[1] in _UPPER:
                upper_words += c
    ascii_only = len(raw.decode("utf-8", "surrogatepass").encode("ascii", "ignore"))
    root = math.sqrt
    return [
        math.log1p(n), math.log1p(m), root(share(_UPPER)), root(share(_DIGIT)), root(share(_MARKS)),
        root(share(_ODD)), root((n - ascii_only) / n), root(share(_SPACE)), math.log1p((n - m) / m),
        # a longer text repeats its words more: the exponent takes the length out
        (len(counts) / m) ** (1 / (1 + 0.15 * math.log1p(m))), root(max(counts.values()) / m), root(doubled),
        root(odd_end / m), root(one / m), root(long / m), root(len(lines) / m), len({*lines}) / len(lines),
        root(upper_words / m), root(ends / m),
    ]


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``f``, the statistics."""
    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tidy()
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts], dtype=object)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), stats(F.col(text)).alias("f"))


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def class_sums(labelled: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Rows, sum and sum of outer products of ``f`` per ``label``, by one row a task and class."""
    d = len(FEATURES)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {k: np.zeros((d + 1, d + 1)) for k in (0, 1)}
        for b in batches:
            if len(b):
                x = np.column_stack([np.ones(len(b)), np.stack(b["f"].to_numpy())])
                y = b["label"].to_numpy()
                for k in (0, 1):
                    total[k] += x[y == k].T @ x[y == k]
        for k, t in total.items():
            yield pd.DataFrame({"label": k, "at": np.arange(t.size), "value": t.ravel()})

    out = {k: np.zeros((d + 1) * (d + 1)) for k in (0, 1)}
    summed = labelled.select("f", "label").mapInPandas(sums, "label int, at int, value double")
    for label, at, value in summed.groupBy("label", "at").agg(F.sum("value")).collect():
        out[label][at] = value
    result = {}
    for k, flat in out.items():
        t = flat.reshape(d + 1, d + 1)
        result[k] = (int(round(t[0, 0])), t[0, 1:], t[1:, 1:])
    return result


class Model:
    """Class means and Cholesky factors; scores a matrix of statistics."""

    def __init__(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray]],
                 pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL):
        self.n = {k: sums[k][0] for k in (0, 1)}
        total = self.n[0] + self.n[1]
        self.share = (self.n[1] + 1) / (total + 2)
        self.classes = []
        if not self.n[0] or not self.n[1]:
            return
        mean = {k: sums[k][1] / self.n[k] for k in (0, 1)}
        cov = {k: sums[k][2] / self.n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)}
        common = sum(cov[k] * self.n[k] for k in (0, 1)) / total
        # statistics in units of their pooled spread, so that one ridge suits all
        self.scale = 1 / np.sqrt(np.maximum(np.diag(common), 1e-8))
        unit = lambda c: c * np.outer(self.scale, self.scale)
        for k in (0, 1):
            own = (1 - pooled) * unit(cov[k]) + pooled * unit(common)
            own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + RIDGE * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            constant = math.log(self.n[k] / total) - np.log(np.diag(factor)).sum()
            self.classes.append((mean[k] * self.scale, np.linalg.inv(factor), constant))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        log = []
        for mean, inverse, constant in self.classes:
            z = (x * self.scale - mean) @ inverse.T
            log.append(constant - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id") -> Model:
    """Model from all rows that are not held out and have a label."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("label in (0, 1)").groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    return Model(class_sums(stats.where(~held_out()).join(known, "doc_id")))


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with ``score`` instead of ``f``."""
    @F.pandas_udf("double")
    def score(f: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(f.to_numpy())) if len(f) else [], dtype="float64")

    rest = [c for c in stats.columns if c != "f"]
    return stats.select(*rest, score("f").alias("score"))


def text_score(model: Model):
    """A function from a text column to its score."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tidy()
        for texts in batches:
            x = np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x), dtype="float64")

    return score


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted per document."""
    stats = written(document_statistics(docs), "quality-stats")
    out = scores(stats, fit(stats, labels, label))
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
