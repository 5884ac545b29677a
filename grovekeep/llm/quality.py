"""Quality classifier: a factorisation machine over words, structure and metadata.

Features of a text: hashed words (square roots of their counts, of unit length in
all), structure statistics cut into bins, and metadata columns cut into bins by
powers of two.  A score is a bias, a weight per feature and the pairwise terms
of low rank, which the identity sum_{i<j} <v_i, v_j> x_i x_j =
(|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2 gives in time linear in the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key, whole_text
from .textarrays import running, shingle_hashes, slices, span_hashes, text_bytes, word_spans, LOWER

WORDS = 4096
BINS = 8
META = 40
STATS = (
    "bytes", "words", "word_length", "upper", "digit", "punctuation", "exclaim", "bar", "symbol", "lines",
    "other_script", "distinct", "repeat_next", "repeat_run",
)


@dataclass
class Settings:
    """``sample`` labelled rows at most are fitted, the first in the order of a hash of their id."""

    sample: int = 6000
    rank: int = 8
    epochs: int = 12
    batch: int = 256
    rate: float = 0.02
    decay: float = 1e-5
    seed: int = 7


@dataclass
class Model:
    edges: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    meta: list[str] = field(default_factory=list)


def _fractions(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(member[data])))
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def _members(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_UPPER = _members(bytes(range(65, 91)))
_DIGIT = _members(b"0123456789")
_PUNCTUATION = _members(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SYMBOL = _members(b"#$%&*+<=>@\\^_`{}~")
_HIGH = _members(bytes(range(128, 256)))


def describe(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word features (rows by ``WORDS``) and structure statistics (rows by ``STATS``) of some texts."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    starts, ends = word_spans(data, offsets)
    words = span_hashes(running(LOWER[data]), starts, ends)
    counts = np.diff(np.searchsorted(starts, offsets))
    owner = np.repeat(np.arange(n), counts)
    bag = np.bincount(owner * WORDS + (words % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS)
    bag = bag.reshape(n, WORDS).astype(np.float32)
    np.sqrt(bag, out=bag)
    bag /= np.maximum(np.sqrt(np.einsum("ij,ij->i", bag, bag)), 1e-9)[:, None]

    def distinct(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Distinct values as a part of all, per text."""
        of = np.repeat(np.arange(n), own)
        order = np.lexsort((hashes, of))
        h, d = hashes[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[new], minlength=n) / np.maximum(own, 1)

    following = np.zeros(len(words), bool)
    following[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    sizes = np.diff(offsets)
    stats = [
        np.log1p(sizes), np.log1p(counts), np.bincount(owner, ends - starts, minlength=n) / np.maximum(counts, 1),
        *[_fractions(data, offsets, m) for m in (
            _UPPER, _DIGIT, _PUNCTUATION, _members(b"!"), _members(b"|"), _SYMBOL, _members(b"\n"), _HIGH)],
        distinct(words, counts), np.bincount(owner, following, minlength=n) / np.maximum(counts, 1),
        distinct(*shingle_hashes(words, counts, 3)),
    ]
    return bag, np.stack(stats, axis=1)


def _one_hot(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    n, kinds = stats.shape
    out = np.zeros((n, kinds * BINS), np.float32)
    for k in range(kinds):
        bins = np.searchsorted(edges[k], stats[:, k], "right")
        out[np.arange(n), k * BINS + bins] = 1
    return out


def _meta(columns: list[np.ndarray], n: int) -> np.ndarray:
    """Each metadata value by the power of two it reaches; absent values have a bin of their own."""
    out = np.zeros((n, len(columns) * META), np.float32)
    for k, values in enumerate(columns):
        known = np.isfinite(values)
        level = np.log2(np.maximum(np.where(known, values, 0), 0) + 1).astype(np.int64) + 1
        out[np.arange(n), k * META + np.where(known, np.minimum(level, META - 1), 0)] = 1
    return out


def _inputs(texts: pa.Array, meta: list[np.ndarray], edges: np.ndarray) -> np.ndarray:
    bag, stats = describe(texts)
    return np.concatenate([bag, _one_hot(stats, edges), _meta(meta, len(texts))], axis=1)


@dataclass
class Sample:
    """The rows of the fit: sparse words, bins of the other features; made dense a few rows at a time."""

    bounds: np.ndarray
    at: np.ndarray
    value: np.ndarray
    rest: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.rest), WORDS + self.rest.shape[1]

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.shape[1]), np.float32)
        lengths = self.bounds[rows + 1] - self.bounds[rows]
        of = np.repeat(np.arange(len(rows)), lengths)
        places = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.bounds[rows], lengths)
        out[of, self.at[places]] = self.value[places]
        out[:, WORDS:] = self.rest[rows]
        return out


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _raw(x: np.ndarray, model: Model) -> np.ndarray:
    crossed = x @ model.factors
    return model.bias + x @ model.weights + 0.5 * ((crossed**2).sum(1) - (x**2) @ (model.factors**2).sum(1))


def _fit(x: Sample, y: np.ndarray, edges: np.ndarray, meta: list[str], s: Settings) -> Model:
    """Adam on the logistic loss, rows in a fixed random order."""
    random = np.random.default_rng(s.seed)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Model(edges, float(np.log(share / (1 - share))), np.zeros(x.shape[1], np.float32),
                  random.normal(0, 0.01, (x.shape[1], s.rank)).astype(np.float32), meta)
    moments = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros_like(model.factors), np.zeros_like(model.factors), 0.0, 0.0]
    step = 0
    for _ in range(s.epochs):
        order = random.permutation(len(y))
        for at in range(0, len(y), s.batch):
            rows = order[at : at + s.batch]
            b = x[rows]
            step += 1
            off = (_sigmoid(_raw(b, model)) - y[rows]).astype(np.float32) / len(rows)
            gradients = (
                off @ b + s.decay * model.weights,
                b.T @ (off[:, None] * (b @ model.factors)) - ((off @ (b * b))[:, None]) * model.factors + s.decay * model.factors,
                float(off.sum()),
            )
            steps = []
            for i, g in enumerate(gradients):
                m, v = moments[2 * i], moments[2 * i + 1]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                moments[2 * i], moments[2 * i + 1] = m, v
                steps.append(s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            model.weights = model.weights - steps[0]
            model.factors = model.factors - steps[1]
            model.bias -= float(steps[2])
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, *, meta: list[str] = ("n_chars",), settings: Settings | None = None) -> Model:
    """Fit on ``labels`` (doc_id, label 0 or 1) and the texts of ``docs``.

    At most ``settings.sample`` labelled rows are used, chosen by a hash of their id; a
    sample is what passes through the driver, as sparse rows.  Rows without a text
    count as empty ones, null labels are left out, and a repeated label counts once.
    Without labelled rows the model gives one half to every text.
    """
    s, meta = settings or Settings(), [c for c in meta if c in docs.columns]
    chosen = (
        labels.select("doc_id", F.col("label").cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
        .groupBy("doc_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    )
    # The sample is bounded by the parameter, so it may be broadcast.
    rows = docs.select("doc_id", whole_text().alias("text"), *[F.col(c).cast("double").alias(f"_meta{i}") for i, c in enumerate(meta)])
    rows = rows.join(F.broadcast(chosen), "doc_id")
    names = [f"_meta{i}" for i in range(len(meta))]
    out = "doc_id bigint, label int, at array<int>, value array<float>, stats array<double>, " + "meta array<double>"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Few rows at a time: their words are dense for a moment.
            for batch in (part.slice(i, 256) for part in slices(whole, "text") for i in range(0, part.num_rows, 256)):
                bag, stats = describe(batch.column("text"))
                at = [np.flatnonzero(r).astype(np.int32) for r in bag]
                extra = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1) if names else np.zeros((len(bag), 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), batch.column("_label").cast(pa.int32()),
                     pa.array(at, pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(bag, at, strict=True)], pa.list_(pa.float32())),
                     pa.array(list(stats), pa.list_(pa.float64())), pa.array(list(extra), pa.list_(pa.float64()))],
                    names=["doc_id", "label", "at", "value", "stats", "meta"],
                )

    # Repeated rows of one id count once, before anything reaches the driver: the one of the least text_key, then of the least metadata.
    row = F.struct("text", "_label", *names)
    one = rows.groupBy("doc_id").agg(F.min_by(row, F.struct(text_key(), *names)).alias("_row"))
    got = one.select("doc_id", "_row.*").mapInArrow(features, out)
    table = got.toArrow().sort_by([("doc_id", "ascending")])
    ids = table.column("doc_id").to_numpy()
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))[: s.sample] if len(ids) else np.zeros(0, int)
    if len(first) == 0:
        size = WORDS + len(STATS) * BINS + len(meta) * META
        return Model(np.zeros((len(STATS), BINS - 1)), 0.0, np.zeros(size, np.float32), np.zeros((size, s.rank), np.float32), list(meta))
    table = table.take(first)
    stats = _flat(table.column("stats")).reshape(len(first), -1)
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    extra = _flat(table.column("meta")).reshape(len(first), -1)
    rest = np.concatenate([_one_hot(stats, edges), _meta(list(extra.T), len(first))], axis=1)
    lengths = table.column("at").combine_chunks().value_lengths().to_numpy()
    bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    x = Sample(bounds, _flat(table.column("at")), _flat(table.column("value")), rest)
    return _fit(x, table.column("label").to_numpy().astype(np.float32), edges, list(meta), s)


def quality_score(model: Model, docs: DataFrame) -> Column:
    """Probability of label 1 from the whole text and the metadata columns, as a column over ``docs``.

    A null text is scored as an empty one and an absent metadata value as such; the
    same text and metadata always have the same score.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series, *meta: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        values = [m.to_numpy(float, na_value=np.nan) for m in meta]
        out, at = [np.zeros(0)], 0
        for part in slices(batch, "text"):
            for start in range(0, part.num_rows, 256):
                some = part.column("text").slice(start, 256)
                x = _inputs(some, [v[at : at + len(some)] for v in values], model.edges)
                out.append(_sigmoid(_raw(x, model)))
                at += len(some)
        return pd.Series(np.concatenate(out))

    return score(whole_text().cast("string"), *[docs[c].cast("double") for c in model.meta])


def score_quality(model: Model, docs: DataFrame) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from one half on) per row of ``docs``; see :func:`quality_score`."""
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), quality_score(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
