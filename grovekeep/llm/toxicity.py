"""Toxicity from a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lowers case, takes accents off, replaces look-alike letters of other
scripts and digits or signs that stand for letters, and trims punctuation off
the ends of words.  Lexicon entries are whole words or beginnings of words; a
match inside a match of an exception phrase does not count.  The sum of weights,
normalised by length, is turned into a probability by a rising step function
fitted to labelled rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import kept
from .common import whole_text

# Letters of other scripts by the Latin letter they look like.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "ss",
}
# Digits and signs by the letter they stand for inside a word.  1 and l both read as i.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
TRIM = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—"


class _Fold(dict):
    """Character map that works out a character when it first occurs."""

    def __missing__(self, code: int) -> str:
        letters = []
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            if not unicodedata.combining(c) and unicodedata.category(c) != "Cf":
                c = LOOK_ALIKES.get(c, c)
                letters.append(STAND_INS.get(c, c))
        self[code] = "".join(letters)
        return self[code]


_fold = _Fold()


def fold(text: str) -> str:
    """Folded words, one space before each and one after the last."""
    words = (w.strip(TRIM) for w in text.split())
    return " " + " ".join([w for w in words if w]).translate(_fold) + " "


@dataclass
class Settings:
    """Bounds and thresholds of the fit.

    ``sample`` labelled rows at most are read, the first in the order of a hash of their
    id, and ``entries`` lexicon entries at most are added in a round, the heaviest.
    """

    sample: int = 12_000
    entries: int = 5_000
    least_rows: int = 5
    least_share: float = 0.5
    repeats: tuple[int, ...] = (1, 2, 3, 4)  # a term may be judged by the rows that hold it so often
    prefix: tuple[int, int] = (4, 7)
    rounds: tuple[float, ...] = (0.01, 0.2)  # least part of the toxic rows not yet explained
    bins: int = 24


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    steps: list[tuple[float, float]] = field(default_factory=list)  # from this value on, this probability
    _machine: object = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._machine.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._machine.add_word(phrase, (len(phrase), None))
            self._machine.make_automaton()
        return self._machine

    def value(self, text: str) -> float:
        """Weights of the matches over 1 + log2(1 + words); 0 without a match."""
        if not self.weights and not self.exceptions:
            return 0.0
        folded = fold(text)
        hits, excused = [], []
        for end, (length, weight) in self.machine().iter(folded):
            (hits if weight is not None else excused).append((end - length + 1, end, weight))
        if excused:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in excused)]
        # Of several entries that begin at one place the heaviest counts.
        best: dict[int, float] = {}
        for start, _, weight in hits:
            best[start] = max(weight, best.get(start, 0.0))
        return sum(best.values()) / (1 + math.log2(1 + folded.count(" ")))

    def score(self, text: str) -> float:
        value = self.value(text)
        out = 0.5
        for least, probability in self.steps:
            if value >= least:
                out = probability
        return out


def _chosen(labels: DataFrame, sample: int) -> DataFrame:
    known = labels.select("doc_id", F.col("label").cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
    return known.groupBy("doc_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def _terms(settings: Settings):
    low, high = settings.prefix

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Folded words and beginnings of words of each text, with how often they occur, up to the highest of ``repeats``."""
        most = max(settings.repeats)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("_label").to_pylist(), strict=True):
                found: Counter[str] = Counter()
                for word, times in Counter(fold(text).split()).items():
                    found[f" {word} "] += times
                    for size in range(low, min(high + 1, len(word))):
                        found[f" {word[:size]}"] += times
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(found), pa.string()), pa.array([label] * len(found), pa.int32()),
                        pa.array([min(n, most) for n in found.values()], pa.int32()),
                    ],
                    names=["term", "label", "times"],
                )

    return terms


def _chosen_terms(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Terms with their weights, without beginnings that a longer one stands for, and without what a kept beginning covers."""
    longest: dict[str, int] = {}
    for term, (n, _) in found.items():
        for size in range(1, len(term)):
            longest[term[:size]] = max(n, longest.get(term[:size], 0))
    weights: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t.rstrip(" ")), t)):
        stem = term.rstrip(" ")
        covered = any(stem[:size] in weights for size in range(2, len(stem) + 1))
        if not covered and (term.endswith(" ") or longest.get(term, 0) < 0.95 * found[term][0]):
            weights[term] = found[term][1]
    return weights


def _sure_share(toxic: Column, clean: Column) -> Column:
    """Lower bound (Wilson, two standard deviations) of the share of toxic rows among those with a term; null without any."""
    n = F.nullif(toxic + clean, F.lit(0))
    part = toxic / n
    return (part + 2 / n - 2 * F.sqrt(part * (1 - part) / n + 1 / (n * n))) / (1 + 4 / n)


def _values(lexicon: Lexicon):
    def value(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.value(t) for t in texts], dtype=float)

    return value


def fit_lexicon(
    docs: DataFrame, labels: DataFrame, *, exceptions: list[str] = (), settings: Settings | None = None
) -> Lexicon:
    """Learn a lexicon from ``labels`` (doc_id, label 0 or 1) and the texts of ``docs``.

    A term is an entry if rows that hold it, or hold it several times, are toxic for the most
    part, with confidence; its weight is the log odds of holding it.  Of a word's
    beginnings the longest one is kept that still stands for the same rows.  Words that
    begin like an entry but occur in rows that are not toxic become exceptions, beside
    the phrases given.  Null labels are left out, null texts are empty, repeated labels
    count once, and so does a text.  Without labelled rows the lexicon is empty and every score is one half.
    """
    s = settings or Settings()
    rows = docs.select("doc_id", whole_text().cast("string").alias("text")).join(F.broadcast(_chosen(labels, s.sample)), "doc_id")
    rows = kept(rows.select("text", "_label", F.xxhash64("text").alias("_key")).dropDuplicates(["_key"]), "toxic-sample")
    given = [fold(p) for p in exceptions]
    lexicon = Lexicon({}, list(given))
    value = F.pandas_udf(_values(lexicon), "double")
    # What a round has explained says nothing about further terms: words that stand
    # beside an entry in copies of one text are no entries.
    for share in s.rounds:
        left = rows.where((F.col("_label") == 0) | (value("text") <= 0)) if lexicon.weights else rows
        totals = left.agg(F.sum("_label").alias("toxic"), F.count(F.lit(1)).alias("rows")).first()
        toxic, clean = int(totals["toxic"] or 0), int(totals["rows"]) - int(totals["toxic"] or 0)
        least = max(s.least_rows, share * toxic)
        if toxic < least:
            continue
        terms = left.select("text", "_label").mapInArrow(_terms(s), "term string, label int, times int")
        often = [(k, (F.col("times") >= k).cast("int")) for k in s.repeats]
        counted = terms.groupBy("term").agg(
            F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"),
            *[F.sum(F.col("label") * held).alias(f"toxic_{k}") for k, held in often],
            *[F.sum((1 - F.col("label")) * held).alias(f"clean_{k}") for k, held in often],
        )
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
        telling = F.lit(False)
        for k in s.repeats:
            telling |= F.coalesce((F.col(f"toxic_{k}") >= least) & (_sure_share(F.col(f"toxic_{k}"), F.col(f"clean_{k}")) >= s.least_share), F.lit(False))
        heavy = counted.withColumn("odds", odds).where(telling & (F.col("odds") > 0)).orderBy(F.desc("odds"), "term").limit(s.entries).collect()
        found = {r["term"]: (r["toxic"], float(r["odds"])) for r in heavy}
        lexicon = Lexicon({**_chosen_terms(found), **lexicon.weights}, list(given))
        value = F.pandas_udf(_values(lexicon), "double")
    if rows.isEmpty():
        return lexicon
    weights = lexicon.weights
    totals = rows.agg(F.sum("_label").alias("toxic"), F.count(F.lit(1)).alias("rows")).first()
    toxic, clean = int(totals["toxic"] or 0), int(totals["rows"]) - int(totals["toxic"] or 0)
    # Words of clean rows that begin like an entry.
    stems = [t for t in weights if not t.endswith(" ")]
    if stems:
        begins = F.lit(False)
        for size in sorted({len(t) for t in stems}):
            begins |= F.substring("term", 1, size).isin([t for t in stems if len(t) == size])
        words = rows.select("text", "_label").mapInArrow(_terms(Settings(prefix=(1, 0))), "term string, label int, times int")
        counted = words.groupBy("term").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
        benign = counted.where(F.col("term").endswith(" ") & begins & (F.col("clean") >= 2) & (F.col("clean") * toxic > F.col("toxic") * clean))
        lexicon.exceptions += [r["term"] for r in benign.orderBy(F.desc("clean"), "term").limit(s.entries).collect()]
        value = F.pandas_udf(_values(lexicon), "double")
    # At most `sample` values come back, rounded so that equal ones meet.
    values = rows.select(F.round(value("text"), 3).alias("v"), "_label").groupBy("v").agg(
        F.sum("_label").alias("toxic"), F.count(F.lit(1)).alias("rows")).orderBy("v").collect()
    lexicon.steps = _rising([(r["v"], r["toxic"], r["rows"]) for r in values], s.bins)
    return lexicon


def _rising(values: list[tuple[float, int, int]], bins: int) -> list[tuple[float, float]]:
    """Rising step function through the shares of label 1: equal-sized bins, neighbours that fall pooled."""
    zero, rest = [v for v in values if v[0] <= 0], [v for v in values if v[0] > 0]
    per_bin, blocks, now = max(1, sum(v[2] for v in rest) // bins), [], []
    if zero:
        blocks.append([0.0, sum(v[1] for v in zero), sum(v[2] for v in zero)])
    for v in rest:
        now.append(v)
        if sum(x[2] for x in now) >= per_bin:
            blocks.append([now[0][0], sum(x[1] for x in now), sum(x[2] for x in now)])
            now = []
    if now:
        blocks.append([now[0][0], sum(x[1] for x in now), sum(x[2] for x in now)])
    pooled: list[list[float]] = []
    for b in blocks:
        pooled.append(list(b))
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            last = pooled.pop()
            pooled[-1][1] += last[1]
            pooled[-1][2] += last[2]
    if not pooled:
        return []
    steps = [(float(v), (t + 0.5) / (n + 1)) for v, t, n in pooled]
    return [(0.0, steps[0][1]), *steps[1:]]


def score_toxicity(lexicon: Lexicon, docs: DataFrame) -> DataFrame:
    """doc_id, value (normalised weight), score (0 to 1) and predicted (score of 0.3 or more) per row of ``docs``.

    A null or empty text has no match and the score of texts without one.
    """

    @F.pandas_udf("value double, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        values = [lexicon.value(t) for t in texts]
        least = np.array([a for a, _ in lexicon.steps])
        chance = np.array([b for _, b in lexicon.steps]) if lexicon.steps else np.array([0.5])
        # Scores within one step rise a little with the value, so that ranks are kept.
        at = np.maximum(np.searchsorted(least, values, "right") - 1, 0) if len(least) else np.zeros(len(values), int)
        scores = np.clip(chance[at] + 1e-6 * np.minimum(values, 100), 0, 1)
        return pd.DataFrame({"value": np.array(values, float), "score": scores})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), score(whole_text().cast("string")).alias("_s"))
    rows = rows.select("doc_id", "_s.value", "_s.score")
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
