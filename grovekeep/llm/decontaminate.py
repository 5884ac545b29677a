"""Benchmark decontamination by template canonicalisation.

Words of a text become a template: numbers, units of measure and names give way to
typed placeholders, other words are lower-cased without punctuation at their ends.
Windows of five template words of documents are joined by hash with those of the
benchmark, and windows of the words themselves, so that what is copied is found in
any context; items shorter than a window are joined by windows of their own length,
items of hardly any plain words by the words themselves only.  Matches on one alignment belong together; they count only if the
values in the placeholders are consistent, each value of the benchmark standing
for one value of the document, the most frequent one, or for itself.  That finds copies of a question and the same
question with other numbers and names.

A capital word at the start of a sentence may be a name or not: unless it is a common
opening word, windows that touch it come in both forms, in items and in documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import kept
from .common import text_key, unused, whole_text
from .textarrays import mix, slices

# Units of measure, in lower case.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters degree degrees percent % "
    "dollar dollars cent cents euro euros usd eur mph kmh km/h hz khz mhz ghz w kw watt watts v volt volts j joule joules kb mb gb tb".split()
)
# Number words ("one" is as often a pronoun), in lower case.
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ONES = "one two three four five six seven eight nine".split()
NUMBER_WORDS = frozenset(
    "zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion".split()
    + ONES[1:] + TENS + [f"{ten}-{one}" for ten in TENS for one in ONES]
)
# Words that open sentences and are no names, in lower case.
OPENERS = frozenset(
    "a about after all also an and another any are as assume at because before both but by calculate can compute consider could did do does "
    "during each either every explain find first for from give given had has have he her here his how however i if in into is it its last let "
    "many more most my next no not now of on once one only or other our out over she should show since so some such suppose than that the "
    "their then there these they this those though through to today under until was we were what when where which while who whose why will "
    "with without would yes yesterday yet you your".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*\Z")
NUMBER_UNIT = re.compile(r"([+-]?[$€£]?\d[\d.,:/]*)([^\W\d_]+|%)\Z")
TRIM = "!\"#&'()*,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—、。，．！？：；（）［］｛｝「」『』【】〔〕《》〈〉・〜～"
TOKEN = re.compile(r"\n|\S+")
# Scripts written without spaces, and their punctuation: each character is a word.
UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    "\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff9f\U00020000-\U0003ffff"
)
ANY_TOKEN = re.compile(rf"\n|[{UNSPACED}]|[^\s{UNSPACED}]+")
ENDS = (".", "!", "?", ":", "…", "。", "！", "？", "：")

WINDOW = 5
LITERALS = 3  # windows with fewer plain words say too little
EXACT = 16  # added to the kind of windows of the words themselves
FILTER_BITS = (16, 26)  # least and most low bits in the bitmap of window hashes

_WORD, _NUMBER, _UNIT, _NAME, _NOTHING = range(5)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class Words(dict):
    """Number of each token, with what it stands for at the start of a sentence and inside; forgotten when full."""

    SIZE = 600_000

    def __init__(self, size: int) -> None:
        super().__init__()
        self.template = np.zeros(size, np.uint64)
        self.value = np.zeros(size, np.uint64)
        self.kind = np.zeros(size, np.uint8)
        self.capital = np.zeros(size, bool)
        self.opener = np.zeros(size, bool)
        self.ends = np.zeros(size, bool)

    def __missing__(self, token: str) -> int:
        at = len(self)
        word = token.strip(TRIM)
        plain = word.lower()
        self.ends[at] = token == "\n" or token.rstrip("\"')]}»”’").endswith(ENDS)
        if not word:
            self.kind[at] = _NOTHING
        elif plain in NUMBER_WORDS or not word.isalpha() and (NUMBER.match(word) or NUMBER_UNIT.match(word)):
            self.kind[at] = _NUMBER
        elif plain in UNITS and word not in ("in", "s", "h", "m", "l", "g", "v", "w", "j", "min", "second", "a"):
            self.kind[at] = _UNIT
        else:
            self.kind[at] = _WORD
            self.capital[at] = len(word) > 1 and word[0].isupper() and word[1:] == word[1:].lower()
            self.opener[at] = plain in OPENERS
        self.template[at] = self.value[at] = _hash(plain)
        self[token] = at
        return at


_PLACEHOLDERS = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_words: list[Words] = []


def _of(size: int) -> Words:
    """The words known so far, with room for ``size`` more."""
    if not _words or len(_words[0]) + size > Words.SIZE:
        _words[:] = [Words(max(Words.SIZE, size + 1))]
    return _words[0]


def template(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Template words of all texts as hashes, whether each is a placeholder, the hash of the word itself, its text's number,
    and whether it may be a name as well, being capital at the start of a sentence."""
    split = [(TOKEN if text.isascii() else ANY_TOKEN).findall(text) for text in texts]
    counts = np.array([len(t) for t in split], np.int64)
    words = _of(int(counts.sum()))
    ids = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = np.ones(len(ids), bool)
    starts[1:] = words.ends[ids][:-1] | (owner[1:] != owner[:-1])
    kind = np.where(words.capital[ids] & ~starts, _NAME, words.kind[ids])
    maybe = words.capital[ids] & starts & ~words.opener[ids]
    shown = kind != _NOTHING
    ids, kind, owner, maybe = ids[shown], kind[shown], owner[shown], maybe[shown]
    slot = kind != _WORD
    return np.where(slot, _PLACEHOLDERS[kind % 4], words.template[ids]), slot, words.value[ids], owner, maybe


def _hashed(words: np.ndarray, at: np.ndarray, size: int, kind: int) -> np.ndarray:
    total = np.full(len(at), kind, np.uint64)
    for i in range(size):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + words[at + i])
    return total


def windows(texts: list[str], kinds: frozenset[int] | None = None) -> tuple[np.ndarray, ...]:
    """Windows of the texts: text's number, hash, place, the values in it (0 where it has a plain word), and kind.

    The kind is the number of words for windows of template words, and that plus ``EXACT``
    for windows of the words themselves, which have no values.  Without ``kinds`` the texts
    are items: an item with fewer words than a window is one window; each telling window comes
    in both kinds, as a word may be a name in one context and none in another, and an item
    without a telling window has all its exact ones.  A window with a capital word at the start of
    a sentence comes with that word and with a name in its place; of an item it counts if both tell,
    or if no window of the item is such.  With ``kinds`` the texts are documents
    and have all windows of these kinds, those shorter than ``WINDOW`` once each.
    """
    words, slot, value, owner, maybe = template(texts)
    # The same with names in place of the capital words at starts.
    named, named_slot = np.where(maybe, _PLACEHOLDERS[_NAME % 4], words), slot | maybe
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    found = []
    for size in range(1, WINDOW + 1):
        n = len(words) - size + 1
        if n <= 0:
            break
        if kinds is None:
            whole = counts[owner[:n]] >= size if size == WINDOW else counts[owner[:n]] == size
        elif size in kinds or size + EXACT in kinds:
            whole = np.ones(n, bool)
        else:
            continue
        at = np.flatnonzero(whole & (owner[:n] == owner[size - 1 :]))
        literal = np.zeros(len(at), np.int64)
        open_words = np.zeros(len(at), np.int64)
        for i in range(size):
            literal += ~slot[at + i]
            open_words += maybe[at + i]
        telling = literal >= min(LITERALS, size)
        both = literal - open_words >= min(LITERALS, size)
        exact = None
        if kinds is None:
            # An item's windows are those that tell in either form, if it has such.
            none = np.bincount(owner[at[both]], minlength=len(texts)) == 0
            telling &= both | none[owner[at]]
            none = np.bincount(owner[at[telling]], minlength=len(texts)) == 0
            exact = telling | none[owner[at]]
        for kind in (size, size + EXACT):
            if kinds is not None and kind not in kinds:
                continue
            if kind == size:
                forms = [(words, slot, at[telling]), (named, named_slot, at[both & (open_words > 0)])]
                here = np.concatenate([chosen for _, _, chosen in forms])
                total = np.concatenate([_hashed(form, chosen, size, kind) for form, _, chosen in forms])
                values = np.zeros((len(here), WINDOW), np.uint64)
                for i in range(size):
                    values[:, i] = np.concatenate([np.where(taken[chosen + i], value[chosen + i], 0) for _, taken, chosen in forms])
            else:
                here = at if exact is None else at[exact]
                total = _hashed(value, here, size, kind)
                values = np.zeros((len(here), WINDOW), np.uint64)
            if kinds is not None and size < WINDOW:
                # An item of this size has one window: any place that has it, with these values, will do.
                own = np.column_stack([owner[here].astype(np.uint64), total, values[:, :size]])
                once = np.sort(np.unique(own, axis=0, return_index=True)[1])
                here, total, values = here[once], total[once], values[once]
            found.append((owner[here], total, here - first[owner[here]], values, np.full(len(here), kind, np.int32)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, WINDOW), np.uint64), np.zeros(0, np.int32)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


ROWS = "window bigint, place int, slots array<bigint>, kind int"


def _rows(keys: list[str], kinds: frozenset[int] | None = None, bitmap: np.ndarray | None = None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                owner, hashes, places, slots, kind = windows([t or "" for t in batch.column("text").to_pylist()], kinds)
                if bitmap is not None:
                    bit = (hashes & np.uint64(64 * len(bitmap) - 1)).astype(np.int64)
                    hit = (bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
                    owner, hashes, places, slots, kind = (x[hit] for x in (owner, hashes, places, slots, kind))
                # Of an item, every place has an exact window.
                totals = np.bincount(owner[kind > EXACT], minlength=batch.num_rows)[owner]
                flat = pa.FixedSizeListArray.from_arrays(pa.array(slots.reshape(-1).view(np.int64)), WINDOW).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(pa.array(owner)) for k in keys], pa.array(hashes.view(np.int64)),
                     pa.array(places.astype(np.int32)), flat, pa.array(kind), pa.array(totals.astype(np.int32))],
                    names=[*keys, "window", "place", "slots", "kind", "total"],
                )

    return rows


def _bitmap(asked: DataFrame) -> np.ndarray:
    """Which low bits of window hashes the benchmark has: some eight bits a window, within ``FILTER_BITS``."""
    bits = min(max((8 * asked.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    low = F.col("window").bitwiseAND(F.lit((1 << bits) - 1))
    words = asked.groupBy(F.shiftright(low, 6).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(window & 63L AS int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bitmap


def _agreeing(lines: Column) -> Column:
    """The windows of one alignment whose values all agree with the most frequent binding of each value, or are all identical.

    Each slot of the item counts once, in however many windows it is; of equally frequent
    bindings the one to the same value goes first.
    """
    slots = F.array_distinct(F.flatten(F.transform(lines, lambda w: w["pairs"])))
    bound = F.array_distinct(F.transform(slots, lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b"))))
    values = F.array_distinct(F.transform(bound, lambda z: z["a"]))

    def most(value: Column) -> Column:
        own = F.filter(bound, lambda z: z["a"] == value)
        often = F.transform(own, lambda z: F.struct(
            F.size(F.filter(slots, lambda y: (y["a"] == z["a"]) & (y["b"] == z["b"]))).alias("n"), (z["a"] == z["b"]).alias("same"), z["b"].alias("b")))
        return F.struct(value.alias("a"), F.array_max(often)["b"].alias("b"))

    chosen = F.transform(values, most)
    kept_lines = F.filter(lines, lambda w: F.forall(w["pairs"], lambda z: z["a"] == z["b"]) | F.forall(
        w["pairs"], lambda z: F.array_contains(chosen, F.struct(z["a"].alias("a"), z["b"].alias("b")))))
    return F.when(F.size(values) == F.size(bound), lines).otherwise(kept_lines)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.8) -> DataFrame:
    """Rows of ``docs`` that hold a benchmark item or one with other values: doc_id, text_key, item_id, matched, total, coverage.

    Of an item's telling windows, or of all its windows if none is telling, at least the
    share ``least`` has to occur in the document at places of one alignment or of several, without the places that contradict the values of their alignment.
    Null texts and texts without words match nothing; repeated documents give one row per item,
    repeated items (doc_id and item_id alike) are taken as one; empty tables give an
    empty result; further columns are not read.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), whole_text().cast("string").alias("text")).distinct()
    asked = items.mapInArrow(_rows(["item_id"]), f"item_id bigint, {ROWS}, total int")
    asked = kept(asked.select("item_id", "window", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "kind", "total"), "template-items")
    # Ten kinds at most.
    kinds = frozenset(r["kind"] for r in asked.select("kind").distinct().collect())
    asked = asked.drop("kind")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), whole_text().cast("string").alias("text"))
    met = rows.mapInArrow(_rows(["doc_id", "text_key"], kinds, _bitmap(asked)), f"doc_id bigint, text_key bigint, {ROWS}, total int").drop("kind", "total")
    joined = met.join(asked, "window")
    zipped = F.transform(F.arrays_zip("item_slots", "slots"), lambda z, i: F.struct((F.col("item_place") + i).alias("p"), z["item_slots"].alias("a"), z["slots"].alias("b")))
    line = F.struct("item_place", F.filter(zipped, lambda z: z["a"] != 0).alias("pairs"))
    # Repeated rows of a document meet here.  An item's places bound every list.
    lines = joined.groupBy("doc_id", "text_key", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).agg(
        F.collect_set(line).alias("lines"), F.max("total").alias("total"))
    places = lines.select("doc_id", "text_key", "item_id", "total", F.explode(_agreeing(F.col("lines"))["item_place"]).alias("place"))
    counted = places.groupBy("doc_id", "text_key", "item_id").agg(F.countDistinct("place").alias("matched"), F.max("total").cast("bigint").alias("total"))
    scored = counted.withColumn("coverage", F.col("matched") / F.col("total"))
    return scored.where(F.col("matched") >= F.lit(float(least)) * F.col("total") - 1e-9)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    of, key, here, key_here = unused(docs, "id", "key", "id_here", "key_here")
    bad = contaminated(docs, benchmark, least=least).select(F.col("doc_id").alias(of), F.col("text_key").alias(key)).distinct()
    rows = docs.withColumns({here: F.col("doc_id").cast("bigint"), key_here: text_key()})
    match = F.col(here).eqNullSafe(F.col(of)) & (F.col(key_here) == F.col(key))
    return rows.join(bad, match, "left_anti").select(*[f"`{c}`" for c in docs.columns])
