"""Operators on whole corpora, against brute force, and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from grovekeep.llm import decontaminate, mixing, near_dups, repeats, reshard
from grovekeep.llm.common import read, sums_before, tune

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "no id at all here", "en", "a", 17),
    (1, None, "en", None, None),
    (2, "", None, "b", 0),
    (3, " \t\n", "en", "b", 3),
    (4, "same words here, again and again.", "en", "b", 33),
    (4, "same words here, again and again.", "en", "b", 33),
    (5, "é☃𝄞 word " * 3000, "fr", "c", 27000),
]


@pytest.fixture
def odd(spark):
    docs = tune(spark).createDataFrame(ODD, DOCS)
    return docs.withColumns({"shard": F.lit(9), "_part": F.lit("x"), "text_key": F.lit("y"), "node": F.lit(1), "taken": F.lit(2)})


@pytest.fixture
def empty(spark):
    return tune(spark).createDataFrame([], DOCS)


def test_sums_before(spark):
    rows = [(i % 5, i, i * i % 7) for i in range(500)]
    got = sums_before(tune(spark).createDataFrame(rows, "a long, b long, v long"), ["a", "b"], ["v"], "t").collect()
    total, want = 0, {}
    for a, b, v in sorted(rows):
        want[a, b] = total
        total += v
    assert {(r.a, r.b): r.before_v for r in got} == want


# --- mixing ----------------------------------------------------------------------


def _targets(sizes, share=1.5, most=2.0):
    """Resharing the excess until none is above its limit, step by step."""
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weights[s] for s in sizes if s not in full)
        level = left / open_weight if open_weight else 0
        over = {s for s in sizes if s not in full and level * weights[s] >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * weights[s] for s in sizes}
        full |= over


def test_mix(spark, sf, odd, empty):
    for docs in (read(spark, sf, "documents"), odd):
        rows = docs.select("doc_id", "source", "text").collect()
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += words(r.text)
        want = _targets(sizes)
        got = mixing.mix_sources(docs).collect()
        assert len(got) == len(rows)
        taken, source = collections.Counter(), {(r.doc_id, words(r.text)): r.source for r in rows}
        for r in got:
            s = source[r.doc_id, r.size]
            taken[s] += r.taken
            assert r.source_size == sizes[s]
            assert r.target == pytest.approx(want[s])
            assert 0 <= r.taken <= 2 * r.size
        assert all(taken[s] == int(want[s] + 1e-6) for s in sizes)
        mixed = mixing.take_mixture(docs, mixing.mix_sources(docs))
        assert mixed.columns == docs.columns
        assert mixed.agg(F.sum(mixing.n_words())).first()[0] == sum(taken.values())
        assert mixed.where(F.col("n_chars") != F.length("text")).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.take_mixture(empty, mixing.mix_sources(empty)).count() == 0


# --- resharding ------------------------------------------------------------------


def test_flow_moves_least():
    def cheapest(sizes, capacities, cost):
        """All ways, one byte at a time."""
        if not sum(sizes):
            return 0
        i = next(k for k, s in enumerate(sizes) if s)
        rest = [s - (k == i) for k, s in enumerate(sizes)]
        return min(cost(i, j) + cheapest(rest, [c - (k == j) for k, c in enumerate(capacities)], cost) for j in range(len(capacities)) if capacities[j])

    rng = random.Random(3)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        sizes = [rng.randint(0, 2) for _ in range(n)]
        capacities = [rng.randint(0, 3) for _ in range(m)]
        while sum(capacities) < sum(sizes):
            capacities[rng.randrange(m)] += 1
        table = [[0 if i == j else rng.randint(1, 4) for j in range(m)] for i in range(n)]
        cost = lambda i, j, t=table: t[i][j]
        flow = reshard.cheapest_flow(sizes, capacities, cost)
        assert [sum(r) for r in flow] == sizes
        assert all(sum(r[j] for r in flow) <= capacities[j] for j in range(m))
        assert sum(cost(i, j) * flow[i][j] for i in range(n) for j in range(m)) == cheapest(sizes, capacities, cost)


def test_reshard(spark, sf, odd, empty, tmp_path):
    old = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)).cast("int")
    for docs in (read(spark, sf, "documents"), odd):
        docs = docs.withColumn("_old", old)
        got = reshard.reshard(docs, "_old", 4).collect()
        want = sorted(((r.doc_id or 0), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
        for shard in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    docs = read(spark, sf, "documents").withColumn("_old", old)
    placed = reshard.reshard(docs, "_old", 4)
    total = collections.Counter()
    for r in placed.collect():
        total[r.shard] += r.size
    assert max(total.values()) - min(total.values()) < 0.1 * sum(total.values()) / 4
    changed = reshard.rewrite_affected(spark, docs.drop("_old"), placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == placed.where(F.col("shard").isin(changed)).count()
    assert reshard.reshard(empty.withColumn("_old", F.lit(0)), "_old", 4).count() == 0


def test_identical_rows_are_rewritten_once(spark, tmp_path):
    """Identical rows that a cut separates are written as often as they are there."""
    docs = tune(spark).createDataFrame([(1, "the same text")] * 40 + [(None, "x")] * 3, "doc_id long, text string")
    placed = reshard.reshard(docs.withColumn("_old", F.lit(0)), "_old", 4)
    assert placed.select("shard").distinct().count() == 4
    reshard.rewrite_affected(spark, docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.shard, r["count"]) for r in back.groupBy("shard").count().collect()} == {(r.shard, r["count"]) for r in placed.groupBy("shard").count().collect()}


# --- repeats ---------------------------------------------------------------------


def _repeats(rows, length, keep_first=False):
    texts = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen = collections.Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    met, out = set(), []
    for i, b in texts:
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if (s in met) if keep_first else seen[s] > 1:
                covered[p : p + length] = b"\1" * length
            met.add(s)
        rest = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        out.append((i or 0, len(b), len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group", [4096, 2])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats(spark, group, keep_first):
    rng = random.Random(group)
    base = "".join(rng.choice("abcde é") for _ in range(400))
    texts = [base[a : a + rng.randint(0, 120)] + rng.choice(["", "x", base[:30], "zzzzz" * 12]) for a in (rng.randrange(350) for _ in range(60))]
    texts += [None, "", "a" * 90, base, base, base * 2, "q" + base[50:80] + "r"]
    rows = list(enumerate(texts))
    docs = tune(spark).createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = repeats.remove_repeats(docs, length=20, keep_first=keep_first, group=group).collect()
    if keep_first:
        # Where rows are as far as reading order goes alike, order is by id.
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == _repeats(rows, 20, True)
    else:
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == _repeats(rows, 20)


def test_repeats_of_frequent_anchors(spark, monkeypatch):
    """Anchors dealt over many parts give what brute force gives."""
    monkeypatch.setattr(repeats, "FREQUENT", 3)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    rows = [(i, (str(i * 7919) if i % 3 else "") + passage + "tail" * (i % 4)) for i in range(60)] + [(60, passage[:199]), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.remove_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == _repeats(rows, 200)


def test_repeats_of_table(spark, sf, odd, empty):
    for docs in (read(spark, sf, "documents"), odd):
        got = repeats.remove_repeats(docs).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == _repeats([(r.doc_id, r.text) for r in docs.collect()], 200)
    assert repeats.remove_repeats(empty).count() == 0


def test_anchors_of_long_text(monkeypatch):
    """A text taken in stretches has the anchors it has as a whole."""
    import numpy as np

    data = np.frombuffer(random.Random(5).randbytes(9000), np.uint8)
    w, offsets = repeats.Windows(200), np.array([0, 9000])
    whole = repeats.anchors_of(data, offsets, w)
    monkeypatch.setattr(repeats, "PIECE", 300)
    pieces = repeats.anchors_of(data, offsets, w)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))


# --- near duplicates -------------------------------------------------------------


def _sets(rows, size):
    out = []
    for i, t in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out.append((i, {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}))
    return out


def _components(rows, size, percent=80):
    sets = _sets(rows, size)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i or 0), len(s), (least.get(root(k)) if s else i) or 0) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("block", [2048, 3])
def test_near_groups(spark, monkeypatch, block):
    """Copies of an original with a growing number of changed words: links between some of them only."""
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(14):
            copy = list(words)
            for k in rng.sample(range(len(copy)), rng.randint(0, 9)):
                copy[k] = f"n{rng.randrange(10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, "A b"), (n + 1, "a B"), (n + 2, "one two THREE four"), (n + 3, "one two three four five"), (n + 4, ""), (n + 5, None)]
    docs = tune(spark).createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    got = near_dups.near_groups(docs, shingle=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components(rows, 4)


def test_near_groups_odd(spark, sf, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    groups = near_dups.near_groups(odd)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in groups.collect()) == _components(rows, 5)
    kept = near_dups.keep_one(odd, groups)
    assert kept.columns == odd.columns
    assert kept.count() == len(rows) - 1
    assert near_dups.near_groups(empty).count() == 0


def test_estimate():
    from types import SimpleNamespace

    assert SimpleNamespace(bits=near_dups.MINIMA // near_dups.PER_LONG).bits == 8
    assert (1 - 0.8**near_dups.ROWS) ** near_dups.BANDS < 1e-7


def test_estimated_similarity(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    texts = [" ".join(words), " ".join(words[:1800] + [f"x{i}" for i in range(200)])]
    rows = near_dups.signatures(tune(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1)
    a, b = (rows.where(F.col("doc_id") == i).select(F.col("bits").alias(f"b{i}")) for i in (0, 1))
    value = a.crossJoin(b).select(near_dups.estimated(F.col("b0"), F.col("b1"))).first()[0]
    assert abs(value - 1800 / 2200) < 0.15


# --- decontamination -------------------------------------------------------------

ITEMS = [
    (1, "Alice has 12 apples and gives 5 apples to Bob before she walks 3 km back to her house near the river."),
    (2, "The melting point of the metal sample was recorded by the old laboratory during the second winter."),
    (3, None),
]


def test_contaminated(spark):
    filler = "some words that come before and after nothing in particular here "
    docs = [
        (1, filler + ITEMS[0][1] + " " + filler),
        (2, filler + "in the end carol has 40 apples."),
        (3, filler + "today. Clara has 99 apples and gives 7 apples to Dave before she walks 8 km back to her house near the river."),
        (4, filler + "today. Clara has 99 apples and gives 7 apples to Dave before she walks 8 miles away from her office near the lake."),
        (5, filler + ITEMS[1][1].upper() + filler),
        (6, None),
        (7, ""),
    ]
    rows = tune(spark).createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, items).collect()}
    assert {(1, 1), (3, 1), (5, 2)} <= found
    assert {d for d, _ in found} == {1, 3, 5}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(rows, items).collect()) == [2, 4, 6, 7]


def test_inconsistent_values(spark):
    item = "Maria met Maria at the old market and Maria sold Maria seven small red paper boats."
    items = tune(spark).createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, item.replace("Maria", "Julia")), (2, "Maria met Julia at the old market and Clara sold Berta seven small red paper boats.")]
    rows = spark.createDataFrame([(i, "So it was. Then " + t) for i, t in docs], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(rows, items, least=0.6).collect()] == [1]


def test_partly_inconsistent_values(spark):
    """A value that is changed in one place takes the windows there from the match, not the others."""
    middle = " while the children watch from the long wooden bench beside the garden wall and count every single stone that falls into the water and "
    item = "The teacher puts 3 red balls into the first box" + middle + "then puts 3 blue balls into the second box near the door."
    ends = [("3", "3"), ("3", "4"), ("7", "9"), ("5", "5")]
    docs = [(i, "So it was. " + item.replace("3 red", f"{a} red").replace("3 blue", f"{b} blue")) for i, (a, b) in enumerate(ends)]
    short = "puts 3 red balls and 3 blue balls and 3 green balls there"
    docs += [(4, "now he " + short.replace("3 blue", "5 blue").replace("3 green", "6 green"))]
    rows = tune(spark).createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.matched, r.total) for r in decontaminate.contaminated(rows, items, least=0.0).collect()}
    whole = found[0, 1][1]
    assert found[0, 1] == found[3, 1] == (whole, whole)
    # Five windows hold the second number, four the first.
    assert found[1, 1] == (whole - 5, whole)
    assert found[2, 1] in ((whole - 5, whole), (whole - 4, whole))
    assert found[4, 2][0] < 0.8 * found[4, 2][1]
    assert {r.doc_id for r in decontaminate.contaminated(rows, items).collect()} == {0, 1, 2, 3}


SHORT_ITEMS = [
    (1, "What is 12 + 7?"), (2, "Define osmosis"), (3, "photosynthesis"), (4, "日本で一番高い山は何ですか。"), (5, "12 km 40 km 7 s 300 kg 81 m 5.5"),
    (6, "42 17"), (7, "Name three noble gases"), (8, "Explain why leaves turn red"), (9, "..."), (10, "Compare 3 large red apples tonight."),
]


def test_short_and_valued_items(spark):
    """Items shorter than a window, in a script without spaces, or without a telling window are found inside longer documents."""
    filler = "some words that come before and after nothing in particular here"
    rows = [(i, f"{filler} {t} {filler}") for i, t in SHORT_ITEMS if i != 4]
    rows += [(4, "前の文があります。次の問題は日本で一番高い山は何ですか。答えは富士山です。"), (20, filler), (21, "日本の山は高い。一番は何ですか。"),
             (22, f"{filler} 12 km 41 km 8 s 300 kg 80 m 5.5 {filler}"), (23, f"{filler} 17 42 {filler}"), (24, f"{filler} What is 30 + 9? {filler}")]
    docs = tune(spark).createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(SHORT_ITEMS, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(docs, items).collect()}
    assert all(0.8 <= c <= 1 for c in found.values())
    # Item 1 has a document with other values only if the template agrees: in 24 a name-like word starts inside a sentence.
    assert {k for k in found if k != (24, 1)} == {(i, i) for i, _ in SHORT_ITEMS if i != 9}
    assert decontaminate.contaminated(docs, items.where("item_id = 9")).count() == 0


# Each begins with a name, given as {a}; {b} is a second name and {x}, {y}, {z} are numbers.
NAMED_ITEMS = [
    "{a} writes a letter to his friends twice a week. {a} uses {x} pages for each letter. How many pages does {a} write in {y} weeks?",
    "{a} is saving money for a new wallet which costs {x} dollars. {a} has only half of the money she needs. {b} gives her {y} dollars for that purpose.",
    "{a} has a garden with flowers. {x} of them are yellow and {y} of them are purple. {a} sold {z} of the purple ones. {a} kept the rest.",
    "{a} bakes {x} loaves of bread every morning. {a} sells {y} of the loaves at the market. The rest are given to {b} for free.",
    "{a} walked {x} miles on the first day of the trip. {b} walked {y} miles on the same day. How much farther did one of them walk?",
    "{a} read {x} pages of the book yesterday. Today {a} read twice as many pages as before. {a} wants to finish half of what remains.",
    "{a} picked {x} baskets of ripe apples in the orchard. {b} picked {y} baskets less than that. Every basket holds {z} apples.",
    "{a} drives to work and back home each day. {a} uses {x} gallons of fuel per trip. {a} pays {y} dollars for every gallon.",
    "{a} owns a shop that sells wooden chairs and tables. {b} ordered {x} chairs and {y} tables for the new office. How much did the order cost?",
    "{a} collected {x} shells along the beach this summer. {a} gave {y} shells to each of her cousins. {a} has {z} cousins in total.",
    "{a} planted {x} rows of corn behind the old barn. Each row has {y} plants in it. {b} watered all of the plants once.",
    "{a} swims {x} laps in the pool every single morning. {b} swims {y} laps in the same pool at night. Who swims more laps in a month?",
    "{a} made {x} bracelets for the school fair last spring. {a} sold all but {y} of the bracelets. {a} earned {z} dollars from the sale.",
    "{a} filled a tank with {x} liters of clean water. {a} used {y} liters to wash the family car. How much water is left in the tank?",
    "{a} works {x} hours at the library each weekend. {b} works {y} hours there during the week. Their pay per hour is the same.",
    "{a} bought {x} pencils and a ruler at the corner store. {a} paid with a note and got {y} dollars back. {a} shared the pencils with {b} after class.",
    "{a} feeds the hens on the farm {x} cups of seed a day. {b} feeds the ducks {y} cups a day. How many cups do they need for the week?",
    "{a} scored {x} points in the first half of the game. {b} scored {y} points in the second half of the game. Which of the two teams won?",
    "{a} has {x} marbles in a small glass jar. {a} lost {y} marbles while playing with {b} in the yard. {a} then found {z} more under the couch.",
    "{a} ran around the track {x} times before lunch. {a} rested and then ran {y} more times around it. How long is the track if {a} ran {z} miles?",
]


def test_names_at_sentence_starts(spark):
    """Questions of sentences that begin with a name are found with other names and numbers, in figures or words; other texts are not."""
    names = ["James", "Betty", "Mark", "Clara", "Weng", "Julie", "Oskar", "Priya", "Tomas", "Ken"]
    filler = "Some words stand before it. Nothing in particular comes after them here."
    items, docs = [], []
    for i, text in enumerate(NAMED_ITEMS):
        items.append((i, text.format(a=names[i % 10], b=names[(i + 3) % 10], x=12 + i, y="Ten" if i % 4 == 0 else 7 + i, z=40 + i)))
        other = text.format(a=names[(i + 4) % 10], b=names[(i + 8) % 10], x="forty-eight" if i % 3 == 0 else 250 + i, y=95 - i, z=3 + i)
        docs += [(i, f"{filler} {other} {filler}"), (100 + i, f"{filler} {items[-1][1]} {filler}")]
        docs.append((200 + i, f"{names[i % 10]} went home. {names[i % 9]} has {i} things to do. {filler} {names[i % 7]} writes about it. {names[i % 8]} uses it."))
    rows = tune(spark).createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(100 + i, i) for i in range(20)} <= found
    assert sum((i, i) in found for i in range(20)) >= 18
    assert all(d % 100 == i and d < 200 for d, i in found)


def test_contaminated_table(spark, sf, odd, empty):
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    plain = {r.item_id: " ".join(r.text.lower().split()) for r in items.collect()}
    whole = {(d.doc_id, i) for d in docs.collect() for i, t in plain.items() if t in " ".join(d.text.lower().split())}
    assert whole <= found
    assert decontaminate.contaminated(odd, items).count() == 0
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


# --- pipeline --------------------------------------------------------------------


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    first = read(spark, sf, "documents")
    docs, tables = first, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        tables.append(docs)
    good, single, clean, mixed, sharded = tables
    assert all(t.columns == first.columns for t in tables[:-1])
    assert 0 < good.count() < first.count()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    firsts = {c for i, n, c in _components(rows, 5) if i == c}
    assert sorted(r.doc_id for r in single.collect()) == sorted(firsts)
    items = read(spark, sf, "benchmark")
    leaks = {r.doc_id for r in decontaminate.contaminated(single, items).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaks
    assert mixed.agg(F.sum(mixing.n_words())).first()[0] == mixing.mix_sources(clean).agg(F.sum("taken")).first()[0]
    assert sharded.count() == mixed.count()
    assert {r.shard for r in sharded.select("shard").distinct().collect()} == set(range(16))
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, sharded.collect()))
