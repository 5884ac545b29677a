"""SimHash groups, Merkle manifest and prefix trie against brute force and SQL."""

import collections
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from grovekeep.llm import merkle, prefix_trie, queries, simhash
from grovekeep.llm.common import read, tune
from grovekeep.llm.sql import ORACLE

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "no id at all here", "en", "a", 17),
    (1, None, "en", None, None),
    (2, "", None, "b", 0),
    (3, " \t\n", "en", "b", 3),
    (4, "same words Here, again and again.", "en", "b", 33),
    (4, "same words Here, again and again.", "en", "b", 33),
    (4, "another text of the same id.", "en", "b", 28),
    (-5, "é☃𝄞 Word " * 3000, "", "c", 27000),
]


@pytest.fixture
def odd(spark):
    docs = tune(spark).createDataFrame(ODD, DOCS)
    return docs.withColumns({"grp": F.lit(9), "_part": F.lit("x"), "fingerprint": F.lit("y"), "node": F.lit(1), "leaf": F.lit(2), "at": F.lit(0)})


@pytest.fixture
def empty(spark):
    return tune(spark).createDataFrame([], DOCS)


# --- simhash ---------------------------------------------------------------------


def _print(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _classes(prints):
    """Least id reachable per (id, fingerprint), by all pairs."""
    values = np.array([p for _, p in prints], np.uint64)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            root[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints))


def test_xxh64_spans():
    random.seed(3)
    spans = [random.randbytes(n) for n in [*range(0, 80), 100, 257, 1000, 2047, 2048, 2049, 5000] * 2]
    ends = np.cumsum([len(s) for s in spans])
    got = simhash.xxh64_spans(np.frombuffer(b"".join(spans), np.uint8), ends - [len(s) for s in spans], ends)
    assert [int(h) for h in got] == [xxhash.xxh64_intdigest(s, 42) for s in spans]


def test_fingerprints():
    random.seed(4)
    words = ["a", "BB", "Çé", "word", "Longer" * 4, "x" * 70, "\x1c", " y"]
    texts = [None, "", " \n", "One", "one TWO", "a b  c\td"]
    texts += [random.choice([" ", "\n"]).join(random.choices(words, k=random.randrange(1, 700))) for _ in range(40)]
    assert [int(p) for p in simhash.fingerprints(pa.array(texts, pa.string()))] == [_print(t) for t in texts]
    assert len(simhash.fingerprints(pa.array([], pa.string()))) == 0


def test_every_near_pair_meets():
    """All patterns of up to three bits, from even and odd fingerprints, link; farther ones never do."""
    random.seed(5)
    for bits in range(1, 6):
        for _ in range(150):
            a = random.getrandbits(64)
            b = a
            for i in random.sample(range(64), bits):
                b ^= 1 << i
            links = simhash.meeting(*simhash.variants_of(np.array([a, b], np.uint64)))
            assert {tuple(sorted(map(int, x))) for x in links} == ({tuple(sorted((a, b)))} if bits <= 3 else set())


def test_simhash_planted(spark):
    """Chains and balls of fingerprints around a few centres, found as all pairs find them."""
    rng = np.random.default_rng(6)
    values = []
    for _ in range(60):
        value = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 30))):
            values.append(value)
            for i in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                value ^= 1 << int(i)
    centre = values[0]
    values += [centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    nodes = tune(spark).createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in set(values)], "fingerprint long")
    links = simhash.near_links(nodes).collect()
    as_bits = lambda v: v % (1 << 64)
    assert all((as_bits(r.a) ^ as_bits(r.b)).bit_count() <= 3 for r in links)
    root = {v: v for v in set(values)}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in links:
        root[find(as_bits(r.a))] = find(as_bits(r.b))
    want = _classes([(v, v) for v in set(values)])
    groups, whole = collections.defaultdict(set), collections.defaultdict(set)
    for v in set(values):
        groups[find(v)].add(v)
    for (v, _, c) in want:
        whole[c].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, whole.values()))


def test_simhash_query(spark, sf, odd, empty):
    docs = read(spark, sf, "documents").collect()
    got = queries.QUERIES["op11_simhash"](spark, sf).collect()
    assert collections.Counter(map(tuple, got)) == _classes([(r.doc_id, _print(r.text)) for r in docs])
    got = simhash.near_groups(odd).collect()
    assert collections.Counter(map(tuple, got)) == _classes([(r[0], _print(r[1])) for r in ODD])
    assert simhash.near_groups(empty).count() == 0


# --- merkle ----------------------------------------------------------------------


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*values):
    return _sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _paths(digests):
    """Root and, per leaf, the steps (digests before, digests after) up to it."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for leaf, i in enumerate(at):
            run = runs[i // 8]
            paths[leaf].append((run[: i % 8], run[i % 8 + 1 :]))
            at[leaf] = i // 8
        level = [_sha(*run) for run in runs]
    return level[0] if level else None, paths


def _manifest(rows, tamper):
    """By the definition, over rows (doc_id, text, lang, source, n_chars)."""
    by_lang = collections.defaultdict(list)
    for d, text, lang, source, n in rows:
        other = text and re.sub("[A-Z]", lambda m: m[0].lower(), text)
        leaf = _leaf(d, source, lang, n, text)
        by_lang[lang].append((d is not None, d or 0, leaf, _leaf(d, source, lang, n, other) if tamper(d) and text is not None else leaf, d))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: _paths([r[2] for r in sorted(by_lang[x], key=lambda r: r[:4])]) for x in langs}
    root, upper = _paths([trees[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for r, path in zip(sorted(by_lang[x], key=lambda r: r[:4]), trees[x][1], strict=True):
            path = path + upper[k]
            fold = r[3]
            for before, after in path:
                fold = _sha(*before, fold, *after)
            proof = _sha(*[d for before, after in path for d in before + after])
            out.append((r[4], r[2], trees[x][0], root, proof, fold, fold == root))
    return collections.Counter(out)


def _third(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def _folded(docs):
    tampered = F.when(queries.fold(3) == 0, merkle.ascii_lower(F.col("text")))
    found = merkle.manifest(docs, tampered=tampered)
    found = found.withColumns({"p": merkle.proof_digest(F.col("path")), "f": merkle.folded(F.col("changed"), F.col("path"))})
    return collections.Counter(map(tuple, found.select("doc_id", "leaf", "subroot", "root", "p", "f", F.col("f") == F.col("root")).collect()))


def test_merkle_odd(spark, odd, empty):
    assert _folded(odd) == _manifest(ODD, _third)
    assert merkle.manifest(empty).count() == 0


@pytest.mark.parametrize("sizes", [[1], [8, 1], [9, 2], [64, 65], [512, 7], [513, 520, 1]])
def test_merkle_sizes(spark, sizes):
    """Sizes at and over the borders of runs and blocks: one tier, several, lone leaves."""
    rows = [(1000 * k + i, f"Text {i}", None if k == 0 else f"l{k}", "s", i) for k, n in enumerate(sizes) for i in range(n)]
    assert _folded(tune(spark).createDataFrame(rows, DOCS)) == _manifest(rows, _third)


def test_merkle_many_languages(spark):
    rows = [(i, f"Text {i}", f"l{i % 600}", "s", i) for i in range(900)]
    assert _folded(tune(spark).createDataFrame(rows, DOCS)) == _manifest(rows, _third)


def test_merkle_query(spark, sf):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in read(spark, sf, "documents").collect()]
    got = queries.QUERIES["op12_merkle_manifest"](spark, sf).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    want = _manifest(rows, _third)
    assert collections.Counter(map(tuple, got.collect())) == want
    # Proofs fail exactly where the text has changed.
    assert {d for d, *_, ok in want if not ok} == {r[0] for r in rows if _third(r[0]) and r[1] != re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")}


def test_merkle_paths_are_whole_proofs(spark, sf):
    rows = merkle.manifest(read(spark, sf, "documents")).collect()
    for r in rows:
        fold = r.leaf
        for step in r.path:
            assert len(step.before) + len(step.after) < 8
            fold = _sha(*step.before, fold, *step.after)
        assert fold == r.root


# --- prefix trie -----------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def _trie(rows, longest=8):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, tie, role, text))
    convs = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - c % 5, [])[:h]) + tuple(own[h:])
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), len(children[node]), leaves[node], saved[node], _sha(ends)))
    return collections.Counter(out)


def _found(turns):
    got = prefix_trie.prefix_trie(turns)
    return collections.Counter(map(tuple, got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def test_trie_odd(spark):
    rows = [
        (0, 1, "user", "hi"), (0, None, "user", "first"), (0, None, None, None), (0, 2, "user", ""), (0, 2, "user", ""),
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (3, 0, "u", "serhi"), (4, 0, "us", "erhi"), (6, 0, "user", "é" * 50000),
        (7, 0, "user", "hi"), (None, 0, "user", "hi"), (13, 3, "a", "b"), (13, 5, "a", "b"), (13, 4, None, "c"),
    ]
    turns = tune(spark).createDataFrame(rows, TURNS).withColumns({"conv": F.lit("x"), "k1": F.lit(1), "_part": F.lit(2), "path": F.lit(3)})
    assert _found(turns) == _trie(rows)
    assert prefix_trie.prefix_trie(turns.limit(0)).count() == 0


def test_trie_copies_and_depth(spark, monkeypatch):
    """Groups of equal conversations, long common starts over several spans, one conversation with most rows."""
    monkeypatch.setattr(prefix_trie, "SPAN", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    random.seed(8)
    rows = []
    for c in range(0, 120):
        n = 14 if c % 7 == 0 else random.randrange(0, 9)
        same = c % 4 == 0
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}" if same else f"t{t} {random.randrange(2)}") for t in range(n)]
    rows += [(500, t, "user", f"t{t}") for t in range(40)] + [(505, t, "user", f"t{t}") for t in range(40)]
    random.shuffle(rows)
    assert _found(tune(spark).createDataFrame(rows, TURNS).repartition(3)) == _trie(rows)


def test_trie_query(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in read(spark, sf, "conversations").collect()]
    assert _found(read(spark, sf, "conversations")) == _trie(rows)


# --- SQL -------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_prefix_trie"])
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours = queries.QUERIES[name](spark, sf)
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    kinds = {"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean"}
    assert dict(ours.dtypes) == {c[0]: kinds[str(c[1])] for c in want.description}
    assert collections.Counter(map(tuple, ours.select(*names).collect())) == collections.Counter(want.fetchall())


# --- pipeline stages -------------------------------------------------------------


def test_stages_on_odd_tables(spark, sf):
    """Columns named like the operators' own, repeated rows, nulls and empty tables pass through every stage."""
    import corpus_pipeline

    clash = ["_times", "times", "_id", "id", "_id_here", "_crc", "_taken", "taken", "_words", "size", "row_name", "old", "shard_", "_n"]
    docs = tune(spark).createDataFrame(ODD + [(7, "some more words of a text that is good enough to stay here", "en", "a", 57)] * 3, DOCS)
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(clash)})
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, sf)
            rows = got.collect()
            if name != "shard":
                assert got.columns == table.columns
                assert all(tuple(r[c] for c in clash) == tuple(range(len(clash))) for r in rows)
            else:
                assert len(rows) == table.count()
            if table is not docs:
                assert rows == []


def test_copies_are_written_once_each(spark, tmp_path, monkeypatch):
    from collections import Counter

    from grovekeep.llm import reshard

    monkeypatch.setattr(reshard, "COPIES", 4)
    rows = [(1, "copied text")] * 50 + [(None, "no id")] * 3 + [(i, f"text {i}") for i in range(2, 40)]
    docs = tune(spark).createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    placed = reshard.reshard(docs.withColumn("_old", F.lit(0)), "_old", 5)
    changed = reshard.rewrite_affected(spark, docs, placed, str(tmp_path / "out"))
    wrote = spark.read.parquet(str(tmp_path / "out")).collect()
    want = placed.where(F.col("shard").isin(changed)).collect()
    sizes = lambda t: len(t.encode()) + 1
    assert Counter((r.doc_id, sizes(r.text), r.shard) for r in wrote) == Counter((r.doc_id, r.size, r.shard) for r in want)
