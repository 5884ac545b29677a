import json
import random

import pytest
from pyspark.sql import functions as F

from grovekeep.functions import fixed_values as V
from grovekeep.operators import generated, questions, scans, tagging


def test_default_rules_take_the_first_domain(spark):
    data = [(1, "Java 和 日本", None), (2, "x", "SQL tips"), (3, "无", ""), (4, "历史", "小说")]
    nodes = spark.createDataFrame([("o", *d) for d in data], "owner_id string, id int, name string, content string")
    tags = dict((r.id, r.tag) for r in tagging.tag_nodes(nodes).collect())
    assert tags == {1: "日本文化", 2: "编程技术", 3: "其他", 4: "文学艺术"}
    found = sorted((r.id, r.prio) for r in tagging.keyword_match(nodes).collect())
    assert found == [(1, 1), (1, 2), (2, 2), (4, 4), (4, 5)]


def _brute_hits(nodes, rules):
    prio = {}
    for p, d, w in rules:
        if d is not None and w is not None:
            prio[d] = min(prio.get(d, p), p)
    out = set()
    for o, i, name, content in nodes:
        text = f"{name or ''} {content or ''}".lower()
        out |= {(o, i, d, prio[d]) for _, d, w in rules if d is not None and w is not None and w.lower() in text}
    return out


def test_keyword_index_finds_what_brute_force_finds(spark):
    rng = random.Random(7)
    letters = "abcd é日本\U0001d11e"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    nodes = [(f"o{i % 3}", i, word(rng.randrange(0, 12)), word(rng.randrange(0, 60))) for i in range(120)]
    nodes += [("o0", 500, None, None), (None, 501, "ABC d", "xyz"), ("o0", 0, nodes[0][2], nodes[0][3])]
    rules = [(i, f"d{i % 40}", word(rng.choice([1, 2, 3, 3, 4, 5, 6]))) for i in range(200)] + [(7, "none", None), (8, None, "a"), (3, "upper", "BC D")]
    table = spark.createDataFrame(nodes, "owner_id string, id long, name string, content string")
    of = lambda r: spark.createDataFrame(r, "prio int, domain string, keyword string")
    got = tagging.keyword_hits(table, of(rules)).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == _brute_hits(nodes, rules)
    empty = rules[:5] + [(99, "all", "")]
    assert set(map(tuple, tagging.keyword_hits(table, of(empty)).collect())) == _brute_hits(nodes, empty)
    assert tagging.keyword_hits(table, of([])).count() == 0
    best = {}
    for o, i, d, p in _brute_hits(nodes, rules):
        best[o, i] = min(best.get((o, i), (p, d)), (p, d))
    tags = {(r.owner_id, r.id): r.tag for r in tagging.tag_by_table(table, of(rules), "rest").collect()}
    assert tags == {(o, i): best.get((o, i), (0, "rest"))[1] for o, i, *_ in nodes}


def test_long_keywords_and_pieces_shared_by_all_texts(spark, monkeypatch):
    """Keywords made of the same few letters: only pieces that are hits are joined, not every text with every keyword."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    nodes = [("o", i, word(5), word(rng.randrange(0, 80)) + "é" * 30) for i in range(80)]
    texts = [f"{n[2]} {n[3]}" for n in nodes]
    cuts = [(rng.choice(texts), rng.randrange(0, 40), rng.randrange(5, 30)) for _ in range(150)]
    rules = [(i, f"d{i % 30}", t[s : s + n].upper()) for i, (t, s, n) in enumerate(cuts)] + [(i, f"e{i}", word(12)) for i in range(150)]
    table = spark.createDataFrame(nodes, "owner_id string, id long, name string, content string")
    rows = spark.createDataFrame(rules, "prio int, domain string, keyword string")
    monkeypatch.setattr(tagging, "_STRETCH", 100)
    assert set(map(tuple, tagging.keyword_hits(table, rows).collect())) == _brute_hits(nodes, rules)
    best = {}
    for o, i, d, p in _brute_hits(nodes, rules):
        best[i] = min(best.get(i, (p, d)), (p, d))
    assert {r.id: r.tag for r in tagging.tag_by_table(table, rows, "rest").collect()} == {n[1]: best.get(n[1], (0, "rest"))[1] for n in nodes}
    lowered = sorted({r[2].lower().encode() for r in rules if 0 < len(r[2].lower().encode()) <= 16})
    marked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    met = tagging._pieces_in(marked, spark.createDataFrame([(bytearray(w),) for w in lowered], "gram binary")).collect()
    true = {(i, w) for i, t in enumerate(texts) for w in lowered if w in t.encode()}
    assert true <= (found := {(r.id, bytes(r.gram)) for r in met}) and len(found) <= 1.2 * len(true)


def test_a_hundred_thousand_rules(spark):
    rules = spark.range(100_000).select(F.col("id").cast("int").alias("prio"), F.concat(F.lit("d"), F.col("id")).alias("domain"), F.concat(F.lit("word"), F.col("id"), F.lit(" ")).alias("keyword"))
    nodes = spark.range(200).select(F.lit("o").alias("owner_id"), "id", F.concat(F.lit("word"), F.col("id") * 500).alias("name"), F.lit("word99999 end").alias("content"))
    got = {(r.id, r.domain) for r in tagging.keyword_hits(nodes, rules).collect()}
    assert got == {(i, d) for i in range(200) for d in (f"d{i * 500}", "d99999")}


def _shuffled_rows(df):
    """Rows written to shuffles by the plan that collects ``df``."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        own = node.metrics().get("shuffleRecordsWritten")
        children = node.children()
        return (own.get().value() if own.isDefined() else 0) + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def many_hits(spark):
    """Forty texts that hold all of 200 keywords, each of which is in five domains; the joins shuffle, as those of large tables do."""
    words = [f"word{i:03d} " for i in range(200)]
    nodes = spark.createDataFrame([("o", i, f"n{i}", "".join(words)) for i in range(40)], "owner_id string, id long, name string, content string").repartition(4)
    rules = spark.createDataFrame([(d, f"d{d}", w) for w in words for d in range(5)], "prio int, domain string, keyword string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield nodes, rules
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_pieces_of_texts_are_not_shuffled(many_hits):
    """A row per node and domain is dealt out, not one per keyword in a text and domain of it."""
    nodes, rules = many_hits
    hits = tagging.keyword_hits(nodes, rules)
    assert sorted(map(tuple, hits.collect())) == sorted(("o", i, f"d{d}", d) for i in range(40) for d in range(5))
    assert _shuffled_rows(hits) <= 2 * 40 * 5


def test_tags_of_a_table_shuffle_a_row_per_node(many_hits):
    nodes, rules = many_hits
    tags = tagging.tag_by_table(nodes, rules)
    assert sorted(map(tuple, tags.collect())) == [("o", i, "d0") for i in range(40)]
    # The nodes and the tags found, each dealt out twice.
    assert _shuffled_rows(tags) <= 4 * 40


@pytest.mark.parametrize("slices", [1, 4])
def test_rules_in_slices_find_what_brute_force_finds(spark, monkeypatch, slices):
    """Keywords with long beginnings in common, in more domains than a number has bits, and keywords that cross the stretches of a scan."""
    rng = random.Random(slices)
    word = lambda n: "".join(rng.choice("ab日") for _ in range(n))
    stem = word(30)
    nodes = [("o", i, word(3), word(rng.randrange(0, 50)) + stem[: rng.randrange(31)] + word(9)) for i in range(60)] + [("p", 0, "x", stem * 5), ("p", 0, "y", "zz"), (None, 1, None, stem)]
    texts = [f"{n[2] or ''} {n[3]}" for n in nodes]
    cuts = [(rng.choice(texts), rng.randrange(0, 40), rng.randrange(1, 30)) for _ in range(150)]
    words = [t[s : s + n] for t, s, n in cuts] + [stem[:n] + word(2) for n in range(30)] + [word(8) for _ in range(50)] + ["zz"]
    rules = [(rng.choice([None, i]), f"d{i % 100}", w.upper()) for i, w in enumerate(words)]
    rules += [(i, f"all{i}", stem[:4]) for i in range(150)] + [(1, "empty", "")]
    rules = [(i if p is None and i % 100 > 3 else p, d, w) for i, (p, d, w) in enumerate(rules)]
    monkeypatch.setattr(tagging, "SLICE_BYTES", sum(tagging._RULE_BYTES + len((d + w).encode()) for _, d, w in rules) // slices + 1)
    monkeypatch.setattr(tagging, "_STRETCH", 64)
    monkeypatch.setattr(tagging, "_PAIRS", 40)
    table = spark.createDataFrame(nodes, "owner_id string, id long, name string, content string")
    got = tagging.keyword_hits(table, spark.createDataFrame(rules, "prio int, domain string, keyword string")).collect()
    lows = {d: min((p for p, e, _ in rules if e == d and p is not None), default=None) for _, d, _ in rules}
    want = {(n[0], n[1], d, lows[d]) for n, t in zip(nodes, texts) for _, d, w in rules if w.lower() in t.lower()}
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_style_needs_more_than_the_threshold(spark):
    tagged = spark.createDataFrame([("a", "日本文化")] * 3 + [("a", "x")] * 7 + [("b", "文学艺术")] * 4 + [("b", "日本文化")] * 4 + [("b", None)] * 2,
                                   "owner_id string, tag string")
    shares = tagging.domain_distribution(tagged)
    owners = spark.createDataFrame([("a",), ("b",), ("c",)], "owner_id string")
    assert dict(map(tuple, tagging.dominant_style(shares, owners).collect())) == {"a": "default", "b": "sakura", "c": "default"}
    assert {r.tag: r.share for r in shares.where("owner_id = 'b'").collect()}[V.OTHER_TAG] == 0.2


@pytest.mark.parametrize("seed", [1, 2])
def test_parent_match_equals_checking_every_pair(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abAB ") for _ in range(rng.randrange(0, 6)))
    nodes = [(i, rng.choice("xy"), rng.choice([None, 0]), word(), rng.random() < 0.1) for i in range(60)]
    asked = [(rng.choice("xyz"), word()) for _ in range(60)]
    got = tagging.match_parent(spark.createDataFrame(asked, "owner_id string, suggested_parent string"),
                               spark.createDataFrame(nodes, "id long, owner_id string, parent_id long, name string, is_deleted boolean"))
    want = {}
    for owner, name in asked:
        low = name.lower()
        fits = [(p is not None, i) for i, o, p, n, gone in nodes if o == owner and not gone and (low in n.lower() or n.lower() in low)]
        if fits:
            want[owner, low] = min(fits)[1]
    assert {(r.owner_id, r.wanted): r.parent_id for r in got.collect()} == want


RAW = "id int, question_type string, raw string"


def question(**changes):
    base = {"question": "q", "options": ["a", "b", "c", "d"], "correct_index": 0, "explanation": "e"}
    return json.dumps({k: v for k, v in {**base, **changes}.items() if v != "drop"})


def test_question_validation(spark):
    cases = [
        ("single_choice", question(), None), ("single_choice", question(correct_index=True), None), ("essay", question(), None),
        ("single_choice", question(options="abcd"), "options_not_four"), ("single_choice", question(options=[1, 2, 3]), "options_not_four"),
        ("single_choice", question(correct_index=4), "index_out_of_range"), ("single_choice", question(correct_index=1.0), "index_out_of_range"),
        ("single_choice", question(correct_index="1"), "index_out_of_range"), ("single_choice", question(explanation="drop"), "missing_key"),
        ("single_choice", "[1]", "not_an_object"), ("single_choice", "```json\n{broken\n```", "not_json"),
        ("single_choice", "text ```" + question() + "``` more ```x```", None),
        ("true_false", question(correct_index=1), None), ("true_false", question(correct_index=2), "index_out_of_range"),
        ("true_false", question(question="drop"), "missing_key"),
        ("short_answer", json.dumps({"question": "q", "reference_answer": "r", "keywords": []}), None),
        ("short_answer", json.dumps({"question": "q", "reference_answer": "r", "keywords": {}}), "keywords_not_list"),
    ]
    raw = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(cases)], RAW)
    ok, rejects = generated.validate_questions(raw)
    got = {r.id: r.reason for r in rejects.collect()} | {r.id: None for r in ok.collect()}
    assert got == {i: reason for i, (_, _, reason) in enumerate(cases)}
    assert ok.where("id = 12").first().choices == V.TRUE_FALSE_CHOICES
    assert ok.where("id = 15").first().explanation == "r"


def test_batches_are_all_or_nothing(spark):
    good = {"question": "q", "options": ["a"], "correct_index": 9}
    cases = [[good], [good, {"question": "x"}], [{"options": ["a"]}], [good, {"options": ["a"]}], [{"question": "t", "question_type": "true_false", "correct_index": 1.0}]]
    raw = spark.createDataFrame([(i, json.dumps({"questions": c})) for i, c in enumerate(cases)], "id int, raw string")
    ok, rejects = generated.explode_question_batch(raw, 1)
    assert {r.id: r.reason for r in rejects.collect()} == {1: "missing_options", 2: "missing_question"}
    assert {r.id: r.correct_index for r in ok.collect()} == {0: 9, 3: 9, 4: 1}
    _, strict = generated.explode_question_batch(raw, 1, strict=True)
    assert {r.id for r in strict.collect()} == {0, 1, 2, 3}


def test_suggestions_without_parent(spark):
    raw = spark.createDataFrame([(1, '{"nodes":[{"name":"a","content":"b"}]}'), (2, '{"nodes":5}'), (3, "7")], "id int, raw string")
    ok, rejects = generated.explode_suggestions(raw, with_parent=False)
    assert [tuple(r) for r in ok.collect()] == [(1, 0, "a", "b")]
    assert {r.id: r.reason for r in rejects.collect()} == {2: "nodes_not_list", 3: "missing_nodes"}


def test_prompt_text(spark):
    nodes = spark.createDataFrame([("o", 1, "n", "", False), ("o", 2, "m", "c", False)], "owner_id string, id int, name string, content string, is_deleted boolean")
    got = [r.prompt for r in generated.build_prompts(nodes, ["single_choice", "true_false"]).orderBy("id").collect()]
    head = "题目类型要求：请生成single_choice、true_false。\n\n"
    assert got == [head + "知识点名称：n", head + "知识点名称：m\n内容：c"]


def test_json_records(spark):
    items = [{"id": "a", "name": "x", "parentId": "", "sortOrder": 2.5}, {"id": 1, "name": "x"}, {"id": "b", "name": "y", "parentId": "a", "content": None}, None]
    raw = spark.createDataFrame([("f", json.dumps(items)), ("g", '{"id":"z"}'), ("h", "oops")], "source string, raw string")
    rows, rejects = scans.ingest_json_records(raw)
    assert sorted(tuple(r) for r in rows.collect()) == [("f", "a", "x", "", None, 2.5), ("f", "b", "y", "", "a", 1.0)]
    assert sorted((r.source, r.reason) for r in rejects.collect()) == [("f", "missing_id_or_name")] * 2 + [("g", "not_an_array"), ("h", "not_an_array")]


def test_latest_attempt_is_the_owners(spark):
    q = spark.createDataFrame([(1, "a", "q1"), (2, "a", "q2"), (3, "b", "q3")], "id int, owner_id string, question string").withColumn("correct_index", F.lit(0))
    r = spark.createDataFrame([(1, "a", True, 1, 1), (1, "a", False, 1, 2), (2, "b", True, 1, 3)],
                              "question_id int, owner_id string, is_correct boolean, answered_at int, rid int")
    got = {x.id: (x.answered, x.last_correct) for x in questions.question_latest_attempt(q, r, ["rid"]).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, False)}
    assert [x.id for x in questions.wrong_questions(q, r).collect()] == [1]


def test_grading(spark):
    q = spark.createDataFrame([(1, "single_choice", 2), (2, "short_answer", 0)], "id int, question_type string, correct_index int")
    a = spark.createDataFrame([(1, 2), (1, 0), (1, None), (2, None)], "question_id int, chosen_index int")
    assert sorted((r.question_id, str(r.chosen_index), r.graded) for r in questions.grade_answers(a, q).collect()) == [
        (1, "0", False), (1, "2", True), (1, "None", False), (2, "None", True)]


def test_names_are_stripped_of_any_white_space(spark):
    df = spark.createDataFrame([(1, "　 a b\t\n"), (2, "\t "), (3, None)], "id int, name string")
    ok, rejects = scans.clean_names(df)
    assert [tuple(r) for r in ok.collect()] == [(1, "a b")] and {r.id for r in rejects.collect()} == {2, 3}


def test_contained_finds_what_brute_force_finds(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abc é日") for _ in range(n))
    needles = {(rng.choice("xy"), word(rng.randrange(1, 7))) for _ in range(80)}
    texts = [(rng.choice("xyz"), word(rng.randrange(0, 25)), i) for i in range(150)]
    got = tagging.contained(spark.createDataFrame(sorted(needles), "o string, needle string"), spark.createDataFrame(texts, "o string, text string, n int"), "o").collect()
    assert sorted((r.o, r.needle, r.n) for r in got) == sorted((o, w, i) for o, w in needles for p, t, i in texts if o == p and w in t)
    none = spark.createDataFrame([], "o string, needle string")
    assert tagging.contained(none, spark.createDataFrame(texts, "o string, text string, n int"), "o").count() == 0
