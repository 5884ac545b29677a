"""Operators on single texts: extraction, classifiers, fingerprints, token counts."""

import hashlib
import time
import zlib

import pytest
from pyspark.sql import functions as F

from grovekeep.llm import edit_fingerprints, html_text, quality, token_counts, toxicity
from grovekeep.llm.common import read, tune

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "no id", "en", "a", 5),
    (1, None, "en", None, None),
    (2, "", None, "b", 0),
    (3, " \t\n", "en", "b", 3),
    (4, "Same words here, again and again.", "en", "b", 33),
    (4, "Same words here, again and again.", "en", "b", 33),
    (5, "é☃𝄞 " * 3000, "fr", "c", 12000),
]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and further columns whose names operators use inside."""
    docs = tune(spark).createDataFrame(ODD, DOCS)
    return docs.withColumns({"score": F.lit(9), "_part": F.lit("x"), "text_key": F.lit("y"), "label": F.lit(1), "size": F.lit(2)})


@pytest.fixture
def empty(spark):
    return tune(spark).createDataFrame([], DOCS)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu, menu, menu</a></ul></nav>
<div class="ad">Buy, buy, buy now</div><div id="content"><h1>Title &amp; more</h1>
<div class="story"><p>One,   two,
three &lt;b&gt; <b>bold<br>text <p>Second paragraph<ul><li>item a<li>item b</ul><blockquote>quoted</blockquote></div>
<div class="comments"><p>Nice, post, really, nice</p></div></div>
<aside>Aside, text</aside><form><p>Name, please</p></form><div class="cookie-notice">Cookies, cookies</div>
<footer>&copy; footer, text</footer></body></html>"""


def test_main_text():
    want = "Title & more\nOne, two, three <b> bold text\nSecond paragraph\nitem a\nitem b\nquoted"
    assert html_text.main_text(PAGE) == want


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a", "a"), ("<nav>x</nav>", ""), ("<script>x", ""),
        ("<main><section><h2>A</h2><p>first, p</p></section><section><h2>B</h2><p>second, p, q</p></section></main>", "A\nfirst, p\nB\nsecond, p, q"),
        ("<article><h1>T</h1><p>short</p><div><p>long, long, long</p></div></article><p>outside, of, it</p>", "T\nshort\nlong, long, long"),
        ("<body>" + "<div>" * 3000 + "deep", "deep"),
    ],
)
def test_main_text_cases(html, text):
    assert html_text.main_text(html) == text


LONG = "<p>" + "The first paragraph, which is long, goes on for a while, and says a lot, as such texts do. " * 8 + "</p>"


@pytest.mark.parametrize("wrap", ["<div class='layout has-sidebar'>{}</div>", "<main class='no-sidebar'>{}</main>", "<div id='page-with-menu'>{}</div>",
                                  "<div class='sidebar-right'><article>{}</article></div>", "<div class='header'><main>{}</main></div>"])
def test_wrappers_named_like_clutter(wrap):
    page = wrap.format(LONG + "<p>Last one.</p>") + "<div class='sidebar left'><p>Side, text, here.</p></div>"
    text = html_text.main_text(f"<body>{page}</body>")
    assert text.startswith("The first paragraph") and text.endswith("Last one.")


@pytest.mark.parametrize("name", ["discussion", "related-work", "notice-period", "social-effects", "sharing-data", "commentary"])
@pytest.mark.parametrize("kind", ["section", "div"])
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_sections_named_like_clutter(name, kind, around):
    heading = name.replace("-", " ").capitalize()
    page = f"<{around}><h1>T</h1>{LONG}<{kind} id='{name}'><h2>{heading}</h2><p>Its own text.</p></{kind}></{around}>"
    assert html_text.main_text(page).endswith(f"{heading}\nIts own text.")


@pytest.mark.parametrize("part", ["<div class='ad'><p>Gone, all of it.</p></div>", "<div class='site-footer'><p>Gone, all of it.</p></div>", "<div id='comments'><h2>Comments</h2><p>Gone.</p></div>",
                                  "<div class='related-posts'><h3>Related posts</h3><ul><li><a href='x'>Gone</a></ul></div>", "<div class='box cookie-notice'><p>Gone.</p></div>",
                                  "<section id='related'><h2>Related</h2><a href='x'>Gone and gone</a></section>", "<div class='social share-buttons'>Gone</div>"])
def test_clutter_goes(part):
    assert "Gone" not in html_text.main_text(f"<article>{LONG}{part}</article>")
    assert "Gone" not in html_text.main_text(f"<div>{LONG}{part}</div>")


@pytest.mark.parametrize("name", [
    "user-comments", "reader-comments", "blog-comments", "wp-comments", "fb-comments", "comment-thread", "cookie-law-info", "legal-notice",
    "in-article-promo", "mid-article-ad", "advert-mpu", "leaderboard-ad", "newsletter-cta", "email-signup", "user-login-form", "social-share-kit",
    "most-popular", "outbrain", "taboola", "latest-news", "author-bio", "site-info", "story-comments-v2", "weekly_newsletter_teaser",
])
def test_compound_names_of_clutter_go(name):
    part = f"<div class='{name}'><p>Gone, all of it, word for word, to the last.</p></div>"
    for around in ("article", "div"):
        text = html_text.main_text(f"<body><{around}><h1>T</h1>{LONG}{part}{LONG}</{around}></body>")
        assert "Gone" not in text and text.count("The first paragraph") == 16


@pytest.mark.parametrize("name", ["has-comments", "comments-open", "cookies-enabled", "ad-free-text", "no-newsletter"])
def test_modifiers_are_no_clutter(name):
    text = html_text.main_text(f"<body><article>{LONG}<div class='{name}'><p>Kept, with its words.</p></div></article></body>")
    assert text.endswith("Kept, with its words.")


@pytest.mark.parametrize("tags", ["<div class='widget'>", "<div>", "<span class='widget'>", "<section class='promo-zone'>"])
def test_deep_pages_take_linear_time(tags):
    """Doubling the depth of 50,000 boxes would take four times as long if any box looked at all those above or below it."""
    depth, name = 50_000, tags[1:].split()[0].strip(">")
    page = tags * depth + LONG + f"</{name}>" * depth + "</i>" * depth
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 20


def test_short_sibling_keeps_its_paragraphs():
    text = html_text.main_text(f"<div><div>{LONG * 3}</div><div><p>A short one.</p></div><div><a href='x'>Gone</a></div></div>")
    assert text.endswith("A short one.")


def test_pages(spark, sf):
    """Every article of the given pages, against a plain cut at its tags."""
    import html as H
    import re

    pages = read(spark, sf, "pages")
    got = {r.page_id: r for r in html_text.extract_pages(pages.withColumn("text", F.lit("clash"))).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(H.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("<h1>|</h1>|<p>|</p>", inner)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_pages_odd(spark):
    rows = tune(spark).createDataFrame([(1, None, None), (None, "u", "<p>a"), (2, "u", "<p>b"), (2, "u", "<p>b")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract_pages(rows).collect()) == [(0, "a", 1), (1, "", 0), (2, "b", 1), (2, "b", 1)]
    assert html_text.extract_pages(rows.limit(0)).count() == 0


def _held(n):
    return lambda doc_id: zlib.crc32(str(doc_id).encode()) % n


def test_quality_held_out(spark):
    from grovekeep.llm.queries import op4_quality

    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in read(spark, folder, "labels").collect()}
    got = op4_quality(spark, folder).collect()
    assert len(got) == read(spark, folder, "documents").count()
    assert all(r.held_out == (_held(3)(r.doc_id) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in judged) / len(judged) >= 0.95


def test_toxicity_held_out(spark):
    from grovekeep.llm.queries import op3_toxicity

    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in read(spark, folder, "labels").collect()}
    got = op3_toxicity(spark, folder).collect()
    assert all(r.held_out == (_held(4)(r.doc_id) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in judged) / len(judged) >= 0.97
    toxic = [p for p, y in judged if y]
    assert sum(toxic) / len(toxic) >= 0.9


def test_folding_and_exceptions():
    assert toxicity.fold("An 1D10T!! and аn ïd​iot") == " an idiot and an idiot "
    lexicon = toxicity.Lexicon({" idiot ": 2.0, " scum": 1.0}, [" scumbie "])
    assert lexicon.value("the IDIOT") == lexicon.value("the 1di0t") > 0
    assert lexicon.value("idiotic") == 0
    assert lexicon.value("scummy") > 0
    assert lexicon.value("scumble") == 0
    assert lexicon.value("idiot " + "word " * 100) < lexicon.value("idiot word")


def test_classifiers_odd(odd, empty):
    labels = odd.where("doc_id > 1").select("doc_id", (F.col("doc_id") % 2).alias("label"))
    model = quality.fit_quality(odd, labels)
    rows = quality.score_quality(model, odd).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert quality.score_quality(model, empty).count() == 0
    unfitted = quality.fit_quality(empty, labels)
    assert {r.score for r in quality.score_quality(unfitted, odd).collect()} == {0.5}
    lexicon = toxicity.fit_lexicon(odd, labels)
    assert len(toxicity.score_toxicity(lexicon, odd).collect()) == len(ODD)
    unfitted = toxicity.fit_lexicon(empty, labels)
    assert {round(r.score, 3) for r in toxicity.score_toxicity(unfitted, odd).collect()} == {0.5}
    assert toxicity.score_toxicity(lexicon, empty).count() == 0


def test_quality_fit_is_bounded(spark, monkeypatch):
    """Of an id that is repeated many times one row reaches the driver."""
    docs = tune(spark).createDataFrame([(i if i < 20 else 7, f"text {i if i < 20 else i % 3} of it", 9) for i in range(300)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, label int")
    seen, arrow = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: seen.append(arrow(self)) or seen[-1])
    quality.fit_quality(docs, labels)
    assert [t.num_rows for t in seen] == [20]


def test_quality_terms():
    """The linear-time identity against the plain double sum."""
    import numpy as np

    random = np.random.default_rng(1)
    x, v = random.random((3, 6)), random.random((6, 2))
    model = quality.Model(np.zeros((1, 1)), 0.25, random.random(6), v)
    plain = [0.25 + r @ model.weights + sum(r[i] * r[j] * (v[i] @ v[j]) for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(quality._raw(x, model), plain)


def test_fingerprints_follow_edits():
    text = "the quick brown fox jumps over the lazy dog and runs away " * 40
    text = "".join(c if i % 7 else chr(97 + (i * i // 7) % 26) for i, c in enumerate(text))
    own, moved, other, again = edit_fingerprints.fingerprints([text, text[:100] + "zz" + text[100:], text[::-1], text])
    assert own == again
    assert edit_fingerprints.likeness(own, again) == 1.0
    assert edit_fingerprints.likeness(own, moved) > 0.8
    assert edit_fingerprints.likeness(own, other) < 0.3
    assert edit_fingerprints.fingerprints(["", "a"])[0] == ""


def _edits(rows):
    """(id, text) rows in falling order with what each takes from the next."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        yield doc_id, len(text), hashlib.sha256((text[: len(text) - third] + following[:third]).encode()).hexdigest()


def test_edited_texts(spark, sf, odd, empty):
    for docs in (read(spark, sf, "documents"), odd):
        got = edit_fingerprints.fingerprint_edits(docs).collect()
        want = list(_edits([(r.doc_id, r.text or "") for r in docs.collect()]))
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
        assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=key) == sorted(want, key=key)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert edit_fingerprints.fingerprint_edits(empty).count() == 0


def test_near_matches(spark, sf):
    docs = read(spark, sf, "documents").where("n_chars > 300").select("doc_id", "text")
    changed = docs.where("doc_id % 50 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat(F.lit("x"), "text").alias("text"))
    prints = edit_fingerprints.fingerprint_rows(docs.union(changed))
    found = {(r.query_id, r.doc_id) for r in edit_fingerprints.near_matches(prints.where("doc_id >= 1000000"), prints, least=0.6).collect()}
    asked = [r.doc_id for r in changed.collect()]
    assert sum((i, i - 1_000_000) in found for i in asked) >= 0.7 * len(asked)


@pytest.mark.parametrize("least", [0.6, 0.8])
def test_near_matches_against_brute_force(spark, sf, least):
    """Texts of all lengths with another title, a changed middle or end, or one more character in front."""
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").select("doc_id", "text").collect() if r.text]
    docs += [(10_000 + i, t[: 12 + 3 * i]) for i, (_, t) in enumerate(docs[:60])]
    changed = []
    for i, (doc_id, text) in enumerate(docs):
        n = len(text)
        edit = ["x" + text, f"Another title {i}: " + text[9:], text[: n // 2] + "zz" + text[n // 2 + 1 :], text[: n - n // 6], text + " more"][i % 5]
        changed.append((doc_id + 1_000_000, edit))
    prints = edit_fingerprints.fingerprint_rows(tune(spark).createDataFrame(docs + changed, "doc_id long, text string"))
    mine = {r.doc_id: r.fingerprint for r in prints.collect()}
    want = {(i, j) for i, _ in changed for j, _ in docs if edit_fingerprints.likeness(mine[i], mine[j]) >= least and mine[i] and mine[j]}
    found = edit_fingerprints.near_matches(prints.where("doc_id >= 1000000"), prints.where("doc_id < 1000000"), least=least).collect()
    got = {(r.query_id, r.doc_id) for r in found}
    assert len(want) > 50
    assert got <= want
    assert len(got) >= 0.9 * len(want)
    short = {p for p in want if len(mine[p[0]]) < 200}
    assert len(got & short) >= 0.9 * len(short)


def test_search_query(spark, sf):
    from grovekeep.llm.queries import op5_near_matches

    mine = {r.doc_id: r.fingerprint for r in edit_fingerprints.fingerprint_rows(read(spark, sf, "documents")).collect() if r.fingerprint}
    want = {(i, j) for i in mine for j in mine if i != j and edit_fingerprints.likeness(mine[i], mine[j]) >= 0.8}
    got = {(r.query_id, r.doc_id) for r in op5_near_matches(spark, sf).collect()}
    assert got <= want
    assert len(got) >= 0.9 * len(want)


def test_bands_of_short_texts():
    """Short texts do not share all buckets."""
    texts = [f"number {i * 7919} of {i}" for i in range(40)] + [str(i) for i in range(40)]
    keys = [set(edit_fingerprints.band_keys(f, 24, 5).tolist()) for f in sorted(set(edit_fingerprints.fingerprints(texts)))]
    pairs = [bool(a & b) for i, a in enumerate(keys) for b in keys[:i]]
    assert sum(pairs) < 0.8 * len(pairs)
    assert len(keys) > 40


@pytest.mark.parametrize("chunk", [7, 40, 133])
def test_spliced_counts(chunk):
    model = token_counts.load(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["a" * 300, "x y " * 200, " " * 50 + "a b" * 90, "日本語 " * 100, "", " ", "a b", "a  b   c " * 40 + " ", "a ▁b c " * 50, "<s> </s> a\n\nb c" * 60]
    for text in texts:
        for overlap in (1, 5, 30):
            assert token_counts.count_long(model, text, chunk, overlap) == len(model.encode(text))


def test_token_counts(spark, sf, odd, empty):
    model = token_counts.load(public_tokenizers.path("piece_bpe_32k.model"))
    path = token_counts.vocabulary("piece_bpe_32k.model")
    for docs in (read(spark, sf, "documents"), odd):
        got = token_counts.token_counts(docs, path, chunk=2000, overlap=40, limit=1000).collect()
        want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect()]
        key = lambda r: (r[0] is not None, *(x or 0 for x in r))
        assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=key) == sorted(want, key=key)
        assert all(r.over_limit == (r.n_tokens > 1000) for r in got)
    assert token_counts.token_counts(empty, path).count() == 0
