import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryframe.llm import decontaminate as dc
from quarryframe.llm import html_text as ht
from quarryframe.llm import language_id as li
from quarryframe.llm import line_dedup as ld
from quarryframe.llm import quality as ql
from quarryframe.llm import toxicity as tx
from tests.llm import helpers as hp

DOCS = "doc_id long, text string"


# -- quality ----------------------------------------------------------------------------------------------------


def test_quality_base_columns_equal_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "c#", "d\n", "e f", "g\x1ch", "\n"]) for _ in range(rng.randrange(90))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], f"{DOCS}, lang string")
    for r in ql.quality_rules(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == hp.quality_base(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    odd = ql.quality_rules(odd_docs)
    assert odd.columns.count("kept") == 1 and odd.count() == 11
    assert {r.doc_id for r in odd.where("base_failed").collect()} >= {0, 1, 2, 7, 8}
    assert ql.quality_rules(no_docs).count() == 0


def test_quality_keeps_prose_and_rejects_junk(spark):
    function = "the of and to in is that for".split()
    rng = random.Random(2)
    clean = [" ".join(rng.choice(function) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)) for _ in range(40)]
    junk = [" ".join(w + "***%%%###" for w in t.split()) for t in clean[:4]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], f"{DOCS}, lang string")
    assert {r.doc_id for r in ql.quality_rules(docs).where("kept").collect()} == set(range(40))


def test_quality_rejects_texts_without_common_words(spark):
    function = "the of and to in is that for".split()
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    clean = [" ".join(rng.choice(function) if rng.random() < 0.22 else word() for _ in range(200)) for _ in range(40)]
    menus = [" ".join(word() for _ in range(200)) for _ in range(4)]
    # the word list does not serve xx, so its texts are not judged by their words, and they do not excuse the menus
    other = [" ".join(word() for _ in range(200)) for _ in range(10)]
    rows = [(i, t, "en") for i, t in enumerate(clean + menus[:3])] + [(43, menus[3], None)] + [(100 + i, t, "xx") for i, t in enumerate(other)]
    docs = spark.createDataFrame(rows, f"{DOCS}, lang string")
    want = {*range(40), *range(100, 110)}
    assert {r.doc_id for r in ql.quality_rules(docs).where("kept").collect()} == want
    assert ql.quality_rules(docs, ql.QualityConfig(max_word_share=None)).where("kept").count() == len(rows)


def test_js_distance_bounds():
    p, q = np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([[1.0, 0.0], [0.0, 1.0]])
    got = ql.js_distance(p, q)
    assert np.allclose(got[0], [0, 1]) and np.allclose(got[1], got[1][0])


# -- line dedup -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_line_dedup_equals_brute_force(spark, limit):
    rng = random.Random(4)
    pool = [f"{'Common Line ' * 4}{i} é" for i in range(8)] + ["short", "", "x" * 39, "é" * 40, "Y" * 40, " \t" + "y" * 40 + "\r"]
    docs = [(i, None if i == 7 else "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for i in range(30)]
    cfg = ld.LineConfig(max_broadcast_keys=limit, min_bits_log2=6)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in ld.line_dedup(spark.createDataFrame(docs, DOCS), cfg).collect()}
    assert got == hp.line_dedup(docs)


def test_line_dedup_odd_rows(odd_docs, no_docs):
    got = ld.line_dedup(odd_docs).collect()
    assert len(got) == 11 and all(r.n_dropped == 0 for r in got)
    assert [r.n_lines for r in got if r.doc_id == 8] == [4] and [r.text for r in got if r.doc_id == 0] == [None]
    assert ld.line_dedup(no_docs).count() == 0


# -- decontamination ----------------------------------------------------------------------------------------------


def test_myers_equals_dynamic_programming():
    rng = random.Random(5)
    for _ in range(150):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        bits = {}
        for i, c in enumerate(p):
            bits[c] = bits.get(c, 0) | 1 << i
        assert dc.myers(bits, len(p), t) == hp.edit_distance_inside(p, t)


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_leaks_equal_brute_force(spark, block):
    rng = random.Random(6)
    items = [(i, hp.prose(100 + i, 25)) for i in range(6)]
    docs = []
    for i in range(40):
        text = hp.prose(i, 60)
        if i % 2:
            item = list(items[i % 6][1])
            for _ in range(rng.randrange(0, 14)):
                item[rng.randrange(len(item))] = rng.choice("xyz ")
            text = f"{text} {''.join(item).upper()}\n{text}"
        docs.append((i, text))
    cfg = dc.LeakConfig(block_chars=block)
    want = {}
    for i, text in docs:
        found = [(k, hp.edit_distance_inside(dc.normal_text(t), dc.normal_text(text))) for k, t in items]
        want[i] = [(k, d) for k, d in found if d <= int(cfg.rate * len(dc.normal_text(items[k][1])))]
    bench = spark.createDataFrame([*items, (None, "x"), (9, None), (10, "short")], "item_id long, text string")
    frame = spark.createDataFrame(docs, DOCS)
    assert {r.doc_id: [(x.item_id, x.distance) for x in r.leaks] for r in dc.tag_leaks(frame, bench, cfg).collect()} == want
    assert {r.doc_id for r in dc.decontaminate(frame, bench, cfg).collect()} == {i for i, v in want.items() if not v}


def test_leaks_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, hp.prose(3, 40))], "item_id long, text string")
    got = dc.tag_leaks(odd_docs, bench).collect()
    assert len(got) == 11 and {r.doc_id for r in got if r.leaks} == {3}
    assert dc.tag_leaks(no_docs, bench).count() == 0
    assert dc.tag_leaks(odd_docs, bench.where("false")).where("size(leaks) > 0").count() == 0


# -- language -------------------------------------------------------------------------------------------------------


def test_gradients_equal_differences():
    rng = np.random.RandomState(1)
    cfg = li.LanguageConfig(hidden=3, steps=0)
    net = li.train([b"abc", b"bcd"], np.array([0, 1]), ["x", "y"], cfg)
    x = rng.randint(97, 101, (4, 5)).astype(np.uint8)
    y = np.array([0, 1, 1, 0])
    params = [net.inputs[0], net.recurrent[0], net.bias[0], net.inputs[1], net.recurrent[1], net.bias[1], net.out, net.out_bias]
    loss = lambda: -np.log(net.positions(x)[np.arange(4)[:, None], np.arange(1, 4)[None, :], y[:, None]].astype(float)).mean()
    for p, g in zip(params, li._gradients(net, x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), p.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-3


def test_a_rare_language_is_learned_beside_a_hot_one(spark):
    hot = spark.range(60_000).selectExpr("id as doc_id", "'abc bca cab' as text", "'xx' as lang")
    rare = spark.range(60_000, 60_025).selectExpr("id as doc_id", "'uvw vwu' as text", "'yy' as lang")
    assert li.fit(hot.unionAll(rare), li.LanguageConfig(steps=1, hidden=3, batch=16)).languages == ["xx", "yy"]


def test_document_probabilities_pool_all_positions(spark, odd_docs, no_docs):
    texts = {"en": "the water and the house that was there", "de": "der garten und die strasse ist nicht"}
    docs = spark.createDataFrame([(i, f"{texts[k]} {i}", k) for i in range(60) for k in texts], f"{DOCS}, lang string")
    cfg = li.LanguageConfig(steps=120, hidden=8, batch=256)
    net = li.fit(docs, cfg)
    held = li.identify(docs, net, cfg).withColumn("h", li.held_out(F.col("doc_id"))).where("h").collect()
    assert held and all(r.lang_pred == r.lang for r in held)
    text = "water Haus, house"
    sums = np.mean([p for w in li.letter_words(text) for p in net.positions(np.frombuffer(b" " + w + b" ", np.uint8)[None])[0, 1:-1]], axis=0)
    got = li.Labeller(net, 10)([text])[0]
    assert np.allclose(got[:-1] / got[-1], sums, atol=1e-5)
    odd = {r.doc_id: r for r in li.identify(odd_docs, net, cfg).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2)) and 0 <= odd[4].score <= 1
    assert li.identify(no_docs, net, cfg).count() == 0
    assert {(r.lang_pred, r.score) for r in li.identify(odd_docs, li.fit(no_docs, cfg), cfg).collect()} == {("und", 0.0)}
    other = li.train([b"abc", b"xyz"], np.array([0, 1]), net.languages, cfg)
    assert other.key != li.train([b"abd", b"xyz"], np.array([0, 1]), net.languages, cfg).key


# -- toxicity ---------------------------------------------------------------------------------------------------------


def test_thresholds_are_ordered_and_toxic_documents_are_found(spark, odd_docs, no_docs):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(400):
        w = hp.prose(i, 60).split()
        toxic = i % 5 == 0
        for _ in range(rng.randrange(2, 9) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["awful", "rotten", "vile"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(docs, DOCS)
    known = spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = tx.fit(frame, known.where("doc_id < 300 or doc_id is null"))
    assert model.thresholds == sorted(model.thresholds)
    got = {r.doc_id: r for r in tx.predict_severity(frame, model).collect()}
    test = range(300, 400)
    assert all(got[i].toxic == (i % 5 == 0) for i in test)
    assert all(0 <= got[i].severity <= 3 for i in test)
    mild, heavy = spark.createDataFrame([(1, hp.prose(1, 60) + " vile")], DOCS), spark.createDataFrame([(1, hp.prose(1, 60) + " vile" * 9)], DOCS)
    assert tx.predict_severity(mild, model).first().severity < tx.predict_severity(heavy, model).first().severity
    odd = {r.doc_id: r for r in tx.predict_severity(odd_docs, model).collect()}
    assert all(odd[i].severity == 0 and not odd[i].toxic for i in (0, 1, 2))
    assert tx.predict_severity(no_docs, model).count() == 0
    none = tx.predict_severity(frame, tx.fit(frame, known.where("false"))).collect()
    assert not any(r.toxic or r.grade for r in none) and max(r.severity for r in none) < 1e-9


# -- HTML -------------------------------------------------------------------------------------------------------------


def page(body, head="", tail=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{head}{body}{tail}</body></html>"


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""),
        ("", ""),
        ("<p>a &amp; b<br>c", "a & b c"),
        (page("<article><h1>H</h1><p>one <b>two</b><p>three</article>", "<nav><ul><li>m</ul></nav><div class='ad'>x</div>", "<footer>f</footer>"), "H\n\none two\n\nthree"),
        (page("<main><p>a</p><form><p>f</p></form><div class='post-comments'><p>c</p></div><aside>s</aside></main>", "<header>h</header>"), "a"),
        (page("<article><header><h1>H</h1></header><p hidden>x</p><p>&nbsp;a\n b&#x2014;</p><!-- <p>c</p> --></article>"), "H\n\na b—"),
        ("<article><p>cut <a href='x", "cut"),
        ("text <3 and > here", "text <3 and > here"),
        (page("<div id='cookie-notice'>n</div><p>body</p>"), "body"),
        (page("<article><p>one</p></article><div>between</div><article><p>two</p></article>"), "one\n\ntwo"),
        (page("<article><h2 id='share'>S</h2><div class='ad-hoc'>a</div><section class='menu'><p>soup</p></section><div class='ad'>x</div></article>"), "S\n\na\n\nsoup"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        (page("a<div>b<p>c</p>d</div>e"), "a\n\nb\n\nc\n\nd\n\ne"),
    ],
)
def test_page_text(html, want):
    assert ht.extract(html) == want


def test_tree_matching_is_the_largest_ordered_match():
    leaf = lambda x: [x, "", 0, []]
    a = ["r", "", 0, [leaf("a"), leaf("b"), ["c", "", 0, [leaf("d")]]]]
    b = ["r", "", 0, [leaf("b"), ["c", "", 0, [leaf("x"), leaf("d")]], leaf("a")]]
    size, pairs = ht.tree_match(a, b)
    assert size == 4 and [x[0] for x, _ in pairs][0] == "r" and {x[0] for x, _ in pairs} == {"r", "b", "c", "d"}


def shop_page(i, words=60):
    body = "".join(f"<p>{hp.prose(1000 * i + k, words)}</p>" for k in range(3))
    return f"<html><body><div class='top'>Great shop since 1990</div><div class='box'><div class='text'>{body}</div></div><div class='low'>All rights kept</div></body></html>"


def test_wrapper_drops_template_and_keeps_slots(spark):
    wrapper = json.loads(ht.induce([shop_page(i) for i in range(4)], ht.WrapperConfig()))
    want = "\n\n".join(hp.prose(9000 + k, 60) for k in range(3))
    assert ht.extract(shop_page(9), wrapper) == want
    assert ht.extract(shop_page(9)) == f"Great shop since 1990\n\n{want}\n\nAll rights kept"
    assert ht.induce([shop_page(1), shop_page(1)], ht.WrapperConfig()) is None


def test_the_wrapper_decides_where_a_page_marks_an_article():
    """A notice inside the marked article is template, and a second body block outside it is a slot."""
    made = lambda i: f"<html><body><div class='all'><article><div class='note'>Great shop since 1990</div><p>{hp.prose(i, 60)}</p></article><div class='more'><p>{hp.prose(i + 500, 60)}</p></div></div></body></html>"
    wrapper = json.loads(ht.induce([made(i) for i in range(4)], ht.WrapperConfig()))
    assert ht.extract(made(9), wrapper) == f"{hp.prose(9, 60)}\n\n{hp.prose(509, 60)}"
    assert ht.extract(made(9)) == f"Great shop since 1990\n\n{hp.prose(9, 60)}"
    assert ht.extract("<article><p>another layout</p></article>", wrapper) == "another layout"


def test_deep_and_long_pages_are_matched_in_bounds():
    deep = lambda i: "<div>" * 3000 + f"<p>{hp.prose(i, 60)}</p>"
    wrapper = ht.induce([deep(i) for i in range(3)], ht.WrapperConfig())
    assert ht.extract(deep(7), wrapper and json.loads(wrapper)) == hp.prose(7, 60)
    long = lambda i: f"<div class='a'>Great shop since 1990</div><table>{''.join(f'<tr><td>{i} {k}</td><td>{k * i}</td></tr>' for k in range(5000))}</table>"
    wrapper = json.loads(ht.induce([long(i) for i in range(1, 4)], ht.WrapperConfig()))
    got = ht.extract(long(8), wrapper).split("\n\n")
    assert "Great shop since 1990" not in got and len(got) == 10_000


@pytest.mark.parametrize("limit", [16_000_000, 0])
def test_pages_by_host(spark, limit):
    rows = [(i, f"http://Shop.example/{i}", shop_page(i), "t") for i in range(12)] + [(20, None, shop_page(20), "t"), (21, "http://one.example/", None, "t"), (None, "http://shop.example/x", "", "t"), (3, "http://shop.example/3", shop_page(3), "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = ht.extract_text(pages, ht.WrapperConfig(max_broadcast_chars=limit)).collect()
    assert len(got) == 16 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[5] == "\n\n".join(hp.prose(5000 + k, 60) for k in range(3)) and by[20].startswith("Great shop") and by[21] == "" and by[None] == ""
    assert ht.extract_text(pages.where("false")).count() == 0


def test_line_dedup_holds_little_on_the_driver(spark, monkeypatch):
    cfg = ld.LineConfig()
    assert (1 << (cfg.max_bits_log2 - 3)) + 24 * cfg.max_broadcast_keys <= 10_000_000
    # a filter far too small for the lines: all of them are suspects, and the result is the same
    docs = [(i, "\n".join(f"line {(i * 7 + j) % 900} of the text that is long enough to be a key" for j in range(20))) for i in range(300)]
    sent = []
    monkeypatch.setattr(ld, "_drop_lines", lambda *a, f=ld._drop_lines: sent.append(a[-1]) or f(*a))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in ld.line_dedup(spark.createDataFrame(docs, DOCS), ld.LineConfig(min_bits_log2=6, max_bits_log2=6)).collect()}
    assert got == hp.line_dedup(docs)
    digests, keep = sent[0]
    assert len(digests) == 16 * len(keep) and keep.dtype == "int64"
