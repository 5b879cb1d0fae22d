"""Extraction, toxicity and neighbours against plain Python, on edge cases and on the smallest given tables."""

import itertools
import random

import numpy as np
import pytest
import reference as ref

from lexmill.llm import html_extract, neighbours, toxicity

DATA = "/root/testdata/sf0.001"


# -- extraction --------------------------------------------------------------


def cut_cost(scores, edges, labels):
    wrong = sum(abs(s) for s, yes in zip(scores, labels, strict=True) if (s < 0) == yes)
    return wrong + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_min_cut_is_the_cheapest_labelling():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 9)
        scores = [round(rng.uniform(-3, 3), 3) for _ in range(n)]
        edges = [(a, b, round(rng.uniform(0, 2), 3)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        best = min(cut_cost(scores, edges, x) for x in itertools.product([False, True], repeat=n))
        assert cut_cost(scores, edges, html_extract.min_cut(scores, edges)) == pytest.approx(best, abs=1e-9)


def test_min_cut_of_many_nodes():
    n = 5000
    labels = html_extract.min_cut([3.0 if i % 7 else -1.0 for i in range(n)], [(i, i + 1, 1.0) for i in range(n - 1)])
    assert all(labels[1:-1])


PARAGRAPH = "This is a paragraph with enough words to look like prose, is it not? It goes on for a while."
PAGES = {
    "plain": (f"<html><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{PARAGRAPH}</p><p>Yes.</p></article></body>", f"Head {PARAGRAPH} Yes."),
    "entities": (f"<article><p>a &amp;&amp; b&lt;c &eacute; &#233; &#x1F600; {PARAGRAPH}</p></article>", f"a && b<c é é 😀 {PARAGRAPH}"),
    "inline": (f"<article><p>foo<b>bar</b> x<br>y\n\t z {PARAGRAPH}</p></article>", f"foobar x y z {PARAGRAPH}"),
    "unclosed": (f"<article><p><b>{PARAGRAPH}<br><p>More of it.</p></article><footer>no</footer>", f"{PARAGRAPH} More of it."),
    "script": (f"<script>var t='</p><p>no';</script><style>p{{}}</style><article><p>{PARAGRAPH}</p><script>1<2</script></article>", PARAGRAPH),
    "comment": (f"<article><!-- <p>no</p> --><p>{PARAGRAPH}</p></article>", PARAGRAPH),
    "advert": (f'<article><p>{PARAGRAPH}</p><div class="ad">{PARAGRAPH}</div><p>{PARAGRAPH}</p></article>', f"{PARAGRAPH} {PARAGRAPH}"),
    "sidebar": (f'<main><p>{PARAGRAPH}</p></main><aside><p>{PARAGRAPH}</p></aside><div id="sidebar">{PARAGRAPH}</div>', PARAGRAPH),
    "readers": (f'<article><p>{PARAGRAPH}</p><section class="comments"><p>{PARAGRAPH}</p></section></article>', PARAGRAPH),
    "notice": (f'<div class="cookie-notice">{PARAGRAPH}</div><header><h2>Site</h2></header><div class="post"><h1>Head</h1><p>{PARAGRAPH}</p></div>', f"Head {PARAGRAPH}"),
    "form": (f"<article><p>{PARAGRAPH}</p><form><label>Your name here</label><input><button>Go</button></form></article>", PARAGRAPH),
    "headline": (f'<article><header class="entry-header"><h1>Head</h1><p>By me</p></header><p>{PARAGRAPH}</p></article>', f"Head {PARAGRAPH}"),
    "null": (None, ""),
    "empty": ("", ""),
    "broken": ("<<p <div <", None),
    "list": (f"<article><p>{PARAGRAPH}</p><ul><li>one thing<li>two things</ul><p>{PARAGRAPH}</p></article>", f"{PARAGRAPH} one thing two things {PARAGRAPH}"),
}


def test_pages(spark):
    rows = [(n, name, html, "x") for n, (name, (html, _)) in enumerate(PAGES.items())] + [(None, None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_extract.extract(df).collect()
    assert len(found) == len(rows)
    for r in found:
        expected = PAGES[r["url"]][1] if r["url"] else ""
        assert r["n_chars"] == len(r["text"])
        assert expected is None or r["text"] == expected, r["url"]
    assert html_extract.extract(df.limit(0)).collect() == []


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + f"<p>{PARAGRAPH}</p>" + "</div>" * 3000
    assert PARAGRAPH in html_extract.main_text(deep)
    long = "<article>" + f"<p>{PARAGRAPH}</p>" * 3000 + "</article>"
    assert html_extract.main_text(long) == " ".join([PARAGRAPH] * 3000)


def test_given_pages_give_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        spaced = re.sub(r"</?(p|h1|br)\b[^>]*>", " ", article)
        assert found[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]+>", "", spaced)).split())


# -- toxicity ----------------------------------------------------------------


def test_fold():
    assert toxicity.fold("1D10T! idіоt IDIOT id​iot ｉｄｉｏｔ") == ["idiot"] * 5
    assert toxicity.fold("$tupid m0r0n 2024 a&b") == ["stupid", "moron", "2024", "a", "b"]
    assert toxicity.fold("clown c1own") == ["ciown", "ciown"]


def test_matching_stems_words_and_exceptions():
    lexicon = toxicity.Lexicon({"=trash": 3.0, "veju": 2.0}, frozenset({"trash can"}), -2.0, (1.0, 1.0))
    matcher = lexicon.matcher()
    assert list(matcher.hits(toxicity.fold("a trash can and trash")).values()) == [3.0]
    assert len(matcher.hits(toxicity.fold("vejuais veju trashy"))) == 1
    assert len(matcher.hits(toxicity.fold("träsh Véjuais"))) == 2
    assert matcher.hits([]) == {} and toxicity.Lexicon().matcher().hits(["a"]) == {}
    assert matcher.score("trash trash") > matcher.score("trash") > matcher.score("") > 0


@pytest.fixture(scope="module")
def judged(spark):
    """Texts of which a fifth is toxic by one of three words or a stem; labels of most of them."""
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(1500):
        text = ["".join(rng.choice("aeioubdfgkmnprstz") for _ in range(5)) for _ in range(rng.randint(8, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["gloop", "Squib", "fl1nt", "zarn" + rng.choice("abcdefg") + "x"]))
        rows.append((i, " ".join(text), "x"))
        marks.append((i, 0, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks


def test_toxicity_on_held_out_rows(judged):
    docs, labels, marks = judged
    truth = {i: t for i, _, t in marks}
    found = toxicity.classify(docs, labels).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if ref.crc_held_out(i)}
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_held_out_labels_are_not_used(judged):
    docs, labels, _ = judged
    flipped = labels.withColumn("toxic", toxicity.F.expr("case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end"))
    one, two = (toxicity.fit(docs.select("doc_id", "text"), x) for x in (labels, flipped))
    assert one == two
    assert "=gioop" in one.weights and "zarn" in one.weights


def test_toxicity_edge_rows(edge, no_docs, no_labels, judged):
    found = toxicity.classify(edge, no_labels).collect()
    assert len(found) == edge.count() and all(r["score"] < 1e-6 and r["predicted"] == 0 for r in found)
    assert toxicity.classify(no_docs, judged[1]).collect() == []
    kept = toxicity.without_toxic(edge, no_labels)
    assert kept.columns == edge.columns and kept.count() == edge.count()
    clean = toxicity.without_toxic(judged[0], judged[1]).collect()
    assert 1150 <= len(clean) <= 1250


# -- neighbours --------------------------------------------------------------


def brute(ids, x, every, k):
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            scores = {j: float(neighbours.cosine(x[n][None], x[m][None])[0]) for m, j in enumerate(ids) if j != i}
            out[i] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = df.collect()
    x = np.array([r["embedding"] for r in rows], float)
    expected = brute([r["vec_id"] for r in rows], x, 50, 5)
    found = ref.grouped(neighbours.nearest(df).collect(), "query_id")
    hits = 0
    for i, near in expected.items():
        got = sorted(found[i], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in got] == sorted((-r["score"], r["vec_id"]) for r in got)
        hits += len({r["vec_id"] for r in got} & {j for j, _ in near})
    assert hits >= 0.9 * 5 * len(expected)


def test_probes_come_in_order():
    inside = np.array([0.1, 0.55, 0.8])
    cost = lambda steps: sum(inside[j] ** 2 if d < 0 else (1 - inside[j]) ** 2 for j, d in steps)
    order = neighbours.probe_order(inside, 100)
    assert order[0] == [] and len(order) == 27
    assert [cost(s) for s in order] == sorted(cost(s) for s in order)
    assert len({tuple(sorted(s)) for s in order}) == 27


def test_equal_vectors_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "GROUP", 100)
    monkeypatch.setattr(neighbours, "QUERIES", 2)
    rng = random.Random(6)
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 0) for i in range(120)]
    rows += [(200 + i, [rng.gauss(0, 1) for _ in range(4)], 0) for i in range(60)]
    odd = [None, [], [0.0] * 4, [1.0, None, 1.0, 1.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0]]
    rows += [(1000 + 50 * i, v, 0) for i, v in enumerate(odd)] + [(None, [1.0] * 4, 0), (0, [1.0, 2.0, 3.0, 4.0], 0), (1500, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(7)
    found = ref.grouped(neighbours.nearest(df).collect(), "query_id")
    assert set(found) == {0, 50, 100, 200, 250}
    assert [r["vec_id"] for r in sorted(found[0], key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
    assert [r["vec_id"] for r in sorted(found[50], key=lambda r: r["rank"])] == [0, 1, 2, 3, 4]
    assert all(r["score"] == pytest.approx(1, abs=1e-12) for r in found[50])


def test_few_vectors_give_all_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [-1.0, 0.1]), (9, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found = sorted(neighbours.nearest(df).collect(), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in found] == [9, 7]
    assert neighbours.nearest(df.limit(0)).collect() == []


ODD_PAGES = [
    ("<article><p>{p}</p><![foo[ x ]]></article>", "{p}"),
    ("<article><p>{p}</p><![if IE]><!foo><?php x ?><!DOCTYPE x [<!y]></article>", "{p}"),
    ("<article class='post tag-notice category-social'><p>{p}</p></article>", "{p}"),
    ("<div class='content share-enabled'><p>{p}</p></div>", "{p}"),
    ("<div class='content sidebar'><p>{p}</p></div>", ""),
    ("<article><div class='post-comments'><p>{p}</p></div></article>", ""),
    ("<article><svg/><p>{p}</p><math/><p>{p}</p></article>", "{p} {p}"),
    ("<article><svg><path/><text>no</text></svg><p>{p}</p></article>", "{p}"),
    ("<article><p>{p} &#{nines}; &#{zeros}65;</p></article>", "{p} � A"),
]


@pytest.mark.parametrize("markup, text", ODD_PAGES)
def test_odd_markup_gives_its_article(markup, text):
    values = {"p": PARAGRAPH, "nines": "9" * 6000, "zeros": "0" * 6000}
    fill = lambda s: __import__("re").sub(r"\{(\w+)\}", lambda m: values[m[1]], s)
    assert html_extract.main_text(fill(markup)) == fill(text)


def test_no_markup_stops_a_page():
    rng = random.Random(7)
    bits = ["<", ">", "</", "/>", "<!", "<![", "]]>", "<!--", "-->", "<?", "&#", "&#x", "&amp", ";", "=", "'", '"', " ", "\n", "\x00", "é", "9" * 20]
    bits += ["<p>", "<svg/>", "<math>", "<body>", "<html", "<li>", "<table><td>", "article", "class='post ad'", "<script>", "</script", "text here."]
    bits += ["<![CDATA[", "<!DOCTYPE", "<!ELEMENT x", "<textarea>", "<title>", "<plaintext>", "<a href=x>", "</a>", "<form>", "</body></html>"]
    for _ in range(3_000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))
        assert isinstance(html_extract.main_text(html), str), html


@pytest.mark.parametrize("shape", ["nested", "unclosed", "inline"])
def test_deep_pages_take_time_in_proportion(shape):
    import time

    n = 8_000
    before = {"nested": "<div>" * n, "unclosed": "", "inline": "<article>"}[shape]
    each = {"nested": "<p>{}</p>", "unclosed": "<div><p>{}</p>", "inline": "<b><p>{}</p>"}[shape]
    page = before + "".join(each.format(f"{PARAGRAPH} {i}.") for i in range(n))
    started = time.time()
    assert html_extract.main_text(page).count(PARAGRAPH) == n
    assert time.time() - started < 4
