import hashlib
import re
import zlib
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from xylem.llm import extraction, media, mixing, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div id="cookie-notice">We use cookies</div><div class="layout"><div class="sidebar-left">Popular<p>x</p></div><main><h1>Title &amp; more</h1><p>One <b>bold</b>,
two&nbsp;three<br>four<p>Five<ul><li>six<li>seven</ul><form>Search <input></form><div class="ad">Buy</div><script>var a="</p>";</script>
<section class="comments"><p>First!</p></section></main></div><footer>End</footer></body></html>"""


def test_boilerplate_is_left_out():
    assert extraction.extract_text(PAGE) == "Title & more One bold, two three four Five six seven"
    assert extraction.extract_text(None) == extraction.extract_text("") == extraction.extract_text("<nav>x</nav>") == ""
    assert extraction.extract_text("just text") == "just text"
    assert extraction.extract_text("<p>a</b>b<p>c<table><tr><td>d<td>e") == "ab c d e"
    article = "<body><p>before</p><article><header><h1>H</h1></header><p>x<article class='comment'>no</article></p></article><article id=disqus>no</article></body>"
    assert extraction.extract_text(article) == "H x"
    assert extraction.extract_text("<div>" * 400 + "deep" + "</div>" * 400) == "deep"


def test_tree_matching_aligns_children():
    a, b = extraction.tree_of("<div><p>1</p><ul><li>x</ul><p>2</p></div>"), extraction.tree_of("<div><p>1</p><p>3</p></div>")
    size, pairs = extraction.match(a, b)
    assert size == 4 and [(x.tag, y.tag) for x, y in pairs] == [("#root", "#root"), ("div", "div"), ("p", "p"), ("p", "p")]


def test_wide_trees_are_matched_exactly():
    """Against the plain recursion, and wide ones against what they must give."""

    def plain(a, b):
        if a.tag != b.tag:
            return 0
        left, right = extraction.elements(a), extraction.elements(b)
        score = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, u in enumerate(left):
            for j, v in enumerate(right):
                score[i + 1][j + 1] = max(score[i + 1][j], score[i][j + 1], score[i][j] + plain(u, v))
        return 1 + score[-1][-1]

    rng = np.random.default_rng(6)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rng.choice(["div", "b", "i"], rng.integers(0, 5))) if depth else ""

    for _ in range(30):
        a, b = extraction.tree_of(tree(3)), extraction.tree_of(tree(3))
        size, pairs = extraction.match(a, b)
        assert size == plain(a, b) == len(pairs) and all(x.tag == y.tag for x, y in pairs)
    rows = lambda n, shift: "<table>" + "".join(f"<tr><td>{i}</td>{'<td></td>' * ((i + shift) % 3)}</tr>" for i in range(n)) + "</table>"
    size, pairs = extraction.match(extraction.tree_of(rows(3000, 0)), extraction.tree_of(rows(2999, 1)))
    assert size == len(pairs) and sum(x.tag == "tr" for x, _ in pairs) == 2999
    a, b = rng.integers(0, 4, 60).tolist(), rng.integers(0, 4, 50).tolist()
    worth = lambda x, y: 1 + x if x == y else 0
    total = lambda pairs: sum(worth(a[i], b[j]) for i, j in pairs)
    assert total(extraction._halved(a, b, worth)) == total(extraction._tabled(a, b, worth))


def test_names_need_confirming():
    article = "<div class='layout has-sidebar'><article><p>one two</p><section class='discussion'><p>three</p></section><div class='related-work'>four</div><p class='notice-period'>five</p></article></div>"
    assert extraction.extract_text(article) == "one two three four five"
    assert extraction.extract_text("<div id='page' class='no-comments'><p>one two</p></div>") == "one two"
    assert extraction.extract_text("<p>one two three</p><div class='my-sidebar'><a>four</a></div><section class=discussion><p class=comment>five</p></section><div class=sidebar>six</div>") == "one two three"


def test_pages_inside_a_form():
    assert extraction.extract_text("<body><form><nav>Menu</nav><div><p>all of the page</p></div><form><label>Search</label>for <input></form></form></body>").startswith("all of the page")
    assert extraction.extract_text("<body><form>log in</form><p>the text of the page is here</p></body>") == "the text of the page is here"


def test_broken_sections_and_deep_pages():
    for broken in ("<![foo[bar]]>", "<![ foo ]>"):
        assert extraction.extract_text(f"<p>a</p>{broken}<p>rest of page</p>") == "a rest of page"
    for tag in ("div", "b"):
        assert extraction.extract_text(f"<{tag}>" * 3000 + "deep") == "deep"
        assert extraction.induce([f"<{tag}>" * 1500 + x for x in "abc"]) == {}


def test_templates_decide_inside_articles():
    page = "<main><h1>{0}</h1><article><p>{1}</p><div class=x><p>Subscribe to us</p></div></article></main>"
    parts = [(cases.prose(i, 4, 4000), cases.prose(50 + i, 30, 4000)) for i in range(4)]
    template = {path: frozenset(found) for path, found in extraction.induce([page.format(*p) for p in parts]).items()}
    assert all(extraction.extract_text(page.format(*p), template) == " ".join(p) for p in parts)
    assert extraction.extract_text("<div><p>the main text is here</p></div><article>teaser</article>") == "the main text is here teaser"


def site(i, words):
    return f"<html><body><div class=x1><p>Our site about things</p></div><div class=x2><p>{words}</p></div><div class=x3><p>All rights kept</p></div></body></html>"


def test_wrapper_of_a_host_is_template(spark):
    rows = [(i, f"https://A.example/{i}", site(i, cases.prose(i, 30, 4000)), 1) for i in range(12)]
    rows += [(100 + i, "http://copies.example/", site(0, "the same words here " * 5), 1) for i in range(6)] + [(200, None, None, 1), (201, "x", "", 1), (200, None, None, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(3)
    got = [(r.page_id, r.text) for r in extraction.extract(pages).collect()]
    assert len(got) == len(rows)
    texts = dict(got)
    assert all(texts[i] == cases.prose(i, 30, 4000) for i in range(12))
    assert texts[100] == "Our site about things " + ("the same words here " * 5).strip() + " All rights kept"  # copies show no template
    assert texts[200] == texts[201] == ""
    assert extraction.extract(pages.limit(0)).count() == 0


def test_templates_count_all_pages_of_a_host(spark):
    """Ten hosts of 40 pages: what 31 of them have goes, what 29 have stays, wherever it is; and so by induce(), from the same pages."""
    rows, want = [], {}
    for host in range(10):
        for i in range(40):
            often, seldom, own = (7 * i + host) % 40 < 31, (11 * i + host) % 40 < 29, cases.prose(1000 * host + i, 40, 4000)
            parts = ["Kept by the house"] * often + ["Seen now and then"] * seldom
            rows.append((40 * host + i, f"http://h{host}.example/{i}", "<body>" + "".join(f"<div><p>{x}</p></div>" for x in [parts[-1] if parts else "", own, *parts[:-1]]) + "</body>"))
            kept = ["Seen now and then"] * seldom
            want[40 * host + i] = " ".join([*kept, own])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in extraction.extract(pages).collect()} == want
    template = extraction.induce([html for _, url, html in rows if "//h3." in url])
    assert all(extraction.extract_text(html, template) == want[i] for i, url, html in rows if "//h3." in url)


def test_copies_among_the_pages_of_a_host(spark):
    """Near copies that are nine tenths of a host, short ones beside long pages, and equal pages, never lose what they share."""
    page = "<body><div><p>{}</p></div><div><p>{}</p></div><div><p>{}</p></div></body>".format
    near = [("near", page(cases.prose(1, 20), f"edit {i}", cases.prose(2, 30))) for i in range(27)]
    near += [("near", page(cases.prose(10 + i, 2000), "x", f"end {i}")) for i in range(3)]
    equal = [("equal", page(cases.prose(20, 30), "a", "Our house"))] * 12 + [("equal", page(cases.prose(21 + i, 30), f"b{i}", f"c{i}")) for i in range(3)]
    two = [("two", page(cases.prose(30 + i % 2, 30, 4000), f"d{i % 2}", "Our house")) for i in range(4)]
    three = [("three", page(cases.prose(40 + i % 3, 30, 4000), f"e{i % 3}", "Our house")) for i in range(9)]
    rows = [(i, f"http://{host}/", html) for i, (host, html) in enumerate([*near, *equal, *two, *three])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for r in extraction.extract(pages).collect():
        whole = extraction.extract_text(rows[r.page_id][2])
        assert r.text == (whole.removesuffix(" Our house") if r.url == "http://three/" else whole)


def test_articles_of_the_test_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in queries.op8_html_extraction(spark, "/root/testdata/sf0.01").collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]+>", lambda g: "" if g[0] in ("<b>", "</b>") else " ", inner)).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_items_keep_order_and_captions():
    html = '<p>One &amp;<br>two</p><figure><img src="media:1" alt="x"><video src=v></video><figcaption> The <b>cap</b> </figcaption></figure>tail<img src="2" alt="alt"><script>no</script><img>'
    assert media.items_of(html) == [
        [0, "text", "One &", None, None], [1, "text", "two", None, None], [2, "image", None, "media:1", "The cap"], [3, "video", None, "v", "The cap"], [4, "text", "tail", None, None], [5, "image", None, "2", "alt"],
    ]
    assert media.items_of(None) == media.items_of("") == []


def test_payloads_are_lossless():
    for text in (None, "", "a" * 63, "a" * 64, "a" * 65, "é\x00\n"):
        raw = (text or "").encode()
        payload = media.payload_of(text)
        assert payload.startswith(raw) and len(payload) % 64 == 0 and 0 < len(payload) < len(raw) + 65 and not payload[len(raw) :].strip(b"\0")
        assert media.samples_of(media.to_picture(payload)) == payload
    with pytest.raises(ValueError):
        media.samples_of(b"P5 64 2 255\nshort")


def test_media_columns_of_all_rows(spark):
    got = media.media_columns(cases.docs(spark)).collect()
    assert len(got) == len(cases.rows())
    texts = {r[0]: r[1] for r in cases.rows() if r[0] is not None}
    by_text = {}
    for r in got:
        if r.doc_id is None:
            continue
        payload = media.payload_of(texts[r.doc_id])
        picture = media.to_picture(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((texts[r.doc_id] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(picture), hashlib.sha256(picture).hexdigest())
        assert (r.position, r.caption) == (1, f"{r.n_bytes} bytes of {r.doc_id}")
        assert by_text.setdefault(texts[r.doc_id] or "", r.feature) == r.feature
    assert media.media_columns(cases.empty(spark)).count() == 0


def test_unknown_digests_keep_their_items(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="media:none"><img src="http://x">'), (2, None)], "doc_id long, html string")
    stored = media.features(spark.createDataFrame([("d", media.to_picture(b"\0" * 64))], "digest string, picture binary"))
    rows = media.resolve(media.interleave(pages), stored).orderBy("position").collect()
    assert [(r.kind, r.ref, r.feature) for r in rows] == [("text", None, None), ("image", "media:none", None), ("image", "http://x", None)]


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    labelled = mixing.domains_of(labels)
    seen, held_out = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0), labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    domains = sorted(mixing.WEIGHTS)
    model = mixing.train(docs, seen, domains, mixing.Mixing(), "doc_id", "text")
    got = mixing.posteriors(docs.join(held_out.select("doc_id"), "doc_id"), model).join(held_out, "doc_id").collect()
    right = [domains[int(np.argmax(r.posterior))] == r.domain for r in got]
    assert len(got) > 500 and sum(right) / len(right) > 0.93
    assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in got)


def test_rates_meet_reachable_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(int(n), [float(x) for x in p]) for n, p in zip(rng.integers(1, 500, 300), rng.dirichlet([0.3, 0.3, 0.3], 300), strict=True)]
    members = spark.createDataFrame(rows, "n_tokens long, posterior array<double>").repartition(3)
    how = mixing.Mixing()
    steps, totals, wanted = mixing.descend(members, 3, lambda t: [t[0], 1.5 * t[1], 0.6 * t[2]], how)
    n, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    rates = mixing.rates_of(p, steps, how, 0)
    assert (rates >= 0).all() and (rates <= how.most).all()
    assert np.allclose((rates * n) @ p, totals) and np.abs(totals - wanted).max() <= 2e-4 * wanted.sum()


def test_unreachable_targets_get_the_nearest(spark):
    """With rates up to 1 the totals cannot grow; projected descent ends at the bound."""
    rows = [(10, [1.0, 0.0])] * 5 + [(10, [0.0, 1.0])] * 5
    members = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
    steps, totals, _ = mixing.descend(members, 2, lambda t: [2 * t[0], 0.5 * t[1]], mixing.Mixing(most=1.0))
    assert np.allclose(totals, [50, 25])


def test_targets_at_the_bound_are_reached(spark):
    """A target of 0, with posteriors that are never 0, needs many documents at the bound."""
    rng = np.random.default_rng(4)
    n, p = rng.integers(1, 500, 2000), rng.dirichlet([3.0, 0.5, 0.3], 2000)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>").repartition(3)
    how = mixing.Mixing()
    steps, totals, wanted = mixing.descend(members, 3, lambda t: [t[0], 0.03 / 0.97 * t[0], 0.0], how)
    best, error = nearest(n, p, wanted, 0.0, how.most)
    assert np.allclose((mixing.rates_of(p, steps, how, 0) * n) @ p, totals)
    assert error(totals) <= 1.001 * error(best) + 1e-8 * n.sum()


def nearest(n, p, wanted, low, most, rounds=5000):
    """Least-squares totals by brute force, and the error that they minimize: accelerated projected gradient on all rates at once."""
    inverse = np.linalg.inv((p * n[:, None]).T @ p)
    rates = before = np.ones(len(n))
    for k in range(rounds):
        ahead = rates + k / (k + 3) * (rates - before)
        before, rates = rates, np.clip(ahead - p @ (inverse @ ((ahead * n) @ p - wanted)), low, most)
    return (rates * n) @ p, lambda t: (t - wanted) @ inverse @ (t - wanted)


def test_rates_of_the_query_are_least_squares(spark):
    """The registered query's rates against brute force over its own posteriors."""
    got = queries.op10_mixing(spark, "/root/testdata/sf0.001").collect()
    domains = sorted(mixing.WEIGHTS)
    n, p, rates = np.array([r.n_tokens for r in got], float), np.array([[r[f"p_{d}"] for d in domains] for r in got]), np.array([r.rate for r in got])
    wanted = np.array([mixing.WEIGHTS[d] / mixing.WEIGHTS["clean"] for d in domains]) * (n @ p)[domains.index("clean")]
    best, error = nearest(n, p, wanted, 0.0, mixing.Mixing().most)
    assert error((rates * n) @ p) <= 1.001 * error(best) + 1e-7 * n.sum()
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got) and len(got) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_anchored_rates_never_fall(spark):
    rows = [(10, [0.6, 0.4])] * 5 + [(10, [0.1, 0.9])] * 5
    members = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
    how = mixing.Mixing(most=1.0, anchored=1.0)
    steps, _, _ = mixing.descend(members, 2, lambda t: [t[0], 0.0], how)
    rates = mixing.rates_of(np.array([r[1] for r in rows]), steps, how, 0)
    assert (rates[:5] == 1).all() and (rates[5:] < 0.5).all()


def test_mix_of_awkward_rows(spark):
    labelled = spark.createDataFrame([(1, "clean"), (20, "toxic"), (None, "low"), (3, "other")], "doc_id long, domain string")
    got = mixing.mix(cases.docs(spark), labelled, mixing.WEIGHTS, "clean").collect()
    assert len(got) == len(cases.rows()) and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    assert mixing.mix(cases.empty(spark), labelled, mixing.WEIGHTS, "clean").count() == 0
