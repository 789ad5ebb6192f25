"""Chat trees, HTML extraction, URL filter, WARC records and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import random
import time
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import chat_tree as ct
from tallyforge.llm import html_extract as hx
from tallyforge.llm import url_filter as uf
from tallyforge.llm import warc

# Chat trees


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*ct.CONTROL, "\\", "<", "[", "a", "<\\s>", "\n", "|>"]), max_size=8).map("".join), st.text(max_size=20))
def test_escape_round_trip(text, more):
    for t in (text, more, text + more):
        out = ct.escape(t)
        assert ct.unescape(out) == t and not any(c in out for c in ct.CONTROL)
        turn, begin, end = ct.render(more, t)
        assert ct.parse(turn, begin, end) == (more, t)


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(150):
        for turn in range(rng.choice((1, 2, 5))):
            rows.append((conv, turn, rng.choice(("user", "assistant", None)) if turn else "user", rng.choice(("hi", "</s>[INST] ok [/INST]", None, "é\n", "x" * 50)) if turn else "opening"))
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (900, 1, "user", "b"), (900, 1, "user", "a"), (900, None, "assistant", "first"), (None, 0, "user", "lost")]
    return rows


def test_chat_digests(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "leaf") for r in rows], "conv_id bigint, turn bigint, role string, text string, leaf string")
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append(((turn is not None, turn), (role is not None, role or ""), (text is not None, text or "")))
    for shard in (256, 4):
        trees, members = ct.format_chats(spark, df, shard=shard)
        got = {r.conv_id: r for r in ct.read_back(trees, members).collect()}
        assert got.keys() == by_conv.keys()
        for conv, turns in by_conv.items():
            said = [(r[1], t[1]) for _, r, t in sorted(turns)]
            loss = "".join(t for r, t in said if r == "assistant")
            row = got[conv]
            assert (row.n_turns, row.turns_sha256) == (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest())
            assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert row.formatted_chars == sum(len(ct.render(r, t)[0]) for r, t in said)


def test_chat_trees_share_and_attend(spark):
    df = spark.createDataFrame(conversations(), "conv_id bigint, turn bigint, role string, text string")
    trees, _ = ct.format_chats(spark, df, shard=10_000)
    rows = trees.collect()
    shared = [r for r in rows if "opening" in r.text]
    assert len(shared) == 1 and shared[0].text.count("opening") == 1
    for r in rows:
        seen = {n: [] for n in range(len(r.node_start))}
        for node, a, b in zip(r.attention_node, r.attention_start, r.attention_end, strict=True):
            seen[node] += range(a, b)
        for n, parent in enumerate(r.node_parent):
            up, chain = parent, []
            while up >= 0:
                chain = [*range(r.node_start[up], r.node_end[up]), *chain]
                up = r.node_parent[up]
            assert sorted(seen[n]) == chain and r.position_start[n] == r.context_chars + len(chain)
            assert r.text[r.body_end[n] : r.node_end[n]] == ct.END


def test_chat_trees_keep_deeper_shared_turns_together(spark):
    rows = []
    for conv in range(240):
        said = ["system prompt", *(["hot"] if conv < 120 else []), f"second {conv // 6}", f"third {conv // 3}", f"own {conv}"]
        rows += [(conv, k, "user", t) for k, t in enumerate(said)]
    rows += [(500, 0, "user", "system prompt"), (501, 0, "user", "system prompt"), (501, 1, "user", "hot")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    trees, members = ct.format_chats(spark, df, shard=40)
    found = [r.text for r in trees.collect()]
    assert len(found) > 2 and ct.read_back(trees, members).count() == 242
    for turn, kinds in (("second", 40), ("third", 80), ("own", 240)):
        assert {sum(t.count(f"user\n{turn} {k}<|im_end|>") for t in found) for k in range(kinds)} == {1}
    assert sum(t.count("user\nhot<") for t in found) == sum(t.count("user\nsystem prompt<") for t in found) == 1
    at = {r.tree: r for r in trees.collect()}
    deep = next(r for r in at.values() if "own 0<" in r.text)
    before = [at[name].text for name in deep.context]
    assert [ct.parse(t, at[n].body_start[0], at[n].body_end[0])[1] for n, t in zip(deep.context, before, strict=True)] == ["system prompt", "hot"]
    assert deep.context_chars == sum(map(len, before)) == deep.position_start[0]


def test_chat_hot_first_turn_with_long_texts(spark):
    long = "w " * 200_000
    rows = [(conv, 0, "system", "s" if conv else long) for conv in range(30)] + [(conv, 1, "user", f"q{conv % 7}") for conv in range(30)] + [(40, 0, "system", "s"), (41, 0, "system", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    trees, members = ct.format_chats(spark, df, shard=2)
    got = {r.conv_id: r for r in ct.read_back(trees, members).collect()}
    assert len(got) == 32 and got[0].formatted_chars == sum(len(ct.render(r, t)[0]) for r, t in (("system", long), ("user", "q0")))
    assert got[8].turns_sha256 == hashlib.sha256(b"system\ns\nuser\nq1\n").hexdigest() and got[40].turns_sha256 == hashlib.sha256(b"system\ns\n").hexdigest()
    assert sum(r.text.count("<|im_start|>system\ns<|im_end|>") for r in trees.collect()) == 1


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert ct.read_back(*ct.format_chats(spark, df)).count() == 0


# HTML

ARTICLE = "<article><h1>Big &amp; small</h1><p>One  two<br>three.</p><div class='ad'>Buy now</div><p>Four <b>five</b>&nbsp;six &#233;</p><ul><li>seven words stand here now</li></ul></article>"
PAGES = {
    "semantic": f"<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>{ARTICLE}<aside><p>Related stories to read next week</p></aside><section id='comments'><p>I like this very much indeed</p></section><footer>&copy; us</footer></body></html>",
    "unclosed": f"<body><div class=menu><a href=/>Home</a></div>{ARTICLE.replace('</li></ul>', '')}<footer>foot",
    "wrapped": f"<body><div class='page with-sidebar'><div id='sidebar-layout'><main>{ARTICLE}</main></div><div class='sidebar'><p>Other news of the day for you</p></div></div></body>",
    "plain": "<body><div class='top-menu'><a href=/>a</a> <a href=/>b</a></div><div class='post'><h2>Big &amp; small</h2><p>One  two<br>three.</p><p>Four <b>five</b>&nbsp;six &#233;</p><div>seven words stand here now</div></div><div class='footer'>end</div></body>",
    "cookie": f"<body><div id='cookie-banner'><p>We use cookies to improve the site for you</p><button>OK</button></div>{ARTICLE}<form><label>Search</label><textarea>z</textarea></form></body>",
}


@pytest.mark.parametrize("name", PAGES)
def test_html(name):
    weights = hx.Weights(hx.labelled_pages())
    assert hx.extract(PAGES[name], weights) == "Big & small\n\nOne two three.\n\nFour five six é\n\nseven words stand here now"


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<div class='post'>", "</div>")])
def test_html_keeps_linked_words(open_, close):
    said = "many words of the story stand here so that it is long enough to be found"
    body = f"<p>{said}</p><div>See <a href=/r>the report</a> for more</div><ul><li><a href=/s>A source</a> of it</li></ul><table><tr><td><a href=/t>Table</a> cell</td></tr></table><section><a href=/u>Appendix</a></section><p>{said}</p>"
    page = f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav>{open_}{body}<div class=ad><a href=/b>Buy</a></div><p>{said}</p>{close}<footer><a href=/>us</a></footer></body>"
    expected = [said, "See the report for more", "A source of it", "Table cell", "Appendix", said, said]
    assert hx.extract(page, hx.Weights(hx.labelled_pages())) == "\n\n".join(expected)


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p></p>", "x"), (4, "u", "<article>" + "<p>word here and there</p>" * 20_000, "x"), (5, "u", "a < b and c > d", "x")], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in hx.extract_pages(spark, pages).collect()}
    assert [got[i].text for i in (1, 2, 3)] == ["", "", ""] and got[4].text.count("word here and there") == 20_000
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[5].text == "a < b and c > d"


def test_html_weights_are_signed():
    weights = hx.Weights(hx.labelled_pages())
    assert all(v < 0 for f, v in weights.of.items() if f[0] == "t" and f != "t:marked") and weights.word("w:text+") > 0 and weights.word("w:marked") == 0 > weights.word("w:link")


SAID = "many words of the story stand here so that it is long enough to be found"


@pytest.mark.parametrize("name", "share-price side-effects related-work banner-year comment-on-ruling form-factor social-policy".split())
def test_html_names_of_content_that_hold_a_word_of_boilerplate(name):
    page = f"<body><nav><a href=/>Home</a></nav><article><p>{SAID}</p><p class='{name}'>It stays</p><p>{SAID}</p></article><div id='kommentare'><p>Sehr schön</p></div></body>"
    assert hx.extract(page, hx.Weights(hx.labelled_pages())) == f"{SAID}\n\nIt stays\n\n{SAID}"


@pytest.mark.parametrize("at", ["class=discussion", "id=discussion", "class=reader", "class=brand"])
def test_html_keeps_sections_of_an_article(at):
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{SAID}</p><section {at}><h2>Last part</h2><p>{SAID}</p></section></article><footer>end</footer></body>"
    assert hx.extract(page, hx.Weights(hx.labelled_pages())) == f"Title\n\n{SAID}\n\nLast part\n\n{SAID}"


@pytest.mark.parametrize("at", ["class=outbrain", "class=taboola-feed", "class=js-ad-slot-12", "id=cookie-law-info-bar", "class=commentaires-lecteurs", "aria-label=advertisement", 'aria-label="Advertisement"', "class='x comments y'"])
def test_html_drops_boilerplate_of_unknown_words(at):
    page = f"<body><article><h1>Title</h1><p>{SAID}</p><div {at}><p>Not a word of this is part of it</p></div><p>{SAID}</p></article></body>"
    assert hx.extract(page, hx.Weights(hx.labelled_pages())) == f"Title\n\n{SAID}\n\n{SAID}"


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<div class=post>", "</div>")])
def test_html_long_insertion_cuts_nothing(open_, close):
    inserted = "<section class=comments>" + "<p>They all say that it was so and so</p>" * 200 + "</section>"
    page = f"<body>{open_}<h1>Title</h1><p>A short opening</p>{inserted}{f'<p>{SAID}</p>' * 3}{close}</body>"
    assert hx.extract(page, hx.Weights(hx.labelled_pages())) == "\n\n".join(["Title", "A short opening", SAID, SAID, SAID])


def test_html_extraction_by_brute_force():
    """Pages of random pieces: the region is the best of all runs, and its unmarked words are put together."""
    rng, weights = random.Random(9), hx.Weights(hx.labelled_pages())
    pieces = ["<p>one two three</p>", "<nav><a href=/>x y</a></nav>", "<div class=ad>buy <b>this</b></div>", "<ul><li>four</li><li>five six</li></ul>", "<div>", "</div>", "<article>", "</article>", "seven", "<aside>eight</aside>", "<br>", "<p class=lead>nine &amp; ten", "<footer>end</footer>"]
    for _ in range(150):
        page = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        found = list(hx.tokens(page, weights.marks))
        value = [0.0 if not f else weights.word(f) * len(t.split()) if f[0] == "w" else weights.tag(f) for _, f, t, _ in found]
        top, at = 0.0, (0, 0)
        for a in range(len(found)):
            for b in range(a + 1, len(found) + 1):
                if sum(value[a:b]) > top + 1e-9:
                    top, at = sum(value[a:b]), (a, b)
        text = "".join("\n" if block else "" if f == "w:marked" else t.replace("\n", " ") for _, f, t, block in found[slice(*at)])
        assert hx.extract(page, weights) == "\n\n".join(" ".join(x.split()) for x in text.split("\n") if x.split())


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<p title=don't>hello", "hello"), ("<script src=x/>var a='secret code';</script><p>hello", "hello"), ("<p data-x='a>b' title=\"c>d\">hello</p>", "hello"), ("<svg/><p>hello</p><svg><title>x</title></svg>", "hello"),
        ("<article><p>hello you</p><math><mi>x</mi></math> <audio>sound</audio><form><select><option>no</option></select><textarea><p>no</textarea></form></article>", "hello you\n\nx sound"),
        ("<!--><p>hello</p>", "hello"), ("<p>hello <!-- a --!> you</p>", "hello you"),
    ],
)
def test_html_rules(page, expected):
    assert hx.extract(page, hx.Weights(hx.labelled_pages())) == expected


def test_html_is_linear_in_depth():
    weights = hx.Weights(hx.labelled_pages())
    deep = "<div>" * 100_000
    start = time.process_time()
    assert hx.extract(f"{deep}word here", weights) == "word here"
    assert hx.extract(f"{deep}{'<p>word</p></b>' * 2000}", weights).count("word") == 2000
    assert time.process_time() - start < 8


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=25))
def test_best_run_by_brute_force(values):
    sums = {(a, b): sum(values[a:b]) for a in range(len(values)) for b in range(a + 1, len(values) + 1)}
    a, b = hx.best_run(values)
    top = max(sums.values(), default=0)
    assert sums.get((a, b), 0) == max(0, top) and ((a, b) == (0, 0)) == (top <= 0)


def test_html_empty_repeated_and_clashing(spark):
    rows = [(1, "u", f"<article><p>{SAID}</p></article>", "a", 5)] * 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    assert hx.extract_pages(spark, pages.filter("false")).count() == 0
    assert [tuple(r) for r in hx.extract_pages(spark, pages).collect()] == [(1, "u", SAID, len(SAID))] * 3


# URLs


@pytest.mark.parametrize(
    "url, rule, verdict",
    [
        ("http://a.b.org/x", "org/", "allow"), ("https://EXAMPLE.org/es/1?x", "example.org/es/", "block"), ("http://m.example.org/en/12", "example.org/en/1", "block"), ("http://x.com/fr/", "com/fr/", "allow"),
        ("http://x.com/de/#f", "com/de/", "block"), ("http://org/", "org/", "allow"), ("http://xorg/", None, None), ("http://a.org", None, None), ("http://example.org/en/2", "org/", "allow"),
    ],
)
def test_rules(url, rule, verdict):
    assert uf.rule_for(*uf.split_url(url), uf.RULES) == (rule, verdict)


def test_urls(spark):
    rows = [(1, "http://casino-win.example.com/en/5"), (2, "http://www.city-library.example.net/en/77"), (3, None), (4, "nonsense"), (5, "s://A?b://c"), (6, "https://cheap-pills-online.example.net/x")]
    got = {r.page_id: r for r in uf.filter_urls(spark, spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, host string")).collect()}
    assert [got[i].verdict for i in (1, 2, 6)] == ["block", "allow", "block"]
    assert got[3].verdict == "allow" == got[4].verdict
    assert (got[3].host, got[3].path, got[4].host, got[5].host, got[5].path) == ("", "", "", "a", "")


def test_url_model_generalises():
    rows = uf.labelled_urls()
    rng = random.Random(1)
    rng.shuffle(rows)
    half = len(rows) // 2
    model = uf.UrlModel(rows[:half], steps=500)
    right = sum((model.score(*uf.split_url(u)) >= 0.5) == bool(y) for u, y in rows[half:])
    assert right / len(rows[half:]) > 0.85


#: Hosts that the labelled table doesn't hold.
UNRELATED = {
    1: "grandpokerpalace.com lucky-roulette.net viagra-direct.biz sexvideos.tv pornhost.net malwaredrop.ru torrentbay.org keygenhub.net sportbets365.com adult-films.net spamkings.com phishing-kit.net paydaynow.com casinoroyal24.eu escort-berlin.de warezworld.org",
    0: "berkeley.edu rijksmuseum.nl metoffice.gov.uk openstreetmap.net zalando.de oxfam.net deutschlandfunk.de letemps.ch smithsonianmag.com bandcamp.com gitlab.com postgresql.org unesco.net strava.com letterboxd.com bethlehem.net betty.com pharmacy.net crackle.com trackandtrace.info scunthorpe.gov.uk essex.ac.uk",
}


def test_url_model_on_unrelated_hosts(sf_dir, spark):
    table = uf.labelled_urls()
    hosts = {uf.split_url(u)[0] for u, _ in table}
    assert not hosts & {h for x in UNRELATED.values() for h in x.split()}
    assert not hosts & {uf.split_url(r.url)[0] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()}
    model = uf.UrlModel(table)
    for label, said in UNRELATED.items():
        right = [(model.score(host, "/en/17") >= 0.5) == bool(label) for host in said.split()]
        assert sum(right) / len(right) >= 0.8
    assert model.score("", "") < 0.5


def test_url_path_does_not_turn_the_host():
    model = uf.default_model()
    for host in [*(h for x in UNRELATED.values() for h in x.split()), "www.cheap-pills.example.com", "free-bets.example.com"]:
        verdicts = {model.score(host, path) >= 0.5 for path in ("", "/", "/en/4711", "/fr/1098/", "/de/20240101/a-long-name-of-an-article-that-says-much.html", "/x" * 300)}
        assert len(verdicts) == 1


def test_url_model_by_brute_force():
    """Scores gram by gram, and no weight can lower the loss: its slope by differences is nought everywhere."""
    rows = [("http://casino-bets.com/en/1", 1), ("http://free-bets.net/a", 1), ("http://bread.org/en/1", 0), ("http://garden.net/b", 0), ("http://museum.de/", 0)]
    model = uf.UrlModel(rows, buckets=64, steps=5000, decay=1e-2)

    def naive(url, weights, bias):
        host, path = uf.split_url(url)
        total = bias
        for kind, text in (("h", "".join(f"^{x}$" for x in host.split("."))), ("p", f"^{path}$")):
            grams = {text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)}
            for g in grams:
                total += weights[uf.xxhash.xxh64_intdigest(f"{kind}{g}".encode()) % 64] * (0.25 if kind == "h" else 0.05 / len(grams) ** 0.5)
        return 1 / (1 + np.exp(-total))

    def loss(weights):
        return np.mean([-np.log(p if y else 1 - p) for (u, y) in rows for p in [naive(u, weights, model.bias)]]) + 1e-2 * (weights**2).sum() / 2

    for url, label in rows:
        assert abs(model.score(*uf.split_url(url)) - naive(url, model.weights, model.bias)) < 1e-9 and (model.score(*uf.split_url(url)) >= 0.5) == bool(label)
    for k in range(0, 64, 7):
        step = np.zeros(64)
        step[k] = 1e-4
        assert abs(loss(model.weights + step) - loss(model.weights - step)) / 2e-4 < 1e-3


def slow_rule(host, path, rules):
    """By definition: a host's labels end with the rule's, and its path begins with the rule's."""
    fits = []
    for rule, verdict in rules:
        cut = rule.index("/")
        want, labels = rule[:cut].split("."), host.split(".")
        if labels[-len(want) :] == want and path[: len(rule) - cut] == rule[cut:]:
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["example", "org", "com", "x", ""]), max_size=4).map(".".join), st.lists(st.sampled_from(["/", "es", "en", "1", "fr", "de"]), max_size=5).map("".join))
def test_rules_by_definition(host, path):
    assert uf.rule_for(host, path, uf.RULES) == slow_rule(host, path, uf.RULES)


def test_urls_empty_repeated_and_clashing(spark):
    rows = [(1, "http://a.org/x", "v", "r")] * 3 + [(None, "http://" + "a" * 100_000 + "/" + "b" * 100_000, "v", "r")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, verdict string, rule string")
    assert uf.filter_urls(spark, pages.filter("false")).count() == 0
    got = uf.filter_urls(spark, pages).collect()
    assert len(got) == 4 and {(r.rule, r.verdict) for r in got if r.page_id} == {("org/", "allow")}


# WARC


def test_warc_round_trip(spark, tmp_path):
    page = "<html lang=fr><head><title>T &amp; U</title></head><body><p>Été</p><a href='/x?a=1&amp;b=2'>link</a></body></html>"
    pages = spark.createDataFrame([(1, "http://h.org/d/", page), (2, None, None)], "page_id bigint, url string, html string")
    rows = warc.derivatives(warc.responses_of_pages(pages)).collect()
    assert [r.warc_type for r in rows] == ["metadata", "conversion"] * 2
    meta, text = rows[:2]
    assert meta.refers_to == text.refers_to == meta.source_id and uuid.UUID(meta.record_id[9:]) and meta.record_id != text.record_id
    assert meta.source_digest == text.source_digest == warc.digest(page.encode())
    warc.write_warc(warc.derivatives(warc.responses_of_pages(pages)), str(tmp_path / "w"))
    found = {h["warc-record-id"]: (h, b) for f in (tmp_path / "w").glob("*.txt") for h, b in warc.parse_warc(f.read_bytes())}
    assert len(found) == 4
    headers, block = found[f"<{text.record_id}>"]
    assert block.decode() == "Été\nlink" and headers["warc-block-digest"] == warc.digest(block) and headers["warc-target-uri"] == "http://h.org/d/"
    block = found[f"<{meta.record_id}>"][1].decode()
    for line in ("title: T & U", "language: fr", "source-status: HTTP/1.1 200 OK", "source-content-type: text/html; charset=utf-8", "outlink: http://h.org/x?a=1&b=2 L a/@href"):
        assert line in block.split("\r\n")


def test_warc_empty_repeated_long_and_clashing(spark):
    long = "<p>" + "word " * 100_000 + "</p>"
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "y"), (2, "v", long, "z"), (None, None, "", None)], "page_id bigint, url string, html string, record string")
    rows = warc.derivatives(warc.responses_of_pages(pages)).collect()
    assert len(rows) == 8 and len({r.record_id for r in rows if r.source_id == rows[0].source_id}) == 2
    assert max(r.content_length for r in rows) == len("word " * 100_000) - 1
    assert warc.derivatives(warc.responses_of_pages(pages.limit(0))).count() == 0


def test_warc_reader(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>caf\xc3\xa9</p>"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 6\r\n\r\nWARC/1\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(other) + gzip.compress(record))
    got = warc.read_responses(spark, str(tmp_path)).collect()
    assert [(r.record_id, r.target_uri, r.payload) for r in got] == [("urn:uuid:1", "http://a/", "<p>café</p>")]
    assert warc.derivatives(warc.read_responses(spark, str(tmp_path))).filter("warc_type = 'conversion'").first().content_length == 5


def test_warc_keeps_source_headers_and_bytes(spark, tmp_path):
    page = "<p>Café</p>".encode("latin-1")
    packed = gzip.compress(page)
    chunked = b"%x\r\n%s\r\n%x;x=y\r\n%s\r\n0\r\n\r\n" % (5, packed[:5], len(packed) - 5, packed[5:])
    sources = {
        "1": ("WARC-Payload-Digest: sha1:ABC\r\nWARC-Block-Digest: sha1:DEF\r\nWARC-IP-Address: 10.0.0.1\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\n", b"Content-Type: text/html; charset=ISO-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked", chunked),
        "2": ("", b"Content-Type: text/html; charset=ISO-8859-1", page),
        "3": ("", b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked", "<p>Café</p>".encode()),
    }
    data = b""
    for i, (own, head, body) in sources.items():
        block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
        data += f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\n{own}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(data)
    got = {(r.source_id[9:], r.warc_type): r for r in warc.derivatives(warc.read_responses(spark, str(tmp_path))).collect()}
    assert all(got[i, "conversion"].record.endswith("\r\n\r\nCafé") for i in sources)
    for i, digest in (("1", "sha1:ABC"), ("2", warc.digest(page)), ("3", warc.digest("<p>Café</p>".encode()))):
        assert {got[i, kind].source_digest for kind in ("metadata", "conversion")} == {digest}
    lines = got["1", "metadata"].record.split("\r\n")
    for line in ("source-warc-block-digest: sha1:DEF", "source-warc-ip-address: 10.0.0.1", "source-warc-concurrent-to: <a>", "source-warc-concurrent-to: <b>"):
        assert line in lines


def warc_record(i, block, length=None):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\n".encode() + (b"" if length == "" else f"Content-Length: {len(block) if length is None else length}\r\n".encode()) + b"\r\n" + block + b"\r\n\r\n"


BLOCK = b"HTTP/1.1 200 OK\r\n\r\n<p>x</p>"
DAMAGED = {
    "no number": (warc_record(1, BLOCK) + warc_record(2, BLOCK, "abc") + warc_record(3, BLOCK), [1, 3], ["no valid Content-Length"]),
    "no length": (warc_record(1, BLOCK + b" WARC/1.0 in it", "") + warc_record(2, BLOCK), [2], ["no valid Content-Length"]),
    "negative": (warc_record(1, BLOCK, "-5") + warc_record(2, BLOCK), [2], ["no valid Content-Length"]),
    "cut record": (warc_record(1, BLOCK) + warc_record(2, BLOCK)[:-12], [1], ["cut record"]),
    "no head": (b"garbage\r\n\r\n" + warc_record(1, BLOCK), [1], ["no record"]),
    "cut member": (gzip.compress(warc_record(1, BLOCK)) + gzip.compress(warc_record(2, BLOCK))[:-20], [1], ["cut gzip member", "cut record"]),
    "bytes after": (gzip.compress(warc_record(1, BLOCK)) + b"tail of other bytes", [1], ["not a gzip member"]),
    "bytes between": (gzip.compress(warc_record(1, BLOCK)) + b"xyz" + gzip.compress(warc_record(2, BLOCK)), [1, 2], ["not a gzip member"]),
    "damaged member": (gzip.compress(warc_record(1, BLOCK))[:30] + b"\xff" * 40 + gzip.compress(warc_record(2, BLOCK)), [2], None),
    "empty file": (b"", [], []),
}


@pytest.mark.parametrize("name", DAMAGED)
def test_warc_damage_is_passed_over_and_listed(spark, tmp_path, name):
    data, kept, reasons = DAMAGED[name]
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(warc_record(9, BLOCK))
    assert sorted(int(r.record_id[9:]) for r in warc.read_responses(spark, str(tmp_path)).collect()) == [*kept, 9]
    found = [r.reason for r in warc.read_damage(spark, str(tmp_path)).collect()]
    assert found and found[0] == "damaged gzip member" if reasons is None else found == reasons


def test_warc_members_are_read_in_linear_time():
    data = gzip.compress(warc_record(1, BLOCK)) * 20_000
    start = time.process_time()
    assert sum(1 for _ in warc.warc_records(data)) == 20_000 and time.process_time() - start < 10


def test_warc_digests_and_text_by_brute_force(spark, sf_dir):
    """Every page's two records against hashes and text made by the standard library alone."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        blocks = frozenset("address article aside blockquote body div dl dt dd figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section table td th tr ul title head".split())

        def __init__(self):
            super().__init__()
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "title", "head")
            self.out.append("\n" if tag in self.blocks else " " if tag == "br" else "")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "title", "head")
            self.out.append("\n" if tag in self.blocks else "")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(" ".join(data.split("\n")))

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    named = {r.record_id: r.page_id for r in warc.responses_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("target_uri")), "target_uri").collect()}
    rows = warc.derivatives(warc.responses_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        page = pages[named[r.source_id]].html
        assert r.source_digest == "sha256:" + hashlib.sha256(page.encode()).hexdigest()
        head, _, block = r.record.partition("\r\n\r\n")
        assert r.block_digest == "sha256:" + hashlib.sha256(block.encode()).hexdigest() and f"Content-Length: {len(block.encode())}" in head.split("\r\n")
        if r.warc_type == "conversion":
            parser = Text()
            parser.feed(page)
            text = [" ".join(x.split()) for x in "".join(parser.out).split("\n")]
            assert block == "\n".join(x for x in text if x)


# Pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p
    from tallyforge.llm.decontaminate import words_of

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit(1))
    kept = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, kept, sf_dir).cache()
        assert after.columns == list(p.COLUMNS) and 0 < after.count() <= kept.count(), name
        before = {r.doc_id: r.text for r in kept.collect()}
        texts = {r.doc_id: r.text for r in after.collect()}
        assert texts.keys() <= before.keys()
        if name == "line_dedup":
            from test_text_ops import kept_lines

            ids = sorted(before)
            assert [texts[i] for i in ids] == kept_lines([before[i] for i in ids], 10)
        if name == "near_dedup":
            from test_text_ops import components_of

            ids = sorted(before)
            parts, _ = components_of([before[i] for i in ids], 2)
            assert texts == {i: before[i] for k, i in enumerate(ids) if parts[k] == k}
        if name == "decontamination":
            bench = [words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            windows = {tuple(w[k : k + 10]) for w in bench for k in range(len(w) - 9)}
            clean = {i for i, t in before.items() if not any(tuple(w[k : k + 10]) in windows for w in [words_of(t)] for k in range(len(w) - 9))}
            assert texts.keys() == clean
        kept = after
    pieces = p.STAGES[-1][1](spark, kept, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(texts)
    assert p.run(spark, sf_dir).select("doc_id").distinct().count() == len(texts)


def test_pipeline_near_duplicates_judge_rows(spark, sf_dir):
    import corpus_pipeline as p

    same, other = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, same), (1, other), (1, same), (2, other), (None, same), (None, None), (3, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r.doc_id, r.text) for r in p.drop_near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [(1, same), (1, other), (None, None), (3, None), (4, ""), (4, "")]))


def test_pipeline_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as p

    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(None, None, None, None, None, 1), (1, "a b c d", "en", "s", 7, 1), (1, "a b c d", "en", "s", 7, 1), (2, "", None, "s", 0, 1), (3, long, "en", None, None, 1), (None, "x y z", "en", "s", 5, 1)]
    rows += [(100 + i, f"only {i} here\nshared line of all", "en", "s", 1, 1) for i in range(12)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "q"), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = p.run(spark, str(tmp_path)).collect()
    ids = sorted({str(r.doc_id) for r in pieces})
    assert ids == sorted(["1", "2", "3", "None", *(str(100 + i) for i in range(12))])
    assert sum(r.length for r in pieces if r.doc_id == 1) == next(r.doc_tokens for r in pieces if r.doc_id == 1)  # one of the equal rows


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    for name, ddl in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
