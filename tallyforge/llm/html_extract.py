"""Main-text extraction by the maximum-scoring subsequence of a page's words and tags.

A page is a sequence of words and tags. Words score by where they stand, tags score negative; the
weights are smoothed log-odds from labelled pages, and one linear scan finds the contiguous run with the
greatest sum: the content region. The labelled pages also teach which elements hold boilerplate: an
element whose tag or names (the tokens of class, id and role, and an aria-label of one word) stand almost only
around words outside the content marks its words and tags, which score nothing, so that an insertion
of any length doesn't cut an article, and are left out of the region. Names are learnt apart within and outside
of an article, where a section may well be called discussion; and a part beside an unknown one is learnt
apart from the same part alone (so cookie-law marks, share-price doesn't). The other words of the region are
put together by blocks.

Defined results: null, empty and wordless pages give an empty text; of equal sums the first and
shortest run wins; unclosed and stray tags are tolerated; nothing is capped. Only page_id, url and
html are read.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import arrow_schema, in_batches, sliced

#: Elements whose content is no text of the page; /> closes only the drawing.
_RAW = "script|style|noscript|template|iframe|textarea"
_ATTRS = r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{_RAW})(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|<svg(?=[\s/>])(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>/]|/(?!>))*+(?:/>|>.*?(?:</svg\s*>|\Z))|<[!?][^>]*>"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LABEL = re.compile(r"(?:^|[\s\"'/])aria-label\s*=\s*(?:\"([\w-]+)\"|'([\w-]+)'|([\w-]+)(?=[\s/>]|$))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_TEXT = frozenset("p blockquote pre dd dt figcaption h1 h2 h3 h4 h5 h6".split())
_INLINE = frozenset("b i em strong span a".split())
#: Elements that hold the page or its article, whatever they are called.
_OPEN = frozenset("html body main article".split())


class Place(NamedTuple):
    """An open element: whether its words are boilerplate, by any element or by one's tag alone, and what they stand in."""

    tag: str
    marked: bool
    tag_marked: bool
    in_article: bool
    linked: bool
    block: str
    features: tuple[str, ...]


_TOP = Place("", False, False, False, False, "body", ())


def features(tag: str, attrs: str, in_article: bool) -> tuple[str, ...]:
    """What labelled pages know of an element: its tag, and its names; + says that it stands in an article."""
    names = {name for found in (*_ATTR.findall(attrs), *_LABEL.findall(attrs)) for name in "".join(found).lower().split()} if "=" in attrs else ()
    plus = "+" if in_article else ""
    return (f"tag:{tag}{plus}", *(f"name{plus}:{n}" for n in sorted(names)))


def tokens(page: str, marks: Callable[[str], bool], seen: Callable[[list[Place], int, str], None] | None = None) -> Iterator[tuple[int, str, str, bool]]:
    """(offset, feature, text, is_block) of each word run and tag; text is empty for tags.

    marks() says whether a feature of an element makes it boilerplate. What an article stands in counts by
    its tag only, as wrappers often have names like page-sidebar, and a header in it holds its heading.
    """
    stack: list[Place] = [_TOP]
    count: Counter[str] = Counter()
    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            text = html.unescape(text)
            if not text.strip():
                yield m.start(), "", text, False
                continue
            top = stack[-1]
            if seen:
                seen(stack, m.start(), text)
            if top.marked:
                kind = "marked"
            else:
                kind = "link" if top.linked and top.block not in _TEXT else "text" if top.block in _TEXT else "cell" if top.block in ("li", "td", "th") else "div"
                kind += "+" if top.in_article else ""
            yield m.start(), f"w:{kind}", text, False
        elif m["raw"]:
            yield m.start(), f"t:{m['raw'].lower()}", "", False
        elif tag := (m["tag"] or "").lower():
            block = tag in _BLOCK
            if m["close"]:
                marked = False
                if count[tag]:
                    while True:
                        gone = stack.pop()
                        count[gone.tag] -= 1
                        if gone.tag == tag:
                            marked = gone.marked
                            break
            else:
                attrs = m["attrs"] or ""
                if tag in ("article", "main", "body", "footer"):  # these end what was left open before
                    while len(stack) > 1 and stack[-1].tag not in ("html", "body", "main", "article", "div", "section"):
                        count[stack.pop().tag] -= 1
                elif block:
                    while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in _INLINE and count["p"]):
                        count[stack.pop().tag] -= 1
                top = stack[-1]
                inside = top.in_article or tag in ("article", "main")
                own = features(tag, attrs, inside)
                if tag in _OPEN:
                    marked = by_tag = top.tag_marked
                else:
                    by_tag = top.tag_marked or marks(own[0])
                    marked = top.marked or by_tag or any(map(marks, own[1:])) and not (tag == "header" and inside)
                if tag not in _VOID and not (attrs.endswith("/") and tag not in _BLOCK):
                    stack.append(Place(tag, marked, by_tag, inside, top.linked or tag == "a", tag if block else top.block, own if seen else ()))
                    count[tag] += 1
            yield m.start(), "t:marked" if marked else f"t:{tag}", " " if tag == "br" else "", block


class Weights:
    """Weights of features, as smoothed log-odds of lying in the content of labelled pages.

    rare: the share of an element's words in the content below which it holds boilerplate.
    """

    def __init__(self, pages: Sequence[tuple[str, Sequence[tuple[int, int]]]], rare: float = 0.012):
        self.rare = rare
        self.marks_of: dict[str, bool] = {}
        # First which elements hold boilerplate, then, with these known, the weights of words and tags.
        around, of_words = (Counter(), Counter()), (Counter(), Counter())

        def count(counts: tuple[Counter, Counter], spans: Sequence[tuple[int, int]], at: int, names, text: str) -> None:
            k = bisect_right(spans, (at, math.inf)) - 1
            inside = k >= 0 and at < spans[k][1]
            for name in names if inside else {x for name in names for x in (name, _elsewhere(name))}:
                counts[not inside][name] += len(text.split()) or 1

        for page, spans in pages:
            for _ in tokens(page, lambda _: False, lambda stack, at, text, spans=spans: count(around, spans, at, {f for p in stack for n in p.features for f in self._taught(n)}, text)):
                pass
        self.around = {f: (around[0][f] + 0.1) / (around[0][f] + around[1][f] + 0.1) for f in around[0].keys() | around[1].keys()}
        for page, spans in pages:
            for at, feature, text, _ in tokens(page, self.marks):
                if feature:
                    count(of_words, spans, at, [feature], text)
        # Boilerplate weighs little, and nothing where it is marked, so that an insertion doesn't cut an article in two.
        self.of = {f: max(-0.02, odds / 4) if f[0] == "w" else max(-0.5, min(-0.05, odds / 4)) for f, odds in self._odds(of_words).items()}
        self.of |= {"w:marked": 0.0, "t:marked": 0.0}

    @staticmethod
    def _odds(counts: tuple[Counter, Counter]) -> dict[str, float]:
        totals = [sum(c.values()) + 1 for c in counts]
        return {f: math.log((counts[0][f] + 0.5) / totals[0]) - math.log((counts[1][f] + 0.5) / totals[1]) for f in counts[0].keys() | counts[1].keys()}

    @staticmethod
    def _taught(feature: str) -> list[str]:
        """What a labelled page's feature teaches: of a name its parts, or what they say beside an unknown one."""
        kind, parts = _parts(feature)
        return [f"{kind}:{p}" for p in parts] if _UNKNOWN not in parts else [f"with:{kind}:{p}" for p in parts if p != _UNKNOWN]

    def marks(self, feature: str) -> bool:
        """Whether the tag or a part of the name stands almost only around boilerplate."""
        if (known := self.marks_of.get(feature)) is None:
            kind, parts = _parts(feature)
            found = [f"{kind}:{p}" for p in parts if f"{kind}:{p}" in self.around]
            if len(found) < len([p for p in parts if f"{kind}:{p}" in self.around or len(p) > 2 and not p.isdigit()]):
                found = [f"with:{f}" for f in found]
            known = min((self.around.get(f, 1.0) for f in found), default=1.0) < self.rare
            if len(self.marks_of) > 100_000:
                self.marks_of.clear()
            self.marks_of[feature] = known
        return known

    def word(self, feature: str) -> float:
        return self.of.get(feature, -0.02)

    def tag(self, feature: str) -> float:
        return self.of.get(feature, -0.1)


def _elsewhere(feature: str) -> str:
    """The same name within or outside of an article: what is boilerplate there speaks against it here too."""
    if "name+:" in feature:
        return feature.replace("name+:", "name:", 1)
    return feature.replace("name:", "name+:", 1)


def _parts(feature: str) -> tuple[str, list[str]]:
    """Kind and parts of a name; a tag is one."""
    kind, _, name = feature.partition(":")
    return kind, [x for x in re.split(r"[-_]+", name) if x] or [name] if kind != "tag" else [name]


def best_run(values: Sequence[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the greatest sum: the first and shortest, (0, 0) if none is positive."""
    best, total, begin, span = 0.0, 0.0, 0, (0, 0)
    for k, value in enumerate(values):
        total += value
        if total <= 0:
            total, begin = 0.0, k + 1
        elif total > best:
            best, span = total, (begin, k + 1)
    return span


def extract(page: str | None, weights: Weights) -> str:
    """The blocks of the content region, joined by an empty line."""
    found = list(tokens(page or "", weights.marks))
    span = best_run([0.0 if not feature else weights.word(feature) * len(text.split()) if feature[0] == "w" else weights.tag(feature) for _, feature, text, _ in found])
    blocks, now = [], []
    for _, feature, text, is_block in found[slice(*span)]:
        if is_block:
            blocks.append("".join(now))
            now = []
        elif feature != "w:marked":
            now.append(text)
    blocks.append("".join(now))
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


#: In labelled pages: a part that stands for any other word.
_UNKNOWN = "*"
#: What the labelled pages call their elements: names of boilerplate by kind, names of content, and parts that both have.
_NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc toolbar skip navegacion menü",
    "header": "header masthead topbar banner brand kopfzeile",
    "footer": "footer foot copyright contentinfo colophon fusszeile imprint",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular complementary seitenleiste",
    "ad": "ad ads advert taboola outbrain adverts advertisement advertising sponsor sponsored promo promotion adsense dfp werbung anzeige publicite publicidad anuncio",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription paywall hinweis",
    "form": "form search login signup share sharing social suche",
    "comments": "comment comments respond reply replies disqus discussion reader kommentar kommentare commentaire commentaires comentario comentarios",
}
_CONTENT_NAMES = "content post entry article story body text lead intro summary chapter paragraph quote figure caption table note section main page hentry prose inhalt contenu contenido"
#: Names of boilerplate that sections of an article have, and those that stand with other words in names of content.
_ALONE, _BESIDE = "discussion reader brand", "share side related banner comment form social search notice alert popular header brand reader discussion"
_STRUCTURE = "slot box block wrapper wrap container list bar area panel inner outer top bottom left right site unit slot item items link links button group row col column grid primary secondary global 1 2 3"


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Small labelled pages of many layouts: (html, spans of the content)."""
    rng = random.Random(seed)
    words = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name".split()
    content_names, structure = _CONTENT_NAMES.split(), _STRUCTURE.split()

    def say(a: int, b: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(a, b))).capitalize() + "."

    def links(k: int) -> str:
        return f"<ul{named(structure)}>" + "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(k)) + "</ul>"

    def named(names: list[str], always: bool = False) -> str:
        """A class, id or role from the names, alone or with a part of structure."""
        if not always and rng.random() < 0.5:
            return ""
        name = rng.choice(names)
        if always and names is not content_names and name not in _BESIDE.split() and rng.random() < 0.25:
            name = rng.choice((f"{name}-{_UNKNOWN}", f"{_UNKNOWN}-{name}"))
        elif rng.random() < 0.5:
            name = rng.choice((f"{name}-{rng.choice(structure)}", f"{rng.choice(structure)}-{name}", f"{name}_{rng.choice(structure)}"))
        return f' {rng.choice(("class", "id", "class"))}="{name}{rng.choice(("", " " + rng.choice(structure)))}"'

    def attr(kind: str) -> str:
        return named(_NAMES[kind].split(), always=True)

    def inline() -> str:
        tag = rng.choice("b i em strong span u s small sub sup mark time abbr cite q kbd var del ins code label a".split())
        return f"<{tag}{' href=/x' if tag == 'a' else ''}>{say(1, 4)}</{tag}>"

    def own_name() -> str:
        """A name of content, which may hold a word that boilerplate has."""
        if rng.random() < 0.2:
            word = rng.choice(_BESIDE.split())
            return f' class="{rng.choice((f"{word}-{_UNKNOWN}", f"{_UNKNOWN}-{word}", rng.choice(_ALONE.split())))}"'
        return named([*content_names, *structure])

    def content() -> str:
        at = own_name()
        return rng.choice((
            lambda: f"<h{(k := rng.randint(2, 6))}{at}>{say(2, 6)}</h{k}><p>{say(3, 9)} <a href=/y>{say(2, 9)}</a></p>",
            lambda: f"<{(k := rng.choice(('ul', 'ol')))}>" + "".join(f"<li>{say(4, 14)} {inline()}</li>" for _ in range(3)) + f"</{k}>",
            lambda: f"<blockquote{at}><p>{say(6, 30)}</p></blockquote><pre>{say(5, 20)}</pre>",
            lambda: f"<table{at}><caption>{say(2, 4)}</caption><thead><tr><th>{say(1, 2)}</th></tr></thead><tbody><tr><td>{say(2, 6)} {inline()}</td></tr></tbody></table>",
            lambda: f"<div{at}>{say(8, 30)} {inline()}</div><section{at}>{say(3, 9)} <a href=/u>{say(1, 3)}</a></section>",
            lambda: f"<dl><dt>{say(1, 3)}</dt><dd>{say(4, 12)}</dd></dl><figure{at}><img src=x><object>{say(1, 3)}</object><audio>{say(1, 3)}</audio><video>{say(1, 3)}</video><canvas>{say(1, 2)}</canvas><figcaption>{say(4, 10)}</figcaption></figure>",
            lambda: f"<details><summary>{say(2, 5)}</summary><p>{say(8, 20)} <math><mi>{say(1, 1)}</mi></math></p></details><address>{say(3, 6)}</address><center>{say(3, 9)}</center>",
        ))()

    out = []
    for _ in range(n):
        parts: list[tuple[str, bool]] = [(f"<html><head><title>{say(3, 8)}</title><style>p{{}}</style></head><body{named([*structure, *content_names])}>", False)]
        before = [
            f"<header{named(structure)}><h1>{say(1, 3)}</h1>{links(3)}</header>", f"<nav>{links(rng.randint(3, 8))}</nav>", f"<div{attr('menu')}>{links(5)}</div>", f"<ul{attr('menu')}><li><a href=/>{say(1, 2)}</a></li></ul>",
            f"<div{attr('ad')}>{say(4, 15)}</div>", f"<div{attr('notice')}><p>{say(6, 25)}</p><button>{say(1, 2)}</button></div>", f"<dialog open><p>{say(5, 15)}</p></dialog><menu><li>{say(1, 2)}</li></menu>",
            f"<form><label>{say(1, 3)}</label><input name=q><select><option>{say(1, 2)}</option><option>{say(1, 2)}</option></select><fieldset><legend>{say(1, 2)}</legend></fieldset><button>{say(1, 1)}</button></form>", f"<div>{links(6)}</div>", f"<div{attr('header')}>{say(2, 6)}</div>",
        ]
        after = [
            f"<aside><h3>{say(1, 3)}</h3>{links(5)}<p>{say(5, 20)}</p></aside>", f"<div{attr('side')}><h4>{say(1, 2)}</h4><p>{say(5, 30)}</p>{links(4)}</div>",
            *[f"<{tag}{attr('comments')}><h3>{say(1, 2)}</h3>" + "".join(f"<p>{say(5, 25)}</p>" for _ in range(rng.randint(1, 6))) + f"</{tag}>" for tag in ("section", "div", "ol")],
            f"<footer>&copy; {say(3, 12)}</footer>", f"<div{attr('footer')}><p>{say(3, 12)}</p></div>", f"<form><p>{say(3, 9)}</p><button>{say(1, 1)}</button></form>", f"<div{attr('form')}>{say(1, 8)}</div>",
        ]
        parts += [(x, False) for x in rng.sample(before, rng.randint(1, 5))]
        open_, close = rng.choice((("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), (f"<div{named(content_names, True)}>", "</div>"), (f"<section{named(content_names, True)}>", "</section>"), ("<div><div>", "</div></div>"), (f"<article{named(content_names)}>", "</article>")))
        title = f"<h1>{say(3, 9)}</h1>"
        parts.append((f"{open_}{f'<header>{title}</header>' if 'article' in open_ and rng.random() < 0.4 else title}", True))
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.6:
                parts.append((f"<p{own_name()}>{say(8, 70)} {inline()}</p>", True))
            elif kind < 0.85:
                parts.append((content(), True))
            else:
                inserted = rng.choice(("ad", "notice", "form", "side", "menu", "comments"))
                parts.append((rng.choice((f"<div{attr(inserted)}>{say(3, 14)}</div>", f"<p{attr(inserted)}>{say(3, 14)}</p>", f"<aside><p>{say(3, 14)}</p></aside>", f"<nav>{links(2)}</nav>", f"<form><p>{say(2, 5)}</p><select><option>{say(1, 2)}</option></select><button>{say(1, 1)}</button></form>", f"<footer>{say(2, 8)}</footer>")), False))
        parts.append((close, True))
        parts += [(x, False) for x in rng.sample(after, rng.randint(1, 5))]
        parts.append(("</body></html>", False))
        page, spans = "", []
        for text, is_content in parts:
            if is_content:
                spans.append((len(page), len(page) + len(text)))
            page += text
        out.append((page, spans))
    return out


def extract_pages(spark: SparkSession, pages: DataFrame, labelled: Sequence[tuple[str, Sequence[tuple[int, int]]]] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    held = spark.sparkContext.broadcast(Weights(labelled_pages() if labelled is None else labelled))
    ddl = "page_id bigint, url string, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, schema = held.value, arrow_schema(ddl)
        for batch in sliced(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
            yield from in_batches(((i, url, text := extract(page, weights), len(text)) for i, url, page in rows), schema, 500)

    return pages.select("page_id", "url", "html").mapInArrow(run, ddl)
