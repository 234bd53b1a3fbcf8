"""Main text of HTML pages by a tree-structured graphical model.

Each element of the DOM that isn't mere inline markup is a binary variable (content or not) with a
log-linear potential on its features; every parent-child edge has a potential of its own. Sum-product
messages, upward and then downward, give exact marginals. The weights are trained on labelled pages by
the gradient of the likelihood, which needs the same marginals.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's void elements, elements whose text isn't shown, inline elements, end tags implied by a start tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head title script style template noscript svg math object iframe audio video canvas".split())
RAW = set("script style textarea title".split())
_RAW_ENDS = {name: re.compile(f"</{name}\\s*>", re.I) for name in RAW}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class and id attributes by what they tell.
HINTS = {
    "advert": "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner dfp outbrain taboola",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar",
    "comments": "comment comments commentlist disqus reply replies respond discussion",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription paywall warning",
    "side": "sidebar side aside related recommended widget trending popular teaser rail more",
    "head": "header masthead logo topbar branding",
    "foot": "footer foot copyright legal colophon imprint",
    "share": "share sharing social tags tag meta byline author follow",
    "form": "form search login signup register contact",
    "content": "article content main post entry story body text page-content hentry prose markdown",
}
_HINT_OF = {w: k for k, words in enumerate(HINTS.values()) for w in words.split()}
TAGS = "root html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th blockquote pre figure figcaption nav header footer aside form fieldset button select option textarea address menu dialog details summary center".split()
_TAG_OF = {t: k for k, t in enumerate(TAGS)}
_HINTS_FROM = len(TAGS) + 1
_LENGTHS_FROM = _HINTS_FROM + len(HINTS)
_LINKS_FROM = _LENGTHS_FROM + 5
_SENTENCE = _LINKS_FROM + 4
_RIGHTS = _SENTENCE + 1
N_FEATURES = _RIGHTS + 2
EDGE_KINDS = 3  # to a text block, to a list or table part, to any other element
_TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
_PARTS = set("ul ol li dl dt dd table tbody thead tr td th option".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_UNQUOTED = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RIGHTS_TEXT = re.compile(r"©|\(c\)|all rights reserved|copyright", re.I)


_P_ENDS = ({"p"}, {"button", "td", "th", "table"})


def _marks(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, stop, name, is an end tag, attributes): text from ``start`` to ``stop`` and the tag after it.

    The name is empty after a comment or declaration and at the end. Text of RAW elements runs to their end tag. A
    quotation mark that is never closed, and a tag that never ends outside of its quotations, end at the
    next >; a < without any > after it is text.
    """
    text_from = at = 0
    size = len(source)
    closed = {'"': True, "'": True}  # there may be another one further on
    quotes = True  # tags have been found to end outside of their quotations
    while (at := source.find("<", at)) >= 0:
        after = source[at + 1 : at + 2]
        if after in ("!", "?"):
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                stop = size if end < 0 else end + 3
            else:
                end = source.find(">", at)
                stop = size if end < 0 else end + 1
            yield text_from, at, "", False, ""
            text_from = at = stop
            continue
        ends_tag = after == "/"
        m = _NAME.match(source, at + 1 + ends_tag)
        if not m:
            at += 1
            continue
        end = m.end()
        while quotes:
            end = _UNQUOTED.match(source, end).end()
            mark = source[end : end + 1]
            if mark == ">":
                break
            if mark and closed[mark]:
                other = source.find(mark, end + 1)
                if other >= 0:
                    end = other + 1
                    continue
                closed[mark] = False
            if mark:
                end += 1  # never closed: a character like others
                continue
            quotes = False  # no > up to the end of the page: from here on quotations hide none
            end = m.end()
        if not quotes and (end := source.find(">", m.end())) < 0:
            break
        name, attributes = m[0].lower(), source[m.end() : end]
        yield text_from, at, name, ends_tag, attributes
        text_from = at = end + 1
        if name in RAW and not ends_tag:
            close = _RAW_ENDS[name].search(source, at)
            at = close.start() if close else size
    yield text_from, size, "", False, ""


class Page:
    """The variables of a page and its pieces of text in order. Node 0 is the root; parents come before children."""

    __slots__ = ("tag", "parent", "hints", "own", "link", "sentence", "rights", "pieces")

    def __init__(self, source: str):
        self.tag, self.parent, self.hints = ["root"], [-1], [()]
        self.own, self.link, self.sentence, self.rights = [0], [0], [False], [False]
        self.pieces: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a block ends
        self._parse(source)

    def _text(self, stack: list[tuple[str, int]], raw: str, hidden: int, links: int) -> None:
        if hidden or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        node = stack[-1][1]
        self.pieces.append((node, text))
        n = len(text.strip())
        if n:
            self.own[node] += n
            if links:
                self.link[node] += n
            elif not self.sentence[node] and n > 1 and ("." in text or "?" in text or "!" in text or "," in text):
                self.sentence[node] = True
            if "©" in text or n < 300 and _RIGHTS_TEXT.search(text):
                self.rights[node] = True

    def _parse(self, source: str) -> None:
        """One pass: no character is looked at more than a fixed number of times, however broken the page."""
        stack: list[tuple[str, int]] = [("", 0)]  # (tag, node); inline elements share their parent's node
        open_: dict[str, list[int]] = {}  # places of each tag in the stack
        hidden = links = 0

        def top(tags) -> int:
            return max((places[-1] for t in tags if (places := open_.get(t))), default=0)

        def close(to: int) -> None:
            nonlocal hidden, links
            for tag, _ in stack[to:]:
                open_[tag].pop()
                hidden -= tag in HIDDEN
                links -= tag == "a"
            del stack[to:]

        for start, stop, name, ends_tag, attributes in _marks(source):
            self._text(stack, source[start:stop], hidden, links)
            if not name:
                continue
            if ends_tag:
                if places := open_.get(name):
                    self.pieces += [(node, None) for tag, node in stack[places[-1] :] if tag not in INLINE]
                    close(places[-1])
                continue
            if name == "br" or name == "hr":
                self.pieces.append((stack[-1][1], None))
            if name in VOID:
                continue
            ends = _P_ENDS if name in CLOSES_P else IMPLIED.get(name)
            if ends and (found := top(ends[0])) > top(ends[1]):
                close(found)
            hints = self._hints(attributes) if "=" in attributes else ()
            node = stack[-1][1]
            if name not in INLINE or any(h != len(HINTS) - 1 for h in hints):
                node = len(self.tag)
                self.tag.append(name)
                self.parent.append(stack[-1][1])
                self.hints.append(hints)
                self.own.append(0)
                self.link.append(0)
                self.sentence.append(False)
                self.rights.append(False)
            if name not in INLINE:
                self.pieces.append((node, None))
            open_.setdefault(name, []).append(len(stack))
            stack.append((name, node))
            hidden += name in HIDDEN
            links += name == "a"

    @staticmethod
    def _hints(attributes: str) -> tuple[int, ...]:
        found = set()
        for m in _ATTRIBUTE.finditer(attributes):
            for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()):
                if w in _HINT_OF:
                    found.add(_HINT_OF[w])
        return tuple(sorted(found))

    def features(self) -> list[list[int]]:
        """Active features of each node; lengths and links count the node's own text and that of its inline markup."""
        n = len(self.tag)
        every, linked = self.own[:], self.link[:]
        for k in range(n - 1, 0, -1):
            every[self.parent[k]] += every[k]
            linked[self.parent[k]] += linked[k]
        rows = []
        for k in range(n):
            own = self.own[k]
            row = [_TAG_OF.get(self.tag[k], len(TAGS)), N_FEATURES - 1]
            row += [_HINTS_FROM + h for h in self.hints[k]]
            row.append(_LENGTHS_FROM + (own > 0) + (own > 25) + (own > 80) + (own > 200))
            if every[k]:
                share = linked[k] / every[k]
                row.append(_LINKS_FROM + (share > 0.1) + (share > 0.4) + (share > 0.7))
            if self.sentence[k]:
                row.append(_SENTENCE)
            if self.rights[k]:
                row.append(_RIGHTS)
            rows.append(row)
        return rows

    def edge_kind(self, k: int) -> int:
        return 0 if self.tag[k] in _TEXT_BLOCKS else 1 if self.tag[k] in _PARTS else 2


class TreeModel:
    """``weights``: log-potential of content per feature. ``edges``: log-potentials, (kind, parent's label, child's label)."""

    def __init__(self):
        self.weights = np.zeros(N_FEATURES)
        self.edges = np.zeros((EDGE_KINDS, 2, 2))
        self._lists()

    def _lists(self) -> None:
        self._w, self._e = self.weights.tolist(), self.edges.tolist()

    def marginals(self, page: Page, rows: list[list[int]], pairs: bool = False):
        """P(content) of each node; with ``pairs`` also (kind, P of the four label pairs) of each edge."""
        w, n, parent = self._w, len(rows), page.parent
        # messages and beliefs are log-odds-like pairs (log value for 0, log value for 1), kept with a common shift
        up0, up1 = [0.0] * n, [sum([w[f] for f in row]) for row in rows]
        kinds = [page.edge_kind(k) for k in range(n)]
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * n
        log, exp = math.log, math.exp

        def add(a: float, b: float) -> float:
            return a + log(1 + exp(b - a)) if a > b else b + log(1 + exp(a - b))

        for k in range(n - 1, 0, -1):
            (e00, e01), (e10, e11) = self._e[kinds[k]]
            m0, m1 = add(e00 + up0[k], e01 + up1[k]), add(e10 + up0[k], e11 + up1[k])
            sent[k] = (m0, m1)
            up0[parent[k]] += m0
            up1[parent[k]] += m1
        down0, down1 = [0.0] * n, [0.0] * n
        joint = []
        for k in range(1, n):
            p, (m0, m1) = parent[k], sent[k]
            # all that the parent knows without this child
            a0, a1 = up0[p] + down0[p] - m0, up1[p] + down1[p] - m1
            (e00, e01), (e10, e11) = self._e[kinds[k]]
            down0[k], down1[k] = add(e00 + a0, e10 + a1), add(e01 + a0, e11 + a1)
            if pairs:
                four = [a0 + e00 + up0[k], a0 + e01 + up1[k], a1 + e10 + up0[k], a1 + e11 + up1[k]]
                most = max(four)
                value = [exp(x - most) for x in four]
                joint.append((kinds[k], [x / sum(value) for x in value]))
        out = [1 / (1 + exp(max(min(up0[k] + down0[k] - up1[k] - down1[k], 700.0), -700.0))) for k in range(n)]
        return (out, joint) if pairs else out

    def train(self, pages: list[tuple[Page, list[int]]], epochs: int = 25, rate: float = 0.3, decay: float = 0.002) -> None:
        """Adagrad on the exact gradient of the pages' log-likelihood, one page at a time in a fixed order."""
        speed_w, speed_e = np.full(N_FEATURES, 0.1), np.full((EDGE_KINDS, 2, 2), 0.1)
        made = [(page, page.features(), labels) for page, labels in pages]
        for _ in range(epochs):
            for page, rows, labels in made:
                self._lists()
                found, joint = self.marginals(page, rows, pairs=True)
                gw, ge = -decay * self.weights, -decay * self.edges
                for row, y, p in zip(rows, labels, found):
                    for f in row:
                        gw[f] += y - p
                for k, (kind, four) in enumerate(joint, 1):
                    ge[kind, labels[page.parent[k]], labels[k]] += 1
                    ge[kind] -= np.reshape(four, (2, 2))
                speed_w += gw**2
                speed_e += ge**2
                self.weights += rate * gw / np.sqrt(speed_w)
                self.edges += rate * ge / np.sqrt(speed_e)
        self._lists()


def main_text(source: str | None, model: TreeModel) -> str:
    """Blocks of the nodes whose marginal is over one half, in page order."""
    if not source:
        return ""
    page = Page(source)
    keep = [p > 0.5 for p in model.marginals(page, page.features())]
    blocks, block = [], []
    for node, text in page.pieces:
        if text is not None:
            if keep[node]:
                block.append(text)
        elif block:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return " ".join(" ".join(blocks).split())


#: Labelled pages: content stands between [[ and ]], everything else is not. Lines of a group are alternatives; a page
#: takes one of each. {t} is a heading, {s} a sentence, {p} some sentences, {w} a word.
_SKELETONS = (
    "<!DOCTYPE html><html><head><title>{t}</title><script>var a='<p>';</script></head><body>%TOP%%NOTICE%%AD%<article>[[<h1>{t}</h1><p><b>{t}<br><p>{p}</p>%INSIDE%<p>{p}</p>]]</article>%COMMENTS%%SIDE%%FOOT%</body></html>",
    "<html><body><div class='wrapper'>%TOP%%AD%<main>[[<h1>{t}</h1><p>{p}</p><p>{s}</p>%INSIDE%<p>{p}</p>]]</main>%SIDE%%NOTICE%</div>%FOOT%</body></html>",
    "<html><body>%TOP%<div id='page'><div class='post-content'>[[<h2>{t}</h2><p>{p}</p>%INSIDE%<ul><li>{s}</li><li>{s}</li></ul><p>{p}</p>]]</div>%COMMENTS%%SIDE%</div>%AD%%FOOT%</body></html>",
    "<body>%NOTICE%%TOP%<section>[[<h1>{t}</h1><p>{s}</p><blockquote><p>{s}</p></blockquote><p>{p}</p>]]</section>%AD%%FORM%%FOOT%</body>",
    "<html><body>[[<h1>{t}</h1><p>{p}</p><p>{p}</p>]]%FOOT%</body></html>",
    "<html><body>%TOP%<div>[[<div>{p}</div><div>{p}</div>]]</div>%FORM%%FOOT%</body></html>",
    "<html><body>%TOP%<article class='story'>[[<h1>{t}</h1>]]%SHARE%[[<p>{p}</p><table><tr><td>{w}</td><td>{s}</td></tr></table>]]%INAD%[[<p>{p}</p>]]</article>%COMMENTS%%FOOT%</body></html>",
    "[[{p}]]",
    "[[<p>{p}</p><p>{s}</p>]]",
)
_PARTS_OF_PAGES = {
    "TOP": ("<nav><ul><li><a href='/'>{w}</a></li><li><a href='/a'>{w}</a></li><li><a href='/b'>{w}</a></li></ul></nav>", "<header class='masthead'><div class='logo'><a href='/'>{w}</a></div><p>{s}</p></header>", "<div class='menu'><a href='/'>{w}</a> <a href='/x'>{w}</a></div><div id='header'>{t}</div>", "<header><h2>{t}</h2><nav><a href='/'>{w}</a><a href='/y'>{w}</a></nav></header>", ""),
    "AD": ("<!-- ad --><div class=\"ad\">{s}</div>", "<div class='advertisement'><p>{p}</p></div>", "<aside class='sponsored'>{s}</aside>", "<div class=\"ad\">{p}</div>", ""),
    "NOTICE": ("<div class='cookie-notice'>{s} <button>{w}</button></div>", "<div id='consent'><p>{p}</p><button>{w}</button></div>", "<div class='newsletter'><p>{s}</p><form><input name='e'><button>{w}</button></form></div>", ""),
    "INSIDE": ("<h2>{t}</h2>", "<pre>{s}</pre>", "<ol><li>{s}</li><li>{p}</li></ol>", "<p>{s} <a href='/r'>{w}</a> {s}</p>", "<figure><img src='i'><figcaption>{s}</figcaption></figure>", "<p>{w}.</p>", "<dl><dt>{w}</dt><dd>{s}</dd></dl>", ""),
    "INAD": ("<div class='ad'>{s}</div>", "<aside class='related'><h3>{t}</h3><ul><li><a href='/q'>{t}</a></li></ul></aside>", ""),
    "SHARE": ("<div class='share'><a href='/f'>{w}</a><a href='/g'>{w}</a></div>", "<ul class='social'><li><a href='/f'>{w}</a></li></ul>", ""),
    "COMMENTS": ("<section id='comments'><h2>{t}</h2><div class='comment'><p>{p}</p></div><div class='comment'><p>{s}</p></div></section>", "<div class='comments'><ol class='commentlist'><li><p>{p}</p></li><li><p>{s}</p></li></ol><form><textarea>{s}</textarea><button>{w}</button></form></div>", ""),
    "SIDE": ("<aside><h3>{t}</h3><ul><li><a href='/1'>{t}</a></li><li><a href='/2'>{t}</a></li></ul></aside>", "<div class='sidebar'><div class='widget'><h3>{t}</h3><p>{p}</p></div></div>", "<aside class='related'><p>{s}</p><a href='/3'>{t}</a></aside>", ""),
    "FORM": ("<form action='/s'><label>{w}</label><input name='q'><select><option>{w}</option><option>{w}</option></select><button>{w}</button></form>", "<div class='login-form'><form><p>{s}</p><input name='u'></form></div>", ""),
    "FOOT": ("<footer>&copy; {w}.example.net &middot; {s}</footer>", "<div class='footer'><p>{s}</p><ul><li><a href='/i'>{w}</a></li></ul></div>", "<div id='footer'>Copyright {w}. {p}</div>", "<footer><p>{p}</p><nav><a href='/t'>{w}</a></nav></footer>", ""),
}


def labelled_pages(n: int = 240, seed: int = 3) -> list[tuple[str, list[tuple[int, int]]]]:
    """Pages made from the skeletons with their content's (start, end) places; words are random letters."""
    r = np.random.default_rng(seed)

    def words(k: int) -> str:
        return " ".join("".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(k))

    def fill(m: re.Match) -> str:
        sentence = lambda: words(r.integers(2, 18)).capitalize() + "."
        return {"w": lambda: words(1), "t": lambda: words(r.integers(2, 8)).capitalize(), "s": sentence, "p": lambda: " ".join(sentence() for _ in range(r.integers(1, 9)))}[m[1]]()

    made = []
    for k in range(n):
        page = _SKELETONS[k % len(_SKELETONS)]
        page = re.sub(r"%(\w+)%", lambda m: str(r.choice(_PARTS_OF_PAGES[m[1]])), page)
        page = re.sub(r"\{(\w)\}", fill, page)
        spans, out = [], ""
        for x in re.split(r"(\[\[|\]\])", page):
            if x == "[[":
                spans.append((len(out), 0))
            elif x == "]]":
                spans[-1] = (spans[-1][0], len(out))
            else:
                out += x
        made.append((out, spans))
    return made


_MARKER = "\ue000"  # a private-use character; put before letters of content, it survives the parser


def node_labels(source: str, spans: list[tuple[int, int]]) -> tuple[Page, list[int]]:
    """The page's nodes with 1 for those whose text is content for the most part.

    An element's text is its own and that of the text blocks, lists and tables in it; what other elements
    inside it hold is theirs. An element without text is 0.
    """
    marked = source
    for start, end in reversed(spans):
        inner = re.sub(r"(>|^)([^<]+)", lambda m: m[1] + re.sub(r"(?=\w)", _MARKER, m[2]), marked[start:end])
        marked = marked[:start] + inner + marked[end:]
    page, shadow = Page(source), Page(marked)
    balance = [0] * len(page.tag)
    for node, text in shadow.pieces:
        if text and text.strip():
            n = len(text.replace(_MARKER, ""))
            balance[node] += n if _MARKER in text else -n
    for k in range(len(page.tag) - 1, 0, -1):
        if page.edge_kind(k) != 2:
            balance[page.parent[k]] += balance[k]
    return page, [int(x > 0) for x in balance]


def fit_tree_model(pages: list[tuple[str, list[tuple[int, int]]]] | None = None) -> TreeModel:
    """Trains on labelled pages: (html, [(start, end) of content, ...])."""
    model = TreeModel()
    model.train([node_labels(*p) for p in (pages if pages is not None else labelled_pages())])
    return model


def extract(df: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row; the text is empty where the page has none or its html is null.

    Ids and URLs pass through (nulls too), repeated rows stay, an empty table gives an empty result,
    further columns are not read. Pages are parsed whole, one at a time.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.iloc[k : k + 1024]
                texts = [main_text(x if isinstance(x, str) else None, m) for x in part["_html"]]
                yield pd.DataFrame({id_col: part["_id"].array, url_col: part["_url"].array, "text": texts, "n_chars": [len(t) for t in texts]})

    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    schema = f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long"
    return df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).mapInPandas(run, schema)
