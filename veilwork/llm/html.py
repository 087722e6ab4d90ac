"""Main-text extraction with a tree-structured graphical model over DOM nodes.

Every element of a page is a binary variable (content or not). Its own potential comes from its tag, the cues in its class and
id, and the text below it; a potential on each parent-child edge depends on the kind of the child
(normalised over the child's state, so that a child without evidence sends none). Sum-product messages pass
from the leaves to the root and back, level by level over all pages of a batch at once, and give each element's
exact marginal. Weights are trained by the exact gradient of the conditional likelihood on labelled pages, which
``labelled_pages`` writes from a seed in many layouts (the corpus has no labelled pages); training takes a
few seconds on the driver.

Text is kept where the marginal of its nearest element exceeds one half. Scripts, styles, comments and head matter
are never text. White space inside a block becomes one space; blocks are joined in page order by one space.

Edge cases: null or blank html gives empty text; markup that breaks off inside a tag loses that tag only, and a ``<`` that begins
none is text; unclosed and stray tags are repaired as they come (an open ``noscript``, ``template``, ``object``, ``svg`` or ``math``
ends with its parent; an open script or frame goes on to the end, as in a browser); repeated rows are extracted each; a page of any length or depth is handled whole; extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.runtime import table, workers_import

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""", re.DOTALL)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([a-zA-Z_:@-][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_BEGINS = re.compile(r"<[a-zA-Z!?/]")
# Fixed values of the HTML standard: elements without content, of raw text, that end an open p, and that are blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
ENDS_P = BLOCK - frozenset("br body html td th tr tbody thead tfoot li dd dt legend figcaption summary".split())
#: An opening tag closes an open element of these names, up to the scope's own element.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
NEVER = frozenset("head script style title noscript iframe template svg math select button textarea object xmp noembed noframes".split())

_OUTSIDE_BODY = frozenset("html head body frameset title meta link base script style noscript template".split())

TAGS = "html body div section main article header footer nav aside form label button select ul ol li dl dt dd table tbody tr td th p h1 h2 h3 h4 h5 h6 blockquote pre code figure figcaption a span b i em strong small u time address details summary".split()
CUES = {
    "menu": r"nav|menu|crumb|toc\b|tabs?\b|pagin",
    "head": r"head|masthead|banner|logo|brand|topbar",
    "foot": r"foot|copyright|legal|colophon",
    "side": r"side|aside|rail|related|recommend|widget|popular|trending|more-",
    "advert": r"\bads?\b|\bad[-_]|advert|sponsor|promo|commercial",
    "notice": r"cookie|consent|notice|alert|gdpr|popup|modal|overlay|newsletter|subscri|signup|banner",
    "comment": r"comment|disqus|repl(?:y|ies)|discussion|respond|feedback",
    "share": r"share|social|tags?\b|meta|byline|author",
    "form": r"form|search|login|contact",
    "content": r"content|article|post|entry|story|text|body|main|prose",
    "hidden": r"hidden|sr-only|visually|d-none",
}
_CUES = [re.compile(p) for p in CUES.values()]
NUMERIC = ("own_text", "text", "link_share", "words_sentence", "p_share", "no_text", "bias")
#: Characters from which a text counts as long.
LONG = 400
N_FEATURES = len(TAGS) + 1 + len(CUES) + len(NUMERIC)
#: Kinds of child on an edge, each with its own two-by-two potential.
KINDS = {"inline": 0, "block": 1, "landmark": 2, "cued": 3}
_LANDMARK = frozenset("nav header footer aside form main article section".split())
_TAG_AT = {t: i for i, t in enumerate(TAGS)}


@dataclass
class Dom:
    """Elements in page order, and text pieces (element, block number, text)."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    cues: list[str] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)


def parse(page: str) -> Dom:
    """A forgiving tree: what HTML lets stay open is closed where the next element needs it."""
    dom = Dom()
    stack: list[int] = []
    block = 0

    def opened(name: str, attrs: str) -> None:
        if not stack and name != "html":  # what a page leaves out is there all the same
            opened("html", "")
        if len(stack) == 1 and dom.tag[stack[0]] == "html" and name not in _OUTSIDE_BODY:
            opened("body", "")
        dom.tag.append(name)
        dom.parent.append(stack[-1] if stack else -1)
        dom.attrs.append(attrs)
        low = attrs.lower() if attrs and not attrs.isspace() else ""
        cue = " ".join(v.strip("\"'") for k, v in _ATTR.findall(low) if k in ("class", "id", "role", "itemprop", "data-component")) if "=" in low else ""
        if low and re.search(r"(?<![-\w])hidden(?![-\w])|display:\s*none|aria-hidden\s*=\s*[\"']?true", low):
            cue += " hidden"
        dom.cues.append(cue)
        stack.append(len(dom.tag) - 1)

    def text(piece: str) -> None:
        if piece:
            if not stack:
                opened("body", "")
            dom.texts.append((stack[-1], block, entities.unescape(piece)))

    cut = _BEGINS.search(page, page.rfind(">") + 1)
    if cut and "<!--" not in page[cut.start() :]:
        page = page[: cut.start()]
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _TOKEN.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if m.lastindex is None or m[2] is None:
            continue
        name = m[2].lower()
        if name in BLOCK:
            block += 1
        if m[1]:
            names = [dom.tag[i] for i in stack]
            if name in names:
                k = len(names) - 1 - names[::-1].index(name)
                del stack[k:]
            continue
        if name == "html" and dom.tag[:1] == ["html"]:
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                t = dom.tag[stack[k]]
                if t == "p":
                    del stack[k:]
                    break
                if t in BLOCK:
                    break
        if name in CLOSES:
            shut, scope = CLOSES[name]
            for k in range(len(stack) - 1, -1, -1):
                t = dom.tag[stack[k]]
                if t in scope:
                    break
                if t in shut:
                    del stack[k:]
                    break
        if name == "body" or name in _LANDMARK:  # a head left open ends here
            for k, i in enumerate(stack):
                if dom.tag[i] == "head":
                    del stack[k:]
                    break
        opened(name, m[3])
        if name in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            stack.pop()
        elif name in VOID or m[3].endswith("/") and name not in BLOCK:
            stack.pop()
    return dom


@dataclass
class Forest:
    """Elements of several pages: parents before children, features, edge kinds, depth levels."""

    doms: list[Dom]
    x: np.ndarray
    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    start: list[int]


def forest(doms: list[Dom]) -> Forest:
    start, n = [], 0
    for d in doms:
        start.append(n)
        n += len(d.tag)
    parent, kind, x = np.full(n, -1), np.zeros(n, np.int64), np.zeros((n, N_FEATURES))
    own, link, words, stops, in_p = (np.zeros(n) for _ in range(5))
    depth, never = np.zeros(n, np.int64), np.zeros(n, bool)  # what is never text says nothing of its parent
    for d, s in zip(doms, start, strict=True):
        in_a = [False] * len(d.tag)
        p_of = [False] * len(d.tag)
        for i, t in enumerate(d.tag):
            p, g = d.parent[i], s + i
            if p >= 0:
                parent[g], depth[g] = s + p, depth[s + p] + 1
            never[g] = t in NEVER or p >= 0 and never[s + p]
            in_a[i] = t == "a" or p >= 0 and in_a[p]
            p_of[i] = t == "p" or p >= 0 and p_of[p]
            x[g, _TAG_AT.get(t, len(TAGS))] = 1
            cued = False
            if d.cues[i]:
                for j, cue in enumerate(_CUES):
                    if cue.search(d.cues[i]):
                        x[g, len(TAGS) + 1 + j] = 1
                        cued = True
            kind[g] = KINDS["cued"] if cued else KINDS["landmark"] if t in _LANDMARK else KINDS["block"] if t in BLOCK else KINDS["inline"]
        for i, _, text in d.texts:
            if never[s + i]:
                continue
            k = len(text)
            own[s + i] += k
            words[s + i] += text.count(" ") + 1 if not text.isspace() else 0
            stops[s + i] += text.count(".") + text.count("!") + text.count("?") + text.count("。")
            link[s + i] += k if in_a[i] else 0
            in_p[s + i] += k if p_of[i] else 0
    levels = [np.flatnonzero(depth == k) for k in range(int(depth.max()) + 1)] if n else []
    below = [v.copy() for v in (own, link, words, stops, in_p)]
    for level in levels[:0:-1]:
        for v in below:
            np.add.at(v, parent[level], v[level])
    text, a, w, e, p = below
    at = len(TAGS) + 1 + len(CUES)
    x[:, at] = np.log1p(np.minimum(own, LONG)) / 6  # longer is no surer
    x[:, at + 1] = np.log1p(np.minimum(text, LONG)) / 6
    x[:, at + 2] = a / np.maximum(text, 1)
    x[:, at + 3] = np.minimum(w / np.maximum(e, 1), 40) / 40
    x[:, at + 4] = p / np.maximum(text, 1)
    x[:, at + 5] = text < 1
    x[:, at + 6] = 1
    # siblings of one tag and class share their evidence, or many short paragraphs would outvote the element around them
    names: dict[tuple[str, str], int] = {}
    name = np.array([names.setdefault((t, c), len(names)) for d in doms for t, c in zip(d.tag, d.cues, strict=True)], np.int64)
    group = (parent + 1) * (len(names) + 1) + name
    _, inverse, count = np.unique(group, return_inverse=True, return_counts=True)
    x /= count[inverse][:, None]
    x[never] = 0
    return Forest(doms, x, parent, kind, levels, start)


def marginals(f: Forest, w: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact P(content) of each element, and P(parent, child) of each edge, by sum-product in logarithms."""
    n = len(f.parent)
    own = np.zeros((n, 2))
    own[:, 1] = f.x @ w
    belief, up = own.copy(), np.zeros((n, 2))
    pot = edge[f.kind]  # element, parent's state, own state
    for level in f.levels[:0:-1]:
        up[level] = np.logaddexp(pot[level, :, 0] + belief[level, None, 0], pot[level, :, 1] + belief[level, None, 1])
        np.add.at(belief, f.parent[level], up[level])
    pair = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        p = f.parent[level]
        rest = belief[p] - up[level]  # what the parent knows without this child
        joint = rest[:, :, None] + pot[level] + belief[level][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pair[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        belief[level] += np.logaddexp(rest[:, 0, None] + pot[level, 0], rest[:, 1, None] + pot[level, 1])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), pair


@dataclass
class Model:
    w: np.ndarray
    edge: np.ndarray


def train(pages: list[str], steps: int = 120, rate: float = 0.15, decay: float = 2e-3) -> Model:
    """Maximum conditional likelihood; an element is content as its ``data-y`` says, or else as its parent is."""
    f = forest([parse(p) for p in pages])
    y = np.zeros(len(f.parent), np.int64)
    for d, s in zip(f.doms, f.start, strict=True):
        for i, a in enumerate(d.attrs):
            m = re.search(r'data-y="?([01])', a)
            y[s + i] = int(m[1]) if m else y[s + d.parent[i]] if d.parent[i] >= 0 else 0
    w, edge = np.zeros(N_FEATURES), np.zeros((len(KINDS), 2, 2))
    inner = np.concatenate(f.levels[1:])
    normal = lambda e: e - np.logaddexp(e[..., :1], e[..., 1:])  # noqa: E731  a child without evidence sends none
    seen = np.zeros((len(KINDS), 2, 2))
    np.add.at(seen, (f.kind[inner], y[f.parent[inner]], y[inner]), 1)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(edge), np.zeros_like(edge)]
    for t in range(1, steps + 1):
        p, pair = marginals(f, w, normal(edge))
        expected = np.zeros_like(seen)
        np.add.at(expected, f.kind[inner], pair[inner])
        lack = seen - expected
        lack = lack - np.exp(normal(edge)) * lack.sum(axis=2, keepdims=True)
        grads = (f.x.T @ (y - p) / len(pages) - decay * w, lack / len(pages) - decay * edge)
        for k, (param, g) in enumerate(((w, grads[0]), (edge, grads[1]))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(w, normal(edge))


def labelled_pages(n: int = 120, seed: int = 7) -> list[str]:
    """Pages in many layouts whose ``data-y`` attributes say which elements are content."""
    rng = np.random.default_rng(seed)
    parts = "ka lo mi tu ren sa vel dor an is ul be cho ti ver no ga lin po ma".split()
    chance = lambda p: rng.random() < p
    pick = lambda *a: a[rng.integers(len(a))]

    def words(k: int) -> str:
        out = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(k)]
        return " ".join(out).capitalize()

    def sentences(k: int, end: str = ".") -> str:
        return " ".join(words(int(rng.integers(1, 18))) + (end if chance(0.9) else pick("", "!!", " |")) for _ in range(k))

    def paragraph() -> str:
        s = sentences(int(rng.integers(1, 9)))
        if chance(0.3):
            s += f' <a href="/x">{words(2)}</a> {sentences(1)}'
        if chance(0.2):
            s = f"<b>{s}<br>" if chance(0.5) else f"<em>{words(3)}</em> {s}"
        return f"<p>{s}" + ("</p>" if chance(0.85) else "")

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(int(rng.integers(1, 4)))}</a></li>' for i in range(k)) + "</ul>"

    def junk(where: str) -> str:
        short, long = sentences(1), sentences(int(rng.integers(1, 5)))
        return {
            "nav": lambda: pick(f"<nav data-y=0>{links(int(rng.integers(3, 8)))}</nav>", f'<div data-y=0 class="{pick("menu", "navbar", "breadcrumbs", "top-nav")}">{links(4)}</div>', f'<ul data-y=0 class="menu">{links(3)[4:]}'),
            "header": lambda: pick(f"<header data-y=0><h1>{words(2)}</h1><p>{short}</p></header>", f'<div data-y=0 id="{pick("header", "masthead", "site-header")}"><a href="/">{words(2)}</a> {short}</div>'),
            "footer": lambda: pick(f"<footer data-y=0>&copy; {words(2)} &middot; {long}</footer>", f"<footer data-y=0><p>{long}</p><ul><li><a>{words(1)}</a></li></ul></footer>", f'<div data-y=0 class="{pick("footer", "site-footer", "copyright")}"><p>{long}</p></div>'),
            "side": lambda: pick(f"<aside data-y=0><h3>{words(2)}</h3>{links(4)}</aside>", f"<aside data-y=0><p>{long}</p></aside>", f'<div data-y=0 class="{pick("sidebar", "related", "widget", "recommended")}"><h4>{words(2)}</h4><p>{long}</p></div>', f'<section data-y=0 class="related-posts"><h2>{words(2)}</h2><p>{long}</p></section>'),
            "ad": lambda: f'<div data-y=0 class="{pick("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad")}">{pick(long, f"<p>{long}</p>", f"<a href=/b>{short}</a>")}</div>',
            "notice": lambda: f'<{pick("div", "section")} data-y=0 class="{pick("cookie-notice", "cookie-banner", "notice", "consent", "alert", "newsletter")}"><p>{long}</p><button>{words(1)}</button></div>',
            "form": lambda: f"<form data-y=0 action=/s><label>{words(2)}</label><input name=q><p>{short}</p><button>{words(1)}</button></form>",
            "comments": lambda: pick(f'<{(t := pick("section", "div"))} data-y=0 {pick("class", "id")}="{pick("comments", "comment-list", "discussion", "user-comments")}"><h3>{words(2)}</h3>' + "".join(f'<div class="comment"><b>{words(1)}</b><p>{sentences(int(rng.integers(1, 6)))}</p></div>' for _ in range(int(rng.integers(1, 5)))) + f"</{t}>", '<ol data-y=0 class="commentlist">' + "".join(f"<li><p>{sentences(2)}</p></li>" for _ in range(3)) + "</ol>"),
            "share": lambda: f'<div data-y=0 class="{pick("share", "social", "tags", "post-meta", "byline")}">{words(2)} <a>{words(1)}</a></div>',
            "hidden": lambda: f'<div data-y=0 {pick("hidden", "style=display:none")}><p>{long}</p></div>',
        }[where]()

    def content() -> str:
        top = pick("h1", "h1", "h2")
        out = [f"<{top}>{words(int(rng.integers(2, 9)))}</{top}>"] if chance(0.85) else []
        if chance(0.15):  # many paragraphs of a few words: length of each alone must not decide
            out += [f"<p>{words(int(rng.integers(1, 4)))}{pick('.', '', '!')}</p>" for _ in range(int(rng.integers(15, 90)))]
        for _ in range(int(rng.integers(1, 9))):
            kind = rng.random()
            if kind < 0.72:
                out.append(paragraph())
            elif kind < 0.78:
                out.append(f"<h2>{words(3)}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{sentences(1)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{sentences(2)}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<table><tr><th>{words(1)}</th><td>{words(2)}</td></tr></table>")
            elif kind < 0.94:
                out.append(f"<figure><img src=a><figcaption>{words(5)}</figcaption></figure>")
            elif kind < 0.97:
                out.append(f"<pre><code>{words(6)}</code></pre>")
            else:
                out.append(f"<div><p>{sentences(2)}</p></div>")
            if chance(0.03):
                out.append(f"<noscript data-y=0>{sentences(1)}</noscript>")
            if chance(0.06):
                out.append(junk(pick("ad", "share", "form", "side", "notice")))
        return "".join(out)

    pages = []
    for _ in range(n):
        shell = pick("<article data-y=1>{}</article>", "<article data-y=1>{}</article>", "<main data-y=1>{}</main>", "<main data-y=1><article>{}</article></main>", '<div data-y=1 class="content">{}</div>', '<div data-y=1 id="post-body">{}</div>', '<div data-y=1 class="entry">{}</div>', '<section data-y=1 class="story">{}</section>', "<div data-y=1>{}</div>")
        inner = content() + (junk("comments") if chance(0.15) else "") + (junk("share") if chance(0.15) else "")
        head = [junk("nav")] * chance(0.8) + [junk("header")] * chance(0.5) + [junk("ad")] * chance(0.5) + [junk("notice")] * chance(0.35) + [junk("form")] * chance(0.2) + [junk("hidden")] * chance(0.1)
        tail = [junk("side")] * chance(0.45) + [junk("comments")] * chance(0.35) + [junk("ad")] * chance(0.2) + [junk("form")] * chance(0.2) + [junk("footer")] * chance(0.85) + [junk("notice")] * chance(0.15)
        rng.shuffle(head)
        body = "".join([*head, shell.format(inner), *tail])
        wrap = pick("{}", "{}", '<div class="wrapper">{}</div>', '<div id="page"><div class="container">{}</div></div>')
        pages.append(f"<html data-y=1><head data-y=0><title>{words(3)}</title></head><body data-y=1>{wrap.format(body)}</body></html>")
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def texts_of(pages: list[str | None], model: Model) -> list[str]:
    doms = [parse(p or "") for p in pages]
    f = forest(doms)
    keep = marginals(f, model.w, model.edge)[0] > 0.5 if len(f.parent) else np.zeros(0, bool)
    out = []
    for d, s in zip(doms, f.start, strict=True):
        never = [False] * len(d.tag)
        for i, t in enumerate(d.tag):
            never[i] = t in NEVER or d.parent[i] >= 0 and never[d.parent[i]]
        blocks: dict[int, list[str]] = {}
        for i, b, text in d.texts:
            if keep[s + i] and not never[i]:
                blocks.setdefault(b, []).append(text)
        joined = (" ".join("".join(b).split()) for b in blocks.values())
        out.append(" ".join(b for b in joined if b))
    return out


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", at_once: int = 128) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row; narrow."""
    workers_import(pages.sparkSession)
    model = model or default_model()
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, at_once):
                part = b.slice(i, at_once)
                texts = texts_of(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
