"""HTML extraction: a linear-chain CRF over the leaf blocks of the DOM.

A page is cut into leaf blocks: runs of text between tags of block elements, in page
order. Each block has features of its ancestors (tags, tokens of class, id and role)
and of its text (length, links, punctuation, boilerplate terms, place in the page). A linear-chain
conditional random field with the labels "other" and "main" scores label sequences by
block weights and transition weights; Viterbi decoding gives the most probable one. The
text of the main blocks is the page's text.

The field is trained on labelled pages, written from a fixed seed by ``labelled_pages``: articles in
many kinds of mark-up, with menus, headers, footers, sidebars, notices, adverts, forms
and reader comments around and within them. Their number is a parameter, so training costs
the same for any corpus.

Character references are decoded, white space within a block becomes one space, blocks
are trimmed and joined by one line feed; empty blocks vanish, and nothing else is dropped or capped.

Edge cases: a null or empty page, or one without main blocks, has an empty text; text
without any tag is one block; unclosed and truncated mark-up is read as far as it goes; each row is read by
itself, repeated ids included; columns other than those asked for are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text, elements without content, elements within a line (formulas and drawings with them), and
#: blocks that do not end a paragraph; of these, those of drawings may be closed by "/>".
RAW = "script|style|template|iframe"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
INLINE |= frozenset("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mprescripts mtable mtr mtd mspace mstyle mpadded mphantom menclose mfenced merror maction semantics annotation annotation-xml".split())
INLINE |= frozenset("svg g path circle ellipse rect line polyline polygon defs use symbol tspan textpath lineargradient radialgradient stop clippath mask pattern marker filter animate animatetransform".split())
DRAWN = frozenset("text desc foreignobject".split())
WITHIN = DRAWN | frozenset("title noscript object canvas audio video".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table tbody thead select article section div main aside nav footer header body form blockquote".split())

REGIONS = frozenset("article main aside nav footer header form section body".split())

TOKEN = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</[^a-z][^>]*(?:>|\Z)")
ATTR = re.compile(r"(?is)\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
TOKENS = re.compile(r"[a-z]+")
HINT = re.compile(r"(?i)©|copyright|cookie|subscribe|newsletter|advert|sponsor|comment|repl(?:y|ies)|share|log ?in|sign ?(?:in|up)|privacy|terms of|all rights|accept|search")


class Node:
    """An open element: what it adds to its parent's features. A path is the chain of parents, so a page costs its elements, not their depths."""

    __slots__ = ("parent", "tag", "added", "inner", "region", "article", "weights", "score")

    def __init__(self, parent: Node | None, tag: str, words: tuple[str, ...], active: Counter[str]):
        self.parent, self.tag = parent, tag
        own = [f"in:{tag}", *(f"tok:{w}" for w in words)]  # words differ
        #: Features of this path that no ancestor has; ``active`` counts those of all open elements.
        self.added = tuple(f for f in own if not active[f])
        active.update(own)
        self.inner = words[0] if words else parent.inner if parent else ""
        self.region = tag if tag in REGIONS else parent.region if parent else ""
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.weights: dict[str, float] | None = None
        self.score = 0.0

    def closed(self, words: tuple[str, ...], active: Counter[str]) -> None:
        active.subtract([f"in:{self.tag}", *(f"tok:{w}" for w in words)])


@lru_cache(maxsize=20_000)
def attribute_tokens(attrs: str) -> tuple[str, ...]:
    """Words of class, id, role and itemprop, camelCase split."""
    out = []
    for _, value in ATTR.findall(attrs):
        out += TOKENS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return tuple(dict.fromkeys(out))


def leaf_blocks(page: str) -> list[tuple[Node | None, str, float]]:
    """(innermost open element, text, share of the text in links) of each non-empty block, in page order."""
    blocks: list[tuple[Node | None, str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    nodes: list[Node] = []
    active: Counter[str] = Counter()
    text: list[str] = []
    linked = total = links = 0
    last = 0

    def flush() -> None:
        nonlocal text, linked, total
        if text:
            whole = " ".join(html_lib.unescape("".join(text)).split())
            if whole:
                blocks.append((nodes[-1] if nodes else None, whole, linked / max(total, 1)))
            text, linked, total = [], 0, 0

    def close(k: int) -> None:
        while len(stack) > k:
            nodes.pop().closed(stack.pop()[1], active)

    for m in TOKEN.finditer(page):
        a, b = m.span()
        if a > last:
            part = page[last:a]
            text.append(part)
            total += b and a - last
            if links:
                linked += a - last
        last = b
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if m.group(2):
            if name in INLINE:
                if name == "a" and links:
                    links -= 1
                continue
            flush()
            if active[f"in:{name}"]:  # else no open element has this name
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
                links = 0
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in INLINE:
            links += name == "a"
            continue
        flush()
        if name in VOID or (name in DRAWN and m.group(4).endswith("/")):
            continue
        ends = CLOSES.get(name)
        if ends and any(active[f"in:{x}"] for x in ends):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in STOPS:
                    break
        if stack and stack[-1][0] == "p" and name not in WITHIN:
            close(len(stack) - 1)
        stack.append((name, attribute_tokens(m.group(4))))
        nodes.append(Node(nodes[-1] if nodes else None, *stack[-1], active))
        links = 0
    if last < len(page):
        text.append(page[last:])
        total += len(page) - last
    flush()
    return blocks


def place_features(node: Node | None) -> tuple[str, ...]:
    """The features of a path that depend on its inner end."""
    tag, region, inner = (node.tag, node.region, node.inner) if node else ("", "", "")
    chain = f"{node.parent.tag}>{tag}" if node and node.parent else tag
    out = (f"parent:{tag}", f"chain:{chain}", f"inner:{inner}", f"region:{region}")
    return out if node and node.article else (*out, "no-article")


def path_features(node: Node | None) -> tuple[str, ...]:
    out, at = list(place_features(node)), node
    while at:
        out += at.added
        at = at.parent
    return tuple(sorted(out))


def text_features(text: str, link_share: float, place: int, count: int) -> tuple[str, ...]:
    n = text.count(" ") + 1
    out = [f"words:{min(n, 128).bit_length()}", f"links:{int(link_share * 4)}", f"end:{text[-1] in '.!?:;…'}", f"place:{min(3, 4 * place // count)}"]
    if HINT.search(text):
        out.append("hint" if n > 12 else "hint:short")
    if place == 0:
        out.append("first")
    return tuple(out)


class LinearChainCRF:
    """Labels 0 (other) and 1 (main). ``weights``: of a feature for label 1 against 0; ``move[a, b]``: of label b after a."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.move = np.zeros((2, 2))
        self.start = np.zeros(2)

    def fit(self, pages: list[tuple[list[tuple[str, ...]], list[int]]], epochs: int = 40, rate: float = 0.1, l2: float = 1e-4, seed: int = 3) -> LinearChainCRF:
        """Maximises the conditional log likelihood by Adam; expectations by forward-backward over a batch of pages at once."""
        names = sorted({f for blocks, _ in pages for fs in blocks for f in fs})
        index = {f: i for i, f in enumerate(names)}
        coded = [([np.array([index[f] for f in fs]) for fs in blocks], np.array(labels)) for blocks, labels in pages if labels]
        theta, m, v, step = np.zeros(len(names) + 6), np.zeros(len(names) + 6), np.zeros(len(names) + 6), 0
        rng = np.random.default_rng(seed)
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(len(coded)), max(1, len(coded) // 50)):
                d = self.gradient([coded[i] for i in part], theta, len(names)) / len(part) - l2 * theta
                step += 1
                m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
                theta += rate * (0.3 if epoch > epochs // 2 else 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights = {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-6}
        self.move, self.start = theta[-6:-2].reshape(2, 2), theta[-2:]
        return self

    @staticmethod
    def gradient(batch: list, theta: np.ndarray, n: int) -> np.ndarray:
        longest = max(len(y) for _, y in batch)
        emit, y, real = np.zeros((len(batch), longest, 2)), np.zeros((len(batch), longest), np.int64), np.zeros((len(batch), longest), bool)
        for k, (blocks, labels) in enumerate(batch):
            emit[k, : len(labels), 1] = [theta[b].sum() for b in blocks]
            y[k, : len(labels)], real[k, : len(labels)] = labels, True
        move, start = theta[-6:-2].reshape(2, 2), theta[-2:]
        add = lambda x, axis: np.logaddexp(x.take(0, axis), x.take(1, axis))
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0] + start
        for t in range(1, longest):
            new = add(forward[:, t - 1, :, None] + move, 1) + emit[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = add(move + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], new, 0)
        z = add(forward[:, -1], 1)
        p = np.exp(forward + backward - z[:, None, None])
        grad = np.zeros_like(theta)
        for k, (blocks, labels) in enumerate(batch):
            for t, b in enumerate(blocks):
                grad[b] += labels[t] - p[k, t, 1]
        both = np.exp(forward[:, :-1, :, None] + move + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
        grad[-6:-2] = (seen - both.sum((0, 1))).ravel()
        grad[-2:] = np.bincount(y[:, 0], minlength=2) - p[:, 0].sum(0)
        return grad

    def block_scores(self, blocks: list[tuple[Node | None, str, float]]) -> list[float]:
        get, out = self.weights.get, []
        for i, (node, text, share) in enumerate(blocks):
            chain, at = [], node
            while at and at.weights is not self.weights:
                chain.append(at)
                at = at.parent
            for x in reversed(chain):  # each element's sum is its parent's and its own
                x.weights, x.score = self.weights, (x.parent.score if x.parent else 0.0) + sum(get(f, 0.0) for f in x.added)
            s = (node.score if node else 0.0) + sum(get(f, 0.0) for f in place_features(node))
            out.append(s + sum(get(f, 0.0) for f in text_features(text, share, i, len(blocks))))
        return out

    def viterbi(self, scores: list[float]) -> list[int]:
        """The most probable labels; of equal ones "other"."""
        if not scores:
            return []
        (a, b), (c, d) = self.move.tolist()
        x, y = float(self.start[0]), float(self.start[1]) + scores[0]
        back = []
        for s in scores[1:]:
            to0, to1 = (0, x + a) if x + a >= y + c else (1, y + c), (0, x + b) if x + b >= y + d else (1, y + d)
            back.append((to0[0], to1[0]))
            x, y = to0[1], to1[1] + s
        label = int(y > x)
        out = [label]
        for steps in reversed(back):
            label = steps[label]
            out.append(label)
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        return "\n".join(text for (_, text, _), label in zip(blocks, self.viterbi(self.block_scores(blocks)), strict=True) if label)


def labelled_pages(n: int, seed: int = 21) -> Iterator[tuple[str, list[int]]]:
    """Pages with the label of each of their leaf blocks."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    many = lambda a, b: range(int(rng.integers(a, b)))
    syllables = ["an", "er", "th", "on", "re", "ti", "es", "or", "de", "la", "que", "en", "ung", "sch", "os", "al", "st", "é", "ión", "ü"]

    def words(a: int, b: int) -> str:
        style = pick([str, str, str, str.upper, lambda w: w + pick(["%%%", "***", "!!", ""])])
        out = " ".join(style("".join(pick(syllables) for _ in many(1, 5))) for _ in many(a, b))
        return (out[:1].upper() + out[1:]).replace("&", "&amp;") + pick([".", ".", ".", "", "!", ","])

    for _ in range(n):
        out: list[str] = []
        labels: list[int] = []

        def block(tag: str, text: str, label: int, attrs: str = "", out=out, labels=labels) -> None:
            close = "" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"
            out.append(f"<{tag}{attrs}>{text}{close}{pick(['', '', chr(10)])}")
            labels.append(label)

        def named(tags: list[str], names: list[str]) -> tuple[str, str]:
            tag, name = pick(tags), pick(names)
            attr = pick(["class", "class", "id"])
            extra = pick(["", "", " box", " widget", " wrap"]) if attr == "class" else ""
            return f'<{tag} {attr}="{pick(["", "", "site-", "main-", "page-", "x-"])}{name}{extra}">', f"</{tag}>"

        def menu() -> None:
            for _ in many(2, 7):
                block("li", f'<a href="/x">{words(1, 4)}</a>', 0)

        def other(kind: str, out=out) -> None:
            a, b = {
                "menu": lambda: pick([("<nav>", "</nav>"), named(["div", "ul", "nav"], ["nav", "menu", "navbar", "breadcrumb", "navigation", "toc-nav"]), ('<div role="navigation">', "</div>")]),
                "header": lambda: pick([("<header>", "</header>"), named(["div", "header"], ["header", "masthead", "banner-top", "topbar", "branding"]), ('<div role="banner">', "</div>")]),
                "footer": lambda: pick([("<footer>", "</footer>"), ("<footer>", "</footer>"), named(["div", "footer"], ["footer", "footer-links", "copyright", "colophon", "bottom"]), ('<div role="contentinfo">', "</div>")]),
                "sidebar": lambda: pick([("<aside>", "</aside>"), named(["div", "aside", "section"], ["sidebar", "related", "related-posts", "recommended", "trending", "widget", "rail", "popular", "tags", "share", "social", "author-box"]), ('<div role="complementary">', "</div>")]),
                "notice": lambda: named(["div", "section", "p", "aside"], ["notice", "cookie-notice", "cookie", "consent", "gdpr", "alert", "newsletter", "subscribe", "paywall", "popup", "modal", "message"]),
                "advert": lambda: named(["div", "aside", "section", "ins"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "adsbox", "sponsor"]),
                "form": lambda: pick([("<form>", "</form>"), ('<form action="/s" class="search">', "</form>"), named(["form"], ["login", "search", "subscribe", "contact", "comment-form"])]),
                "comments": lambda: named(["section", "div", "ol", "ul"], ["comments", "comment", "comment-list", "reader-comments", "discussion", "replies", "responses", "respond", "disqus"]),
            }[kind]()
            out.append(a)
            if kind == "menu" or (kind in ("header", "footer", "sidebar") and rng.random() < 0.4):
                if rng.random() < 0.5:
                    out.append("<ul>")
                menu()
                if out[-1] != "</ul>":
                    out.append("</ul>")
            elif kind == "form":
                for _ in many(1, 4):
                    block(pick(["button", "p", "div", "fieldset"]), words(1, 6), 0)
                    out.append('<input name="q">')
            else:
                if rng.random() < (0.8 if kind == "header" else 0.35):
                    block(pick(["h1", "h1", "h2", "p"] if kind == "header" else ["h2", "h3", "h4"]), words(1, 6), 0)
                for _ in many(1, 4 if kind != "comments" else 6):
                    if rng.random() < 0.3:
                        labels.append(0)
                        out.append(f"{words(2, 25)}<hr>")
                    else:
                        lead = "&copy; x &middot; " if kind == "footer" and rng.random() < 0.6 else ""
                        wrap = pick(["", "", ' class="text"', ' class="body"', ' class="content"']) if kind in ("comments", "notice") else ""
                        block(pick(["p", "p", "div", "li", "article" if kind == "comments" else "p"]), lead + words(2, 40), 0, wrap)
            out.append(b)

        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
        labels.append(0)
        for kind in ("menu", "header", "notice", "advert", "sidebar", "form", "menu"):
            if rng.random() < 0.35:
                other(kind)
        if rng.random() < 0.3:
            out.append(pick(["<div>", '<div class="wrapper">', '<div class="container">', '<div id="page">']))
        start, end = pick([
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<article class="post">', "</article>"), ('<div role="main">', "</div>"), ('<div itemprop="articleBody">', "</div>"),
            named(["div", "section", "main"], ["content", "post-content", "entry-content", "article-body", "article", "story", "post", "entry", "main", "body-text", "text"]),
        ])
        out.append(start)
        if rng.random() < 0.85:
            head = pick(["h1", "h1", "h2"])
            wrapped = rng.random() < 0.15
            if wrapped:
                out.append("<header>")
            block(head, words(1, 12), 1)
            if wrapped:
                out.append("</header>")
        for _ in many(1, 12):
            r = rng.random()
            if r < 0.72:
                text = words(1, 90)
                if rng.random() < 0.25:
                    text = f"<b>{text}<br>"
                elif rng.random() < 0.2:
                    text += f' <a href="/y">{words(1, 3)}</a> {words(2, 20)}'
                block(pick(["p", "p", "p", "p", "div"]), text, 1)
            elif r < 0.78:
                block(pick(["h2", "h3"]), words(1, 8), 1)
            elif r < 0.83:
                out.append("<ul>")
                for _ in many(1, 5):
                    block("li", words(2, 20), 1)
                out.append("</ul>")
            elif r < 0.87:
                block(pick(["blockquote", "pre", "figcaption"]), words(3, 40), 1)
            elif r < 0.89:
                out.append("<table><tr>")
                for _ in many(2, 5):
                    block("td", words(1, 6), 1)
                out.append("</tr></table>")
            elif r < 0.96:
                other(pick(["advert", "sidebar", "notice", "form", "menu"]))
        if rng.random() < 0.2:
            other("comments")
        out.append(end)
        for kind in ("comments", "sidebar", "advert", "form", "notice", "footer", "footer"):
            if rng.random() < (0.7 if kind == "footer" else 0.3):
                other(kind)
        if rng.random() < 0.9:
            out.append("</body></html>")
        yield "".join(out), labels


@lru_cache(maxsize=4)
def trained(n_pages: int, seed: int = 21) -> LinearChainCRF:
    pages = []
    for page, labels in labelled_pages(n_pages, seed):
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            pages.append(([path_features(p) + text_features(t, s, i, len(blocks)) for i, (p, t, s) in enumerate(blocks)], labels))
    return LinearChainCRF().fit(pages)


def extract(pages: DataFrame, n_training: int = 800, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Returns the columns ``keep`` and ``text``, the main text of every whole page."""
    sent = pages.sparkSession.sparkContext.broadcast(trained(n_training))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = pa.array([model.main_text(p.as_py()) for p in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*keep, "text"])

    kept = pages.select(*keep)
    rows = pages.select(*keep, F.col(html_col).alias("__html"))
    return rows.mapInArrow(work, type(kept.schema)([*kept.schema.fields]).add("text", "string"))
