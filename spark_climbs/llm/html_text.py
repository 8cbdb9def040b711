"""Main text of web pages by tree scoring.

A tolerant tokenizer builds the tree of a page (unclosed and misnested tags as browsers
mend them). Paragraphs pass points to their ancestors: one, one for each comma and one for each
hundred characters (three at most), to the parent whole, to the grandparent by half and
to those above by their distance. A container's points are discounted by its link
density. The best container and those of its siblings that score well, or are good
paragraphs themselves, make the article.

Parts that are never an article's text (menus, headers and footers of the page, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are left out by their tag,
role or class name, wherever they are. A class name counts by its whole words (``has-sidebar``,
``social-science`` or ``entry-header`` name no such part). A form or a part with such a name is kept after all
where it holds nearly all of the page's prose, as a page-wide form or wrapper does; comments never
are. A header is kept beside paragraphs of its own container, and a heading alone in a box before the article.

Python in map tasks, a page at a time; nothing is shuffled. A page's tree has as many
nodes as it has tags, and every pass over it is linear.

Defined results: a null or empty page has the text ""; a page without paragraphs falls
back to the text of the best container or of the body; blocks are joined by one space;
repeated pages give equal rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--(?:.*?-->|>|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
#: Tags that are never text of an article.
DROPPED = frozenset(
    "head nav footer aside form script style noscript template iframe title button select textarea option svg canvas "
    "object embed audio video dialog menu input label fieldset map math".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
    "br caption".split()
)
PARAGRAPHS = frozenset("p pre td blockquote h2 h3 h4 h5 h6 li dd".split())
INLINE = frozenset("b strong i em u s span small big sub sup code tt kbd samp var q cite abbr acronym font mark time ins del label".split())
CONTAINERS = frozenset("div article section main body blockquote td center html".split())
#: A start tag closes these open tags, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Block tags close an open paragraph.
ENDS_P = BLOCK - {"br", "html", "body", "tbody", "tr", "td", "th", "thead", "tfoot", "caption"}
SCOPE = frozenset("html body table td th button object caption".split())

#: Words in class and id names of what is not the article, alone or at the end of a compound.
_OUT = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar header masthead footer foot cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended widget toolbar pagination pager skip copyright legal "
    "disclaimer tags outbrain taboola shoutbox".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
#: What a compound that begins with such a word may end in, to name the same kind of part.
_PART = frozenset(
    "area bar block box button buttons card container form frame group holder inner item items label layer left link links list "
    "message module nav outer panel placeholder post posts right row section slot text thread title top bottom unit wrap wrapper zone".split()
)
#: A compound that begins so tells about a layout and names no part.
_MODIFIERS = frozenset("has have no not with without is hide show js".split())
#: Headers of these belong to the article.
_OWN_HEADER = frozenset("entry post article content story blog section hentry".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_IN = re.compile(r"article|body|content|entry|hentry|main|page|post|text|blog|story", re.I)
_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip".split()
)


class _Node:
    __slots__ = ("tag", "name", "parent", "items", "out", "soft", "score", "length", "linked", "scored")

    def __init__(self, tag: str, parent: "_Node | None", name: str = "", out: bool = False):
        self.tag, self.parent, self.name, self.out = tag, parent, name, out
        self.soft = False
        self.items: list = []
        self.score, self.length, self.linked, self.scored = 0.0, 0, 0, False


def _named_out(name: str) -> tuple[bool, bool]:
    """Whether class and id names say that a part is not the article, and whether it is comments."""
    for token in name.split():
        words = [w.lower() for w in _WORDS.findall(token)]
        if not words or words[0] in _MODIFIERS:
            continue
        first, last = words[0], words[-1]
        if last in _COMMENTS or first in _COMMENTS and all(w in _PART for w in words[1:]):
            return True, True
        if last == "header" and len(words) > 1 and words[-2] in _OWN_HEADER:
            continue
        joined = "".join(words)
        if last in _OUT or joined in _OUT or joined == "sidebar" or first in _OUT and all(w in _PART or w in _OUT for w in words[1:]):
            return True, False
    return False, False


def _is_out(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool, str]:
    """Whether a tag opens a part that is left out, whether what it holds may bring it back, and its class and id."""
    if tag in DROPPED:
        return True, tag in ("form", "fieldset"), ""
    if tag == "header" and not inside_article:
        return True, True, ""
    if not attributes:
        return False, False, ""
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    name = f"{found.get('class', '')} {found.get('id', '')}".strip()
    words = attributes.lower().replace("=", " ").split()
    hidden = "hidden" in words or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    if hidden or found.get("role", "").lower() in _ROLES:
        return True, False, name
    if tag in ("html", "body", "article", "main") or not name:
        return False, False, name
    out, comments = _named_out(name)
    return out, out and not comments, name


#: A part left out by its name or as a form comes back if it holds this share of the page's prose.
_NEARLY_ALL = 0.85


def _bring_back(root: _Node) -> None:
    """Keep headers beside paragraphs of their container, and parts left out for their name that hold nearly
    all prose of the page (text of paragraphs, less what is linked, outside other parts left out)."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.items) if isinstance(x, _Node) and (not x.out or x.soft))
    prose: dict[int, int] = {}
    for node in reversed(order):
        own = prose.get(id(node), 0)
        if node.tag == "a":
            own = 0
        elif node.tag in PARAGRAPHS or node.tag in CONTAINERS or node.tag in INLINE:
            own += sum(len(x) for x in node.items if isinstance(x, str) and not x.isspace())
        if node.parent is not None:
            prose[id(node.parent)] = prose.get(id(node.parent), 0) + own
        prose[id(node)] = own
    total = prose.get(id(root), 0)
    for node in order:
        if not node.soft:
            continue
        if node.tag == "header":
            up = node.parent
            beside = up.tag not in ("#root", "html", "body") and any(isinstance(x, _Node) and x.tag == "p" for x in up.items)
            node.out = not beside and prose[id(node)] < _NEARLY_ALL * total
        else:
            node.out = not total or prose[id(node)] < _NEARLY_ALL * total


def parse(page: str) -> _Node:
    """Tree of the page; text items are strings with references decoded."""
    root = _Node("#root", None)
    open_, at, end = [root], 0, len(page)
    articles = 0

    def close(k: int) -> None:
        nonlocal articles
        for node in open_[k:]:
            articles -= node.tag in ("article", "main")
        del open_[k:]

    while at < end:
        m = _TOKEN.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            open_[-1].items.append(html.unescape(page[at:upto]))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                open_[-1].items.append(_Node("br", open_[-1]))
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    close(k)
                    break
                if open_[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                    break
            continue
        attributes = m[3].strip() if m[3] else ""
        if tag in ("html", "body") and any(n.tag == tag for n in open_):
            continue
        if tag in ENDS_P:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    close(k)
                    break
                if open_[k].tag in SCOPE:
                    break
        if tag in CLOSES:
            ends, limit = CLOSES[tag]
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in ends:
                    close(k)
                elif open_[k].tag in limit:
                    break
        if tag == "body" or (tag in BLOCK and tag != "br"):
            for k in range(1, len(open_)):
                if open_[k].tag == "head":
                    close(k)
                    break
        out, soft, name = _is_out(tag, attributes, articles > 0)
        node = _Node(tag, open_[-1], name, out)
        node.soft = soft
        open_[-1].items.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW and tag != "a":
            continue
        if tag in RAW:
            close_tag = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag not in DROPPED:
                node.items.append(page[at : close_tag.start() if close_tag else end])
            at = close_tag.end() if close_tag else end
            continue
        articles += tag in ("article", "main")
        open_.append(node)
    return root


def _ordered(root: _Node) -> list[_Node]:
    """Nodes that are not left out, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.out:
            out.append(node)
            stack.extend(x for x in reversed(node.items) if isinstance(x, _Node))
    return out


def blocks(node: _Node) -> list[str]:
    """Texts of the blocks under ``node`` in page order, white space made one space."""
    found: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            found.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif not x.out:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.items))
    flush()
    return found


def _measure(nodes: list[_Node]) -> None:
    """Characters of text and of linked text under every node."""
    for node in reversed(nodes):
        node.length += sum(len(" ".join(x.split())) for x in node.items if isinstance(x, str))
        if node.tag == "a":
            node.linked = node.length
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked


def _commas(node: _Node) -> int:
    return sum(x.count(",") + x.count("،") + x.count("、") + x.count("，") for x in _strings(node))


def _strings(node: _Node) -> Iterator[str]:
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif not x.out:
            stack.extend(reversed(x.items))


def _density(node: _Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _start(node: _Node) -> None:
    """First points of a container: what its tag and names say."""
    node.scored = True
    node.score += {"article": 25, "main": 20, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3}.get(node.tag, 0)
    node.score += {"ul": -3, "ol": -3, "dl": -3, "li": -3, "th": -5}.get(node.tag, 0)
    node.score += 25 * bool(node.name and _IN.search(node.name))


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    root = parse(page)
    _bring_back(root)
    nodes = _ordered(root)
    _measure(nodes)
    for node in nodes:
        loose = node.tag in ("div", "section", "article", "main", "body") and any(isinstance(x, str) and not x.isspace() for x in node.items)
        if node.tag not in PARAGRAPHS and not loose or not node.length:
            continue
        if loose:
            own = "".join(x for x in node.items if isinstance(x, str))
            points = 1 + own.count(",") + min(len(own) // 100, 3)
            up = node
        else:
            if any(isinstance(x, _Node) and x.tag in PARAGRAPHS for x in node.items):
                continue
            points = 1 + _commas(node) + min(node.length // 100, 3)
            up = node.parent
        points *= 1 - _density(node)
        for level in range(5):
            if up is None or up.tag == "#root":
                break
            if not up.scored:
                _start(up)
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up = up.parent
    scored = [(n.score * (1 - _density(n)), n) for n in nodes if n.scored and n.tag in CONTAINERS]
    if not scored:
        return " ".join(blocks(root))
    best_score, best = max(scored, key=lambda x: x[0])
    if best.parent is None or best.tag in ("body", "html", "#root"):
        return " ".join(blocks(best))
    limit = max(10.0, best_score * 0.2)
    kept, before, headed = [], True, any(n.tag == "h1" for n in _ordered(best))
    for x in best.parent.items:
        if not isinstance(x, _Node) or x.out:
            continue
        before = before and x is not best
        if before and not headed and x.length and _heading_alone(x):
            kept.append(x)
            continue
        bonus = best_score * 0.2 if x.name and x.name == best.name else 0.0
        good = x.scored and x.score * (1 - _density(x)) + bonus >= limit
        if not good and x.tag in ("p", "h1", "h2", "h3", "blockquote", "pre"):
            good = x.length > 80 and _density(x) < 0.25 or 0 < x.length and not x.linked
        if x is best or good:
            kept.append(x)
    return " ".join(t for x in kept for t in blocks(x))


def _heading_alone(node: _Node) -> bool:
    """Whether all text of a box is one first-level heading."""
    heads = [n for n in _ordered(node) if n.tag == "h1"]
    return len(heads) == 1 and heads[0].length == node.length and not node.linked


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(_rows, schema)
