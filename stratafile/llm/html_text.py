"""Main text of HTML pages by tree scoring.

The page becomes a tree of elements by the usual rules for tags that close by themselves. Blocks of text that stand in paragraphs give points, one each, one for each
comma and one for each 100 characters up to three, to their parent in full and to further ancestors in part; an element's points are
discounted by its link density, and raised or lowered by what its name and its class or id say. The best container is
kept (of equal ones the first of the page), and with it those of its siblings whose own points, or length at low link density, show that they belong to it, and all that stands between these and is no bunch of links. Menus, headers of
the page, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out wherever they stand and however long they are. Which elements with a bad class
or id are that is told by structure, not by size: those around the article stay, all others go. The article is the first article or main element without a bad name of
its own and not below one; if all of them are below one, the first; without any, the first h1 by the same rule. Forms, and elements with the role of an alert, a dialog or a search, stay in the same way where the article
stands in them and nowhere else. Where a page has no text outside all of these, they stay. Names that may as well tell of a part of the article (side, tags) count outside articles only; a section whose
heading just says comments or replies is one of comments, whatever its name; a label is text within a paragraph or the like only.

Defined cases: null html, or a page without any text: the empty string; a page without paragraphs: the text of its body; markup that breaks off:
what was read until then; rows without a page_id or url are read like others; quotes count only where an attribute's value begins with them; unknown references stay as they are; repeated rows give equal texts; an empty table gives an
empty result; pages of any length and depth are read whole, in time that grows with their length (no recursion, no searches through open elements); other columns are not read."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import values

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
SPACES = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style noscript template title head nav footer aside form button select option textarea iframe object embed svg canvas menu dialog input audio video map noembed noframes".split())
#: An opening tag of the key closes an open one of these, up to the stop.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tr td th thead tbody", "table"), "thead": ("tr td th", "table"), "tfoot": ("tr td th thead tbody", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}
#: Dropped elements that may be wrapped around a page's article, and roles that drop an element; those of WRAPS likewise.
WRAPS, ROLES, WRAP_ROLES = frozenset(["form"]), frozenset("navigation banner contentinfo complementary menu hidden".split()), frozenset("search dialog alert".split())
#: A label stays below these.
PROSE = frozenset("p li td th dd dt blockquote figcaption h1 h2 h3 h4 h5 h6 pre".split())
#: Beside the best container these belong to it like paragraphs.
LIKE_P = frozenset("p blockquote pre ul ol dl table figure".split())
COMMENTS = re.compile(r"(?:\d+\s+)?(?:reader\s+)?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?\s*:?", re.I)
GOOD = re.compile(r"article|body|content|entry|hentry|main|page|post|story|text", re.I)
BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|replies|respond|disqus|sidebar|side|related|recommend\w*|share|sharing|social|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|menu|nav\w*|breadcrumbs?|footer|masthead|site-header|toolbar|widget|pagination|pager|tags|skip)(?:$|[\s_-]|\d)", re.I)
#: Of these, the names that count outside articles only.
WEAK = re.compile(r"(?:^|[\s_-])(?:side|tags)(?=$|[\s_-]|\d)", re.I)
SCORED = frozenset("p pre td blockquote li dd".split())
#: Points that a container starts with.
START = {"article": 8.0, "main": 6.0, "section": 1.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "form": -3.0, "li": -3.0, "h1": -5.0, "h2": -5.0, "h3": -5.0}


class Node:
    __slots__ = ("name", "parent", "kids", "mark", "role", "score", "chars", "linked", "out", "inside", "inside_prose", "bad", "below")

    def __init__(self, name, parent, mark="", role=""):
        self.name, self.parent, self.kids, self.mark, self.role = name, parent, [], mark, role
        self.score, self.chars, self.linked = None, 0, 0
        self.out = self.inside = self.inside_prose = self.bad = self.below = False


class _Open:
    """The open elements, from the root down, and where each name stands among them."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], defaultdict(list), []

    def last(self, name: str) -> int:
        """The place of the innermost open element of that name, 0 if none is open."""
        return self.at[name][-1] if self.at.get(name) else 0

    def push(self, node: Node) -> None:
        self.at[node.name].append(len(self.nodes))
        if node.name in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, i: int) -> None:
        """Closes the element at place i and all within it."""
        while len(self.nodes) > i:
            name = self.nodes.pop().name
            self.at[name].pop()
            if name in BLOCK:
                self.blocks.pop()


def parse(html: str) -> tuple[Node, list[Node]]:
    """The root, and all elements in page order; strings among the kids are text, references decoded."""
    root = Node("#root", None)
    open_, every, at, n = _Open(root), [], 0, len(html)
    low = None

    def add(text):
        if text:
            open_.nodes[-1].kids.append(unescape(text) if "&" in text else text)

    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            if name == "br":
                open_.nodes[-1].kids.append(" ")
            elif name not in VOID:
                i = open_.last(name)
                # inline elements don't end through a table or a cell
                if i and (name in BLOCK or i >= max(map(open_.last, ("table", "td", "th")))):
                    open_.cut(i)
            continue
        if name in CLOSES:
            shut, stop = CLOSES[name]
            least = max(map(open_.last, stop))
            while (i := max(map(open_.last, shut))) > least:
                open_.cut(i)
                if name not in ("tr", "tbody", "tfoot", "thead"):
                    break
        if name in ENDS_P and open_.blocks and open_.nodes[open_.blocks[-1]].name == "p":
            open_.cut(open_.blocks[-1])
        if name == "br":
            open_.nodes[-1].kids.append(" ")
            continue
        attributes = m.group(3)
        mark = role = ""
        if attributes and "=" in attributes or "hidden" in attributes:
            for a, x, y, z in ATTRIBUTE.findall(attributes):
                a, v = a.lower(), x or y or z
                if a in ("class", "id"):
                    mark += f" {v}"
                elif a == "role":
                    role = v.lower()
                elif a == "hidden" or a == "aria-hidden" and v == "true" or a == "style" and re.search(r"display\s*:\s*none", v, re.I):
                    role = "hidden"
        node = Node(name, open_.nodes[-1], mark, role)
        open_.nodes[-1].kids.append(node)
        every.append(node)
        if name in RAW:
            if low is None:
                low = html.lower() if len(html.lower()) == n else html
            end = low.find(f"</{name}", at)
            if name in ("title", "textarea"):
                node.kids.append(unescape(html[at : end if end >= 0 else n]))
            at = n if end < 0 else end
            if end >= 0:
                close = html.find(">", end)
                at = n if close < 0 else close + 1
        elif name not in VOID and not (attributes.endswith("/") and name in ("path", "rect", "circle")):
            open_.push(node)
    return root, every


def _measure(root: Node, every: list[Node]) -> None:
    """chars and linked of each element: characters without white space, and those in links; nothing of what is left out counts."""
    for node in reversed([root, *every]):
        if node.out:
            continue
        for kid in node.kids:
            if isinstance(kid, str):
                node.chars += len(kid) - sum(map(kid.count, " \n\t\r"))
            elif not kid.out:
                node.chars += kid.chars
                node.linked += kid.linked
        if node.name == "a":
            node.linked = node.chars


def _says_comments(x: Node) -> bool:
    """Whether an element begins with a heading that says nothing but comments."""
    if x.name not in ("section", "div", "ol", "ul"):
        return False
    first = next((k for k in x.kids if not isinstance(k, str) or k.strip()), None)
    if not isinstance(first, Node) or first.name not in ("h2", "h3", "h4", "h5", "h6"):
        return False
    text, todo = [], list(reversed(first.kids))
    while todo and sum(map(len, text)) < 60:
        k = todo.pop()
        text.append(k) if isinstance(k, str) else todo.extend(reversed(k.kids))
    return COMMENTS.fullmatch("".join(text).strip()) is not None


def _leave_out(root: Node, every: list[Node]) -> None:
    """Marks what is no part of any main text, and with it all that stands below."""
    wrapped = {}
    for x in every:  # parents come before their children
        up = x.parent
        x.inside = up.inside or up.name in ("article", "main", "section")
        wraps = (x.name in WRAPS or x.role in WRAP_ROLES) and x.name not in DROPPED - WRAPS
        gone = x.name in DROPPED - WRAPS or x.role in ROLES or x.role in WRAP_ROLES and not wraps or x.name == "header" and not x.inside
        x.out = up.out or gone or x.name == "label" and up.name not in PROSE and not up.inside_prose
        x.inside_prose = up.inside_prose or x.name in PROSE
        wrapped[id(x)] = wraps or wrapped.get(id(up), False)
        named = BAD.search(WEAK.sub(" ", x.mark) if x.inside else x.mark) is not None if x.mark else False
        x.bad = x.name not in ("body", "html") and named or x.inside and _says_comments(x)
        x.below = up.below or up.bad
    there = [x for x in every if not x.out]
    articles = [x for x in there if x.name in ("article", "main") and not x.bad]
    heads = [x for x in there if x.name == "h1"]
    free = lambda some: [x for x in some if not wrapped[id(x)]]
    found = free(articles) or free(heads) or articles or heads
    first = next((x for x in found if not x.below), found[0] if found else None)
    around, up = set(), first
    while up is not None:
        around.add(id(up))
        up = up.parent
    wraps = [x for x in there if (x.name in WRAPS or x.role in WRAP_ROLES) and id(x) not in around]
    for x in wraps:
        x.out = True
    for x in every:
        x.out = x.out or x.parent.out
    shown = [x for x in every if not x.out]
    if not any(x.name in ("article", "main") and not x.bad for x in shown):
        for x in shown:  # all articles have a bad name: it doesn't tell anything
            x.bad = x.bad and x.name not in ("article", "main")
    bad = [x for x in shown if x.bad and id(x) not in around]
    for x in bad:
        x.out = True
    for x in every:
        x.out = x.out or x.parent.out
    _measure(root, every)
    for kept in (shown, there):  # without any other text, first badly named elements stay, then wraps
        if root.chars or len(kept) == len([x for x in every if not x.out]):
            continue
        kept = {id(x) for x in kept}
        for x in every:
            x.out = id(x) not in kept
        for x in [root, *every]:
            x.chars = x.linked = 0
        _measure(root, every)


def _score(every: list[Node]) -> Node | None:
    for x in every:
        if x.out or x.name not in SCORED or not x.chars:
            continue
        commas = 0
        todo = [x]
        while todo:
            for kid in todo.pop().kids:
                if isinstance(kid, str):
                    commas += kid.count(",") + kid.count("、") + kid.count("，")
                elif not kid.out and kid.name not in BLOCK:
                    todo.append(kid)
        points = (1.0 + commas + min(x.chars // 100, 3)) * (1.0 - x.linked / x.chars)
        up, part = x.parent, 1.0
        for level in range(1, 4):
            if up is None or up.name == "#root":
                break
            if up.score is None:
                up.score = START.get(up.name, 0.0)
                if up.mark:
                    up.score += 25.0 * bool(GOOD.search(up.mark)) - 25.0 * bool(BAD.search(up.mark))
            up.score += points * part
            up, part = up.parent, (0.5 if level == 1 else 1 / 6)
    best, most = None, None
    for x in every:
        if x.score is not None and not x.out:
            value = x.score * (1.0 - (x.linked / x.chars if x.chars else 0.0))
            if most is None or value > most:
                best, most = x, value
    if best is not None:
        # an article or main element around the best container is the article
        up = best.parent
        while up is not None:
            if up.name in ("article", "main") and not up.out:
                best = up
            up = up.parent
    return best


def _kept(best: Node) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order, with what stands between them."""
    if best.parent is None or best.name in ("body", "html"):
        return [best]
    least = max(10.0, 0.2 * (best.score or 0.0))
    row, own = [], []
    for x in best.parent.kids:
        if isinstance(x, str) or x.out or not x.chars:
            if isinstance(x, str) and x.strip():
                row.append(x)
                own.append(False)
            continue
        dense = x.linked / x.chars
        bonus = 0.2 * (best.score or 0.0) if x.mark and x.mark == best.mark else 0.0
        same = (x.score is not None and x.score * (1 - dense) + bonus >= least) or (x.name in LIKE_P and (x.chars > 80 and dense < 0.25 or x.chars <= 80 and dense == 0))
        row.append(x)
        own.append(x is best or same or x.name in ("h1", "h2"))
    first, last = own.index(True), len(own) - 1 - own[::-1].index(True)
    return [x for i, x in enumerate(row) if own[i] or first < i < last and (isinstance(x, str) or x.linked < 0.5 * x.chars)]


def _blocks(nodes: list[Node]) -> list[str]:
    out, line = [], []

    def end():
        text = SPACES.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif not x.out:
            if x.name in BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(x.kids))
    end()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root, every = parse(html)
    _leave_out(root, every)
    best = _score(every)
    if best is None:
        body = next((x for x in every if x.name in ("article", "main") and not x.out), None) or next((x for x in every if x.name == "body"), root)
        return "\n".join(_blocks([body]))
    return "\n".join(_blocks(_kept(best)))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
