"""Main text of web pages by minimum-cut labelling.

A page's markup is split into blocks (text between block-level tags).  A fixed linear classifier scores each block by
where it is (the landmark element it lies in, containers that look like boilerplate), and by what it is (length,
punctuation, share of linked text, kind of element); the score becomes the capacity of the block's edge to the source
(content) or to the sink (boilerplate).  Neighbouring blocks, and blocks of one parent, are tied by smoothness edges as
strong as many scores, stronger the more of the DOM path they share, weaker across the border of a container.
The minimum cut is the labelling of least total cost; blocks on the source side are the main text.

Class and id words inform and do not veto: a container that holds the page's heading, its article, or nearly all its
text is not boilerplate whatever it is called; a form, an aside or a footer is judged in the same way.  A short heading
such as "3 comments" makes the rest of its parent reader comments.  Where articles hold most of the page, the rest counts as
outside; a short text that reads like a notice on cookies or rights is one outside of them; a table's cells are neither, so their
neighbours decide.  There are no labelled pages to fit weights on, so they are set by hand (``WEIGHTS``).  Every step is
linear in the length of the page, however deep its tags are nested and however many blocks it has (see ``minimum_cut``).

Defined results: null or empty html, and pages without content, give empty text; markup may be malformed (a
paragraph ends where the next begins, an end tag closes what is open inside it, unknown end tags are ignored, a slash
at the end of a tag does not close it); every row gives one row, repeated or not; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import with_columns

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
NEVER = frozenset("head script style title textarea noscript template iframe svg math object canvas button select option datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav noscript ol optgroup option p pre script section select style summary table tbody td template textarea tfoot th thead title tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - {"option", "optgroup"}
SCOPES = frozenset("article body div li main section table td".split())
KINDS = frozenset("p li td th dt dd h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark boilerplate, and those that mark the main text.
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related reply replies respond "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets complementary contentinfo".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: First words of names that say what a page has or lacks, not what the element is.
ABOUT_WORDS = frozenset("no not has have with without is tag category".split())
#: Headings over reader comments, numbers left out.
COMMENT_HEADINGS = frozenset(("comment", "comments", "reader comments", "leave a comment", "leave a reply", "reply", "replies", "responses", "kommentar", "kommentare", "commentaire", "commentaires", "comentario", "comentarios"))
#: Scores of the landmark element that is nearest, and of containers.
LANDMARKS = {"article": 1.5, "main": 1.5, "nav": -3.0, "menu": -3.0, "aside": -2.5, "footer": -2.5, "dialog": -2.5, "header": -2.0}
BOXES = {"form": -3.0, "fieldset": -1.5}
#: Weights of the classifier: positive for content.
WEIGHTS = {"bias": -0.6, "boiler_word": -3.0, "comments": -3.0, "content_word": 0.8, "words": 0.04, "most_words": 40, "sentence": 0.5, "linked": -2.5, "p": 0.4, "h1": 0.8, "heading": 0.2, "item": -0.2, "cell": 0.5, "notice": -3.0, "notice_length": 300, "outside": -1.5}
#: What notices about cookies and rights say, in the languages of the word lists.
NOTICE = re.compile(
    r"\b(?:uses?|accept|allow|reject|manage)\s+(?:(?:all|the|our|necessary|optional|third.party)\s+)?cookies\b|\bcookie\s+(?:policy|settings|preferences|notice|consent)\b|\bcookies\s+(?:to improve|to ensure|on this (?:web)?site)\b|"
    r"^\W*(?:©|\(c\)\s*(?:19|20)\d\d|copyright\b)|\ball rights reserved\b|\b(?:verwenden|nutzt|benutzt)\s+cookies\b|\balle rechte vorbehalten\b|\butilis(?:e|ons)\s+des cookies\b|\btous droits réservés\b|\butiliza(?:mos)?\s+cookies\b|\btodos los derechos reservados\b", re.I)
#: Share of a page's text in article and main elements from which the rest of the page is outside of its text.
INSIDE = 0.5
ADJACENT, SIBLINGS, BORDER = 1.2, 0.6, 0.25
#: Share of a page's text beyond which a container is the page.
WHOLE = 0.8
HARD, EVEN = 1e9, 1e-9

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!?\?[^>]*>|<![^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    depth: int = 0
    never: bool = False
    linked: bool = False
    holder: Node | None = None  # nearest block-level element, itself included
    paragraph: Node | None = None  # the open paragraph that a block-level tag ends
    kind: str = ""
    boiler: bool = False
    content: bool = False
    comments: bool = False
    size: int = 0
    titled: bool = False  # holds a first-level heading
    main: bool = False  # holds, or is, an article or main element
    land: float = 0.0
    box: float = 0.0
    good: float = 0.0
    inside: bool = True  # in the page's article, if it has one


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """(boilerplate, content) by the names of an element."""
    boiler = content = False
    for m in _NAMES.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            words = [w.lower() for w in _CAMEL.split(name) if w]
            if not words or words[0] in ABOUT_WORDS:
                continue
            said = [w for w in words if w in BOILER_WORDS]
            if tag in ("article", "main"):  # such names list what the page has as well
                boiler |= len(words) == 1 and bool(said)
            elif tag not in ("html", "body"):
                boiler |= words[-1] in BOILER_WORDS or words[0] in BOILER_WORDS and CONTENT_WORDS.isdisjoint(words)
            content |= not said and not CONTENT_WORDS.isdisjoint(words)
    return boiler, content


def _node(tag: str, attributes: str, parent: Node) -> Node:
    n = Node(tag, parent, parent.depth + 1, tag in NEVER or parent.never, tag == "a" or parent.linked and tag not in BLOCKS)
    n.holder = n if tag in BLOCKS else parent.holder
    n.paragraph = n if tag == "p" else None if tag in SCOPES else parent.paragraph
    n.kind = tag if tag in KINDS else parent.kind
    n.comments = parent.comments
    if "=" in attributes:
        n.boiler, n.content = _marks(tag, attributes)
    return n


def parsed(page: str) -> tuple[list[Block], list[Node]]:
    """The blocks of a page in order, those without text left out, and its elements, parents before children."""
    root = node = Node("", None)
    root.holder = root
    nodes, out, open_tags = [root], [], Counter()
    block, at, size = Block(root), 0, len(page)

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            open_tags[node.tag] -= 1
            node = node.parent

    def close() -> None:
        nonlocal block
        block.text = " ".join("".join(block.parts).split())
        if block.text:
            out.append(block)
            up = block.node.parent
            if block.node.tag in HEADINGS and up is not None:
                title = " ".join(re.findall(r"[^\W\d_]+", block.text.lower()))
                up.comments = title in COMMENT_HEADINGS or up.comments and up.parent is not None and up.parent.comments
        block = Block(node.holder)

    def add(raw: str) -> None:
        if raw:
            text = entities.unescape(raw)
            block.parts.append(text)
            if node.linked:
                block.linked += len(text.strip())

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not end:
            if tag in BLOCKS:
                close()
            if tag in ENDS_PARAGRAPH and node.paragraph is not None:
                leave(node.paragraph.parent)
            if tag == "li" and node.tag == "li":
                leave(node.parent)
            if tag == "br":
                block.parts.append(" ")
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else size
                continue
            if tag not in VOID:
                node = _node(tag, attributes, node)
                nodes.append(node)
                open_tags[tag] += 1
            if tag in BLOCKS:
                block = Block(node.holder)
        elif open_tags[tag]:
            if tag in BLOCKS:
                close()
            while node.tag != tag:
                leave(node.parent)
            leave(node.parent)
            if tag in BLOCKS:
                block = Block(node.holder)
        elif tag in BLOCKS:
            close()
    close()
    return out, nodes


def _judge(nodes: list[Node], blocks: list[Block]) -> None:
    """Sizes from the leaves up, then scores of landmarks and containers from the root down."""
    for b in blocks:
        b.node.size += len(b.text)
    for n in reversed(nodes):
        n.titled |= n.tag == "h1"
        n.main |= n.tag in ("article", "main") and not n.boiler
        if n.parent is not None:
            n.parent.size += n.size
            n.parent.titled |= n.titled
            n.parent.main |= n.main
    whole = nodes[0].size
    held, found = 0, set()
    for n in nodes[1:]:  # parents come first
        if n.tag in ("article", "main") and not n.boiler and not n.comments:
            if id(n.parent) not in found:
                held += n.size
            found.add(id(n))
        elif id(n.parent) in found:
            found.add(id(n))
    apart = held >= INSIDE * whole > 0
    for n in nodes:
        n.inside = not apart or id(n) in found
    for n in nodes[1:]:
        up, page = n.parent, n.size > WHOLE * whole
        n.land, n.box, n.good = up.land, up.box, max(up.good, WEIGHTS["content_word"] * n.content)
        if n.tag in ("article", "main"):
            n.land = LANDMARKS[n.tag] if not n.boiler else up.land
        elif n.tag == "header":
            n.land = up.land if up.land > 0 or n.main else LANDMARKS[n.tag]  # an article's own header holds its title
        elif n.tag in LANDMARKS and not (n.main or page):
            n.land = LANDMARKS[n.tag]
        own = min(BOXES.get(n.tag, 0.0), WEIGHTS["boiler_word"] * n.boiler)
        if own and not (n.titled or page or n.main and n.tag not in ("article", "main")):
            n.box = min(n.box, own)
        if n.comments:
            n.box = min(n.box, WEIGHTS["comments"])


def score(block: Block) -> float:
    """Positive for content, negative for boilerplate; HARD where the markup alone decides."""
    n, w, text = block.node, WEIGHTS, block.text
    if n.never:
        return -HARD
    value = w["bias"] + n.land + n.box + n.good
    value += w["words"] * min(text.count(" ") + 1, w["most_words"]) + w["linked"] * min(1.0, block.linked / len(text)) + w["sentence"] * (text[-1] in ".!?…:;")
    value += w["notice"] * (n.land <= 0 and len(text) <= w["notice_length"] and bool(NOTICE.search(text))) + w["outside"] * (not n.inside)
    return value + (w[n.kind] if n.kind in ("p", "h1") else w["heading"] if n.kind in HEADINGS else w["cell"] if n.kind in ("td", "th") else w["item"] if n.kind else 0.0)


def proximity(a: Node, b: Node) -> float:
    """Share of the longer DOM path that two nodes have in common; costs the steps between them."""
    longest = max(a.depth, b.depth)
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        else:
            b = b.parent
    return a.depth / longest if longest else 1.0


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    border = lambda a, b: 1.0 if (a.land, a.box) == (b.land, b.box) else BORDER
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1].node
            edges.append((i - 1, i, ADJACENT * proximity(a, b.node) * border(a, b.node)))
        j = last.get(b.node.parent, i - 1)
        if j != i - 1:
            edges.append((j, i, SIBLINGS * border(blocks[j].node, b.node)))
        last[b.node.parent] = i
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of least cost: scores of the wrong sign and edges between labels; of several minimal cuts
    the one with the fewest nodes on the source side.

    Blocks hang together as a chain with one more edge to an earlier sibling, so nearly all have at most two open neighbours.
    Such a node is eliminated exactly: its best cost for each labelling of its neighbours becomes a score or an edge of
    theirs, and its label follows from theirs in the end.  Every elimination takes constant time.  Costs stay submodular, so
    what is left over, where blocks cross in more ways, is solved by max-flow.
    """
    n = len(scores)
    off, on = [max(s, 0.0) for s in scores], [max(-s, 0.0) for s in scores]  # costs of the labels False and True
    near: list[dict[int, tuple[float, float, float, float]]] = [{} for _ in range(n)]  # costs of (own, other) label pairs

    def tie(a: int, b: int, t: tuple[float, float, float, float]) -> None:
        u = near[a].get(b, (0.0, 0.0, 0.0, 0.0))
        t = (u[0] + t[0], u[1] + t[1], u[2] + t[2], u[3] + t[3])
        near[a][b], near[b][a] = t, (t[0], t[2], t[1], t[3])

    for a, b, w in edges:
        if w > 0 and a != b:
            tie(a, b, (0.0, w, w, 0.0))
    gone, order = [False] * n, []
    queue = deque(i for i in range(n) if len(near[i]) <= 2)
    while queue:
        i = queue.popleft()
        if gone[i] or len(near[i]) > 2:
            continue
        gone[i] = True
        ties = list(near[i].items())
        order.append((i, off[i], on[i], ties))
        for j, _ in ties:
            del near[j][i]
        if len(ties) == 1:
            j, t = ties[0]
            off[j] += min(off[i] + t[0], on[i] + t[2])
            on[j] += min(off[i] + t[1], on[i] + t[3])
        elif ties:
            (j, t), (k, u) = ties
            tie(j, k, tuple(min(off[i] + t[x] + u[y], on[i] + t[2 + x] + u[2 + y]) for x in (0, 1) for y in (0, 1)))
        queue.extend(j for j, _ in ties if len(near[j]) <= 2)
    label = [False] * n
    core = [i for i in range(n) if not gone[i]]
    if core:
        for i in _flow(core, off, on, near):
            label[i] = True
    for i, without, with_, ties in reversed(order):
        for j, t in ties:
            without += t[label[j]]
            with_ += t[2 + label[j]]
        label[i] = with_ < without - EVEN
    return label


def _flow(core: list[int], off: list[float], on: list[float], near: list[dict]) -> set[int]:
    """The nodes on the source side of the smallest minimum cut, by blocking flows."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: {} for i in (*core, source, sink)}
    gain = {i: off[i] - on[i] for i in core}  # what the label True saves
    for i in core:
        for j, (a, b, c, d) in near[i].items():
            if i < j:  # a + (c - a) x + (d - c) y + (b + c - a - d) (1 - x) y
                gain[i] -= c - a
                gain[j] -= d - c
                room[j][i], room[i][j] = room[j].get(i, 0.0) + b + c - a - d, room[i].get(j, 0.0)
    for i, g in gain.items():
        a, b = (source, i) if g > 0 else (i, sink)
        room[a][b], room[b][a] = abs(g), 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, c in room[a].items():
                if c > EVEN and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return set(level) - {source}
        turns = {a: list(room[a]) for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                flow = min(room[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    room[x][y] -= flow
                    room[y][x] += flow
                path = path[: next(k for k in range(1, len(path)) if room[path[k - 1]][path[k]] <= EVEN)]
                continue
            while turns[a] and not (room[a][turns[a][-1]] > EVEN and level.get(turns[a][-1], 0) == level[a] + 1):
                turns[a].pop()
            if turns[a]:
                path.append(turns[a][-1])
            else:
                path.pop()
                if path:
                    turns[path[-1]].pop()


def labelled(page: str | None) -> tuple[list[Block], list[float], list[bool]]:
    """The blocks of a page, their scores, and whether the cut leaves them on the side of the content."""
    blocks, nodes = parsed(page or "")
    _judge(nodes, blocks)
    scores = [score(b) for b in blocks]
    return blocks, scores, minimum_cut(scores, smoothness(blocks))


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text, blocks, blocks of content) of a page."""
    blocks, _, keep = labelled(page)
    return " ".join(b.text for b, k in zip(blocks, keep) if k), len(blocks), sum(keep)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, url, text, n_chars, n_blocks, n_content of every page."""

    def make(b: pa.RecordBatch) -> dict:
        found = [main_text(p) for p in b["_html"].to_pylist()]
        return {"text": [f[0] for f in found], "n_chars": [len(f[0]) for f in found], "n_blocks": [f[1] for f in found], "n_content": [f[2] for f in found]}

    rows = pages.select(pages[id], pages[url], F.col(html).cast("string").alias("_html"))
    return with_columns(rows, ("_html",), "text string, n_chars long, n_blocks long, n_content long", make)
