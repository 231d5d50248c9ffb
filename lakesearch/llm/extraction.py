"""Main text of web pages by minimum-cut labelling.

Method. A page is cut into blocks of text, each with the elements around it. A classifier gives every
block a cost of being boilerplate and one of being content; these are the capacities of its edges to
the two terminals. Neighbours in the page are joined by smoothness edges, stronger the more of their
DOM path they share, and so is each block with the last one before it in the same container. The
minimum cut then labels all blocks at once: a short or odd block follows its surroundings, unless its
own evidence is stronger.

Markup is read from left to right and never twice: a tag, an attribute or a raw text that does not end
takes the rest of the page, as in a browser.
"""

import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p "
    "pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend summary".split())
#: An element that ends an open one of the same line, up to the nearest of the scopes.
SAME_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("ul ol menu dl table select article section main div body html aside nav".split())
UNSEEN = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video textarea".split()
)
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements that `/>` ends; on others it means nothing, unless it is an unknown element.
FOREIGN = frozenset("svg math".split())
BOILERPLATE = frozenset("nav footer aside form menu button select dialog search fieldset label".split())
#: Elements that hold the page or the article, whatever they are called.
WHOLE = frozenset("html body main article".split())

_MARKUP = re.compile(r"<(?=[A-Za-z/!?])")
# Behind an equals sign a quoted value is taken whole. Nothing here gives back what it took.
_TAG = re.compile(
    r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>"
)
_ATTRIBUTE = re.compile(
    r"([^\s/>=\"'][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+"
)
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_WORDS = re.compile(r"[a-z]+|\d+")
#: Our choice: words in class, id and role attributes that speak for either label.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion nav "
    "navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer foot header masthead "
    "topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter "
    "signup login share sharing social related recommended more widget comment comments reply replies "
    "disqus respond form search pagination pager tags copyright legal contentinfo complementary".split()
)
#: Those of them that say what a part is even beside a word for content, as in post-comments.
TELLING_NAMES = frozenset("comment comments reply replies respond share sharing social related".split())
CONTENT_NAMES = frozenset("article content post entry story main text body".split())
#: First words of names that tell a state or a kind, not a part, as in has-sidebar.
STATE_NAMES = frozenset("has no with without is not category tag format type status layout single".split())
#: Headings of reader comments, in the languages of the other lists.
COMMENT_HEADS = re.compile(
    r"(?:\d+ )?(?:reader |user |leser)?(?:comments?|replies|responses|kommentare?|commentaires?|"
    r"comentarios?)(?: ?\(\d+\))?:?|leave a (?:reply|comment)|kommentar schreiben|"
    r"laisser un commentaire|deja un comentario",
    re.I,
)
#: Cost units.
STRONG, FAIR, WEAK = 60, 12, 4
#: A name that is one of the lists as a whole, one that holds such a word, and one beside a word for content;
#: names weigh less by `FAR` for every element between them and the text. A long paragraph of an article
#: with its neighbours outweighs each of them.
NAMED, PARTLY, HARDLY, FAR = 36, 24, 6, 2
NEAR, KIN = 3, 5


class Block:
    """A piece of text: the element and the parent it is in, how many block elements are around it, and
    how many of them it shares with the block before."""

    __slots__ = ("text", "tag", "parent", "depth", "shared", "linked", "bad", "good")

    def __init__(self, text, tag, parent, depth, shared, linked, bad, good):
        self.text, self.tag, self.parent, self.depth, self.shared = text, tag, parent, depth, shared
        self.linked, self.bad, self.good = linked, bad, good


class _Node:
    """An open element, with what it has from those around it."""

    __slots__ = (
        "tag", "number", "bad", "pull", "good", "unseen", "link", "comments", "depth", "block", "above",
        "scope",
    )

    def __init__(self, tag, number, place, up=None, marks=(0, 0, 0, False)):
        bad, named, good, unseen = marks
        is_block = tag in BLOCK
        self.tag, self.number = tag, number
        self.bad = max(bad, up.bad) if up else bad
        # Names weigh less from one block element to the next.
        self.pull = max(named, up.pull - FAR * is_block) if up else named
        self.good = max(good, up.good) if up else good
        self.unseen = unseen or bool(up and up.unseen)
        self.link = tag == "a" or bool(up and up.link)
        self.comments = bool(up and up.comments)
        self.depth = (up.depth if up else 0) + is_block
        self.block = self if is_block or up is None else up.block
        self.above = (up.block if is_block else up.above) if up else self
        self.scope = place if tag in SCOPES or up is None else up.scope


def _name_cost(name: str) -> int:
    """What one class, id or role says against content."""
    words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    if not words or words[0] in STATE_NAMES and len(words) > 1:
        return 0
    hits = BOILERPLATE_NAMES.intersection(words)
    if not hits:
        return 0
    if hits & TELLING_NAMES or all(w in BOILERPLATE_NAMES or w.isdigit() for w in words):
        return NAMED
    return HARDLY if CONTENT_NAMES.intersection(words) else PARTLY


def _marks(tag: str, attributes: str) -> tuple[int, int, int, bool]:
    """Evidence of an element's tag and names against content, evidence for it, and whether it is
    never shown."""
    bad = STRONG if tag in BOILERPLATE else FAIR if tag == "header" else 0
    good = FAIR if tag in ("article", "main") else 0
    named, unseen = 0, tag in UNSEEN
    if attributes.strip():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape(value.strip("\"'"))
            if name == "hidden" and value.lower() != "until-found":
                unseen = True
            elif name == "aria-hidden":
                unseen |= value.strip().lower() == "true"
            elif name == "style":
                unseen |= "display:none" in value.lower().replace(" ", "")
            elif name in ("class", "id", "role") and tag not in WHOLE:
                for one in value.split():
                    cost = _name_cost(one)
                    named = max(named, cost)
                    if not cost and CONTENT_NAMES.intersection(_WORDS.findall(one.lower())):
                        good = max(good, WEAK)
    return bad, named, good, unseen


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start and end of every piece of markup, with slash, name and attributes of tags; comments and
    the like have no name. Raw text belongs to the piece of its start tag."""
    at, size = 0, len(page)
    while (found := _MARKUP.search(page, at)) is not None:
        start = found.start()
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        tag = _TAG.match(page, start)
        if tag is None:
            if page[start + 1].isalpha() or page[start + 1] == "/" and page[start + 2 : start + 3].isalpha():
                at = size  # a tag that does not end
            else:
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            yield start, at, "", "", ""
            continue
        slash, name, attributes = tag[1], tag[2].lower(), tag[3]
        at = tag.end()
        if not slash and name in RAW:
            end = _RAW_ENDS[name].search(page, at)
            at = size if end is None else end.start()
        yield start, at, slash, name, attributes


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order."""
    found: list[Block] = []
    stack = [_Node("", 0, 0)]
    # Where in the stack the open elements of a name are.
    places: defaultdict[str, list[int]] = defaultdict(list)
    numbers = linked = lowest = at = 0
    text: list[str] = []

    def flush() -> None:
        nonlocal text, linked, lowest
        words = " ".join(html.unescape("".join(text)).split()) if text else ""
        if words:
            top = stack[-1]
            if top.block.tag in HEADINGS and COMMENT_HEADS.fullmatch(words):
                top.block.comments = top.block.above.comments = True
            found.append(
                Block(
                    words,
                    top.block.tag,
                    top.block.above.number,
                    top.depth,
                    min(lowest, top.depth),
                    min(1.0, linked / len(words)),
                    max(top.bad, top.pull, PARTLY if top.block.comments else 0),
                    top.good,
                )
            )
            lowest = top.depth
        text, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1].unseen:
            text.append(piece)
            if stack[-1].link:
                linked += len(piece)

    def close(keep: int) -> None:
        nonlocal lowest
        if stack[-1].depth > stack[keep - 1].depth:
            flush()
        for node in stack[keep:]:
            places[node.tag].pop()
        del stack[keep:]
        lowest = min(lowest, stack[-1].depth)

    for start, end, slash, tag, attributes in _tags(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        if slash:
            if places[tag]:
                close(places[tag][-1])
            continue
        if tag in RAW:
            continue
        if tag in CLOSES_P or tag in SAME_ENDS:
            ends = [*SAME_ENDS.get(tag, ()), *(["p"] if tag in CLOSES_P else [])]
            last = max((places[t][-1] for t in ends if places[t]), default=0)
            if last > stack[-1].scope:
                close(last)
        if tag in BLOCK:
            flush()
        if tag == "br":
            add(" ")
        closed = attributes.rstrip().endswith("/")
        if tag in VOID or closed and (tag in FOREIGN or stack[-1].unseen):
            continue
        numbers += 1
        places[tag].append(len(stack))
        stack.append(_Node(tag, numbers, len(stack), stack[-1], _marks(tag, attributes)))
    add(page[at:])
    flush()
    return found


def costs(block: Block) -> tuple[int, int]:
    """Capacity from the content terminal, and to the boilerplate terminal."""
    words = block.text.count(" ") + 1
    content = block.good + min(FAIR, words // 4)
    if block.tag in ("p", "h1", "h2", "h3", "blockquote", "pre"):
        content += WEAK
    if block.text[-1] in ".!?…:;\"”»":
        content += 2
    boilerplate = block.bad + round(2 * FAIR * max(0.0, block.linked - 0.25))
    if words < 5:
        boilerplate += 2
    if block.text[0] in "©":
        boilerplate += FAIR
    return content, boilerplate


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness: each block with the one before, by their common elements, and with the last one in
    the same parent."""
    joined = []
    last_of: dict[int, int] = {}
    for k, block in enumerate(found):
        if k:
            depth = max(found[k - 1].depth, block.depth, 1)
            joined.append((k - 1, k, NEAR * block.shared // depth))
        if block.parent in last_of:
            joined.append((last_of[block.parent], k, KIN))
        last_of[block.parent] = k
    return [e for e in joined if e[2] > 0]


def minimum_cut(
    source: list[int], sink: list[int], edges: list[tuple[int, int, int]]
) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut (the largest such side's complement is
    the sink's: what no longer reaches the sink counts as content).

    Shortest augmenting paths in levels. What flows straight through a node is taken off first.
    """
    n = len(source)
    s, t = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, there: int, back: int) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(there)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for k in range(n):
        through = min(source[k], sink[k])
        if source[k] > through:
            join(s, k, source[k] - through, 0)
        elif sink[k] > through:
            join(k, t, sink[k] - through, 0)
    for a, b, capacity in edges:
        join(a, b, capacity, capacity)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue and level[t] < 0:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[cut] ^ 1]
                del path[cut:]
            while turn[a] < len(heads[a]):
                e = heads[a][turn[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(heads[a]):
                path.append(heads[a][turn[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
    # Backwards from the sink over edges with room: these nodes are boilerplate.
    lost = [False] * (n + 2)
    lost[t] = True
    queue = deque([t])
    while queue:
        b = queue.popleft()
        for e in heads[b]:
            a = to[e]
            if room[e ^ 1] and not lost[a]:
                lost[a] = True
                queue.append(a)
    return [not lost[k] for k in range(n)]


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    capacities = [costs(b) for b in found]
    kept = minimum_cut([c for c, _ in capacities], [b for _, b in capacities], edges(found))
    return "\n\n".join(b.text for b, stays in zip(found, kept) if stays)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page, and one without content, gives an empty text. Unclosed elements end where
    HTML ends them, character references are decoded once, white space in a block is one blank, and
    blocks stand apart by an empty line. Other columns are ignored, repeated rows repeated, an empty
    table gives an empty result.
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["page_id", "url"]].copy()
            out["page_id"] = out["page_id"].astype("Int64")
            out["text"] = [main_text(p) for p in batch["html"]]
            out["n_chars"] = out["text"].str.len().astype("int64")
            yield out

    return pages.select("page_id", "url", "html").mapInPandas(
        texts, "page_id long, url string, text string, n_chars long"
    )
