"""HTML extraction as a reader sees the page: a tree builder with implied tags, visibility rules and a layout renderer.

The renderer emits all visible text: blocks on lines of their own with blank lines where margins are, lists with markers and
hanging indents, preformatted text as it stands, and tables with their cells aligned in columns (wide characters count twice).

Visibility is that of a screen SCREEN pixels wide: style elements and style attributes are read for `display` and `visibility`, with at-rules
(media queries of type and width, supports, layer), selectors of names, classes and ids joined as descendants or children, specificity, order and
`!important`. `display: none` hides a whole element; `visibility` is inherited, so that a visible child of a hidden element is shown. Selectors and
queries of other forms apply to nothing: what a query asks of a feature that is not known here is neither so nor not so, and rules that hang on it
are left out. Of svg the text elements are shown, of math everything but annotations.

Defined cases: null and empty pages give an empty text; broken markup is repaired as browsers do (open elements are closed by
what cannot stand inside them, end tags without a start are ignored, what stands in a row outside its cells goes before the table; a quote opens
a value only right after an equals sign, elsewhere it is part of a name or value; a tag or quoted value that never ends takes the rest of the page with it); as in browsers,
elements nested deeper than MAX_DEPTH become siblings, whose text is kept, and spans reach at most MAX_COLUMNS and MAX_ROWS; page_ids may repeat, each row is
rendered; other columns are ignored; an empty table gives an empty result. Pages of any length are rendered whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, GAP, SCREEN = 512, 2, 1280
#: Fixed values of HTML: a cell's greatest spans.
MAX_COLUMNS, MAX_ROWS = 1000, 65534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
UNSEEN = frozenset("head script style template noscript noframes iframe object audio video canvas datalist title desc defs annotation annotation-xml meta link base area map param source track rp".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption xmp".split()
)
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre xmp table figure fieldset hr".split())
LISTS = frozenset("ul ol menu dir".split())
CLOSES_P = BLOCK - frozenset("html body option optgroup caption td th tr tbody thead tfoot".split())
#: A start tag closes open elements of these names, up to a boundary.
IMPLIED = {
    "li": ({"li"}, LISTS | {"table", "td", "th"}),
    "dt": ({"dt", "dd"}, frozenset({"dl", "table", "td", "th"})),
    "dd": ({"dt", "dd"}, frozenset({"dl", "table", "td", "th"})),
    "option": ({"option"}, frozenset({"select", "datalist"})),
    "optgroup": ({"option", "optgroup"}, frozenset({"select"})),
    "td": ({"td", "th"}, frozenset({"table"})),
    "th": ({"td", "th"}, frozenset({"table"})),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, frozenset({"table"})),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, frozenset({"table"})),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, frozenset({"table"})),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, frozenset({"table"})),
    "body": ({"head"}, frozenset()),
}
SCOPE = frozenset("table td th caption html button template".split())

#: A comment, a section of character data, another declaration, or the start of a tag: what follows its name is read by _tag.
MARKUP = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|/>|/[^A-Za-z>][^>]*(?:>|\Z)|(/?)([A-Za-z][^ \t\n\r\f/>]*))", re.S)
BETWEEN = re.compile(r"[ \t\n\r\f/]*")
NAME = re.compile(r"=?[^ \t\n\r\f/>=]*")
EQUALS = re.compile(r"[ \t\n\r\f]*=[ \t\n\r\f]*")
UNQUOTED = re.compile(r"[^ \t\n\r\f>]*")
#: What may stand in a head; anything else ends it.
HEAD = frozenset("head title base link meta script style noscript template bgsound basefont".split())
BRACES = re.compile(r"\"[^\"]*\"|'[^']*'|[{};]")
COMPOUND = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)", re.I)
#: Display values and properties that screens are taken to know in @supports.
DISPLAYS = frozenset("none inline block inline-block flex inline-flex grid inline-grid table table-row table-cell list-item contents flow-root".split())
PROPERTIES = frozenset("color position float margin padding width height opacity visibility transform transition animation gap flex object-fit grid-template-columns".split())
WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([0-9.]+)(px|em|rem)\s*\)")
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


def _tag(source: str, at: int) -> tuple[dict[str, str], int] | None:
    """The attributes that begin at a place of a tag, and where the tag ends; None if the page ends first. Of attributes of one name the first counts."""
    out: dict[str, str] = {}
    while True:
        at = BETWEEN.match(source, at).end()
        if at == len(source):
            return None
        if source[at] == ">":
            return out, at + 1
        name = NAME.match(source, at)
        at, value = name.end(), ""
        if equals := EQUALS.match(source, at):
            at = equals.end()
            quote = source[at : at + 1]
            if quote in ("'", '"'):
                end = source.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = source[at + 1 : end], end + 1
            else:
                end = UNQUOTED.match(source, at).end()
                value, at = source[at:end], end
        out.setdefault(name[0].lower(), html.unescape(value))


def build(source: str) -> tuple[Node, list[str]]:
    """The element tree of a page, and the texts of its style elements."""
    root, styles = Node("html", {}), []
    stack, open_ = [root], Counter({"html": 1})

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_[stack.pop().tag] -= 1

    def close(names, boundary) -> None:
        """Close the outermost open element of names above the nearest boundary."""
        if not any(open_[n] for n in names):
            return
        found = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                found = k
            elif stack[k].tag in boundary:
                break
        if found is not None:
            pop_to(found)

    def text(data: str) -> None:
        if data:
            if stack[-1].tag == "head" and data.strip():
                pop_to(len(stack) - 1)
            stack[-1].children.append(data)

    at, size = 0, len(source)
    while at < size:
        m = MARKUP.search(source, at)
        if m is None:
            text(html.unescape(source[at:]))
            break
        text(html.unescape(source[at : m.start()]))
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag, read = m[2].lower(), _tag(source, at)
        if read is None:
            break
        attrs, at = read
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag not in ("html", "body") and open_[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
                    if stack[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                        break
            continue
        if tag == "html":
            root.attrs.update({k: v for k, v in attrs.items() if k not in root.attrs})
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if open_["head"] and tag not in HEAD:
            close({"head"}, frozenset())
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and open_["table"] and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {}, stack[-1])
            stack[-1].children.append(row)
            stack.append(row)
            open_["tr"] += 1
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[ \t\n\r\f/>])|\Z", re.I).search(source, at)
            body = source[at : end.start()]
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            if tag == "style":
                styles.append(body)
            at = (_tag(source, end.end()) or ({}, size))[1]
        elif tag not in VOID and len(stack) < MAX_DEPTH:
            stack.append(node)
            open_[tag] += 1
    return root, styles


def media_matches(query: str) -> bool:
    """Whether one of the queries of a list holds for a screen SCREEN pixels wide."""

    def part(text: str) -> bool | None:
        if not text.startswith("("):
            return text in ("all", "screen")
        m = WIDTH.fullmatch(text)
        if not m or not re.fullmatch(r"[0-9]*\.?[0-9]+", m[2]):
            return None
        pixels = float(m[2]) * (1 if m[3] == "px" else 16)
        return SCREEN >= pixels if m[1] == "min" else SCREEN <= pixels

    def one(q: str) -> bool:
        q, turned = q.removeprefix("only "), False
        if q.startswith("not "):
            q, turned = q[4:], True
        said = [part(x) for x in re.split(r"\s+and\s+", q) if x]
        holds = False if False in said else None if None in said else True
        return holds is not None and holds != turned

    return any(one(" ".join(q.lower().split())) for q in query.split(","))


def supports(condition: str) -> bool:
    """Whether a condition of @supports is known to hold: tests in brackets, one of them or several joined by one word."""

    def known(test: str) -> bool:
        name, _, value = (x.strip() for x in test.partition(":"))
        return bool(value) and (name.startswith("--") or name in PROPERTIES or (name == "display" and value in DISPLAYS))

    text = " ".join(condition.lower().split())
    tests = [known(x) for x in re.findall(r"\(([^()]*)\)", text)]
    shape = re.sub(r"\([^()]*\)", "x", text)
    return bool(tests) and ((all(tests) and re.fullmatch(r"x( and x)*", shape) is not None) or (any(tests) and re.fullmatch(r"x( or x)*", shape) is not None))


def declarations(body: str) -> dict[str, tuple[bool, str]]:
    """(important, value) of display and visibility in a list of declarations; of equals the last one."""
    out: dict[str, tuple[bool, str]] = {}
    for part in body.split(";"):
        name, _, value = part.partition(":")
        name = name.strip().lower()
        if name in ("display", "visibility"):
            value, _, mark = value.partition("!")
            now = (mark.strip().lower() == "important", " ".join(value.lower().split()))
            if now[1] and now[0] >= out.get(name, (False, ""))[0]:
                out[name] = now
    return out


def selector(text: str) -> tuple[tuple, tuple[int, int, int]] | None:
    """Compounds (name, ids, classes, joined to what stands before as a child), last first, and the specificity; None for other forms."""
    parts, child, counts = [], False, [0, 0, 0]
    for token in text.replace(">", " > ").split():
        if token == ">":
            child = True
            continue
        m = COMPOUND.fullmatch(token)
        if not m:
            return None
        marks = re.findall(r"[.#][\w-]+", m[2])
        ids, names = frozenset(x[1:] for x in marks if x[0] == "#"), frozenset(x[1:] for x in marks if x[0] == ".")
        name = "" if m[1] in (None, "*") else m[1].lower()
        parts.append((name, ids, names, child))
        counts = [counts[0] + len(ids), counts[1] + len(names), counts[2] + bool(name)]
        child = False
    return (tuple(reversed(parts)), tuple(counts)) if parts and not child else None


def style_rules(styles: list[str]) -> list[tuple[tuple, tuple, dict]]:
    """(compounds, (specificity, order), declarations) of the rules that say something about display or visibility."""
    found = []
    for sheet in styles:
        sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)
        at, size = 0, len(sheet)

        def block_end(at: int, sheet: str = sheet) -> int:
            depth = 1
            for m in BRACES.finditer(sheet, at):
                depth += (m[0] == "{") - (m[0] == "}")
                if not depth:
                    return m.start()
            return len(sheet)

        while at < size:
            m = BRACES.search(sheet, at)
            while m and m[0][0] in "\"'":
                m = BRACES.search(sheet, m.end())
            if not m:
                break
            prelude, at = sheet[at : m.start()].strip(), m.end()
            if m[0] != "{":  # the end of a statement, or of a group whose rules were read
                continue
            if prelude.startswith("@"):
                name, _, rest = prelude[1:].partition(" ") if "(" not in prelude.split(" ")[0] else (prelude[1:].split("(")[0], "", "(" + prelude.split("(", 1)[1])
                name = name.lower()
                if not (name == "layer" or (name == "media" and media_matches(rest)) or (name == "supports" and supports(rest))):
                    at = block_end(at) + 1
                continue
            end = block_end(at)
            body = sheet[at:end]
            at = end + 1
            if "{" in body:  # nested rules are left out
                body = re.sub(r"[^{};]*\{[^{}]*\}", ";", body)
            if said := declarations(body):
                for text in prelude.split(","):
                    if one := selector(text):
                        found.append((one[0], (one[1], len(found)), said))
    return found


def _is(node: Node, compound: tuple) -> bool:
    name, ids, names, _ = compound
    return (not name or node.tag == name) and (not ids or ids == {node.attrs.get("id", "")}) and (not names or names <= set(node.attrs.get("class", "").split()))


def _matches(node: Node, parts: tuple) -> bool:
    """Whether a node is what the compounds, last first, describe."""
    reached = [node] if _is(node, parts[0]) else []
    for k in range(1, len(parts)):
        child, above = parts[k - 1][3], {}
        for one in reached:
            up = one.parent
            while up is not None and id(up) not in above:
                if _is(up, parts[k]):
                    above[id(up)] = up
                if child:
                    break
                up = up.parent
        reached = list(above.values())
    return bool(reached)


def show(root: Node, rules: list[tuple[tuple, tuple, dict]]) -> None:
    """Leave in the tree only what is visible."""
    by: dict[str, list] = {}
    for rule in rules:
        name, ids, names, _ = rule[0][0]
        by.setdefault(f"#{min(ids)}" if ids else f".{min(names)}" if names else name, []).append(rule)

    def said(node: Node) -> dict[str, str]:
        best: dict[str, tuple] = {}
        if by:
            keys = ["", node.tag, f"#{node.attrs.get('id', '')}", *(f".{c}" for c in set(node.attrs.get("class", "").split()))]
            for parts, rank, said_ in (r for k in keys for r in by.get(k, ())):
                if _matches(node, parts):
                    for prop, (important, value) in said_.items():
                        best[prop] = max(best.get(prop, ((False,),)), ((important, 0, *rank), value))
        if "style" in node.attrs:
            for prop, (important, value) in declarations(node.attrs["style"]).items():
                best[prop] = max(best.get(prop, ((False,),)), ((important, 1), value))
        return {prop: x[1] for prop, x in best.items()}

    order: list[tuple[Node, bool]] = []
    steps = [(root, True)]
    while steps:
        node, shown = steps.pop()
        order.append((node, shown))
        if node.tag == "svg":
            node.children = _svg_texts(node)
        left = []
        for c in node.children:
            if isinstance(c, str):
                if shown:
                    left.append(c)
                continue
            if c.tag in UNSEEN or (c.tag == "input" and c.attrs.get("type", "").lower() not in ("submit", "reset", "button")):
                continue
            own = said(c)
            display = own.get("display", "none" if "hidden" in c.attrs or (c.tag == "dialog" and "open" not in c.attrs) else "")
            if display == "none":
                continue
            left.append(c)
            value = own.get("visibility", "inherit")
            steps.append((c, value == "visible" if value in ("visible", "hidden", "collapse") else shown))
        node.children = left
    kept = {id(node) for node, shown in order if shown}
    for node, _ in reversed(order):  # hidden elements without visible ones in them go; cells keep their place
        node.children = [c for c in node.children if isinstance(c, str) or c.children or id(c) in kept or c.tag in ("td", "th")]


def _svg_texts(svg: Node) -> list[Node]:
    """The text elements of a drawing, each as a word of its own."""
    found, todo = [], [c for c in reversed(svg.children) if isinstance(c, Node)]
    while todo:
        node = todo.pop()
        if node.tag in ("text", "foreignobject"):
            found += [node, Node("wbr", {}, svg), " "]
        elif node.tag not in UNSEEN:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return [" ", *found] if found else []


def text_width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Layout:
    """Renders a tree of visible nodes to lines."""

    def lines(self, nodes: list) -> list[str]:
        """Lines of a flow of nodes. Open and close steps lie on an explicit stack, so that depth costs no recursion."""
        out: list[str] = []
        line: list[str] = []
        space, gap, pre = False, 0, 0  # pending space; pending line ends; depth of preformatted elements
        indent, marker = [""], [""]
        lists: list[list] = []

        def flush() -> None:
            nonlocal line, space, gap
            if line:
                if gap > 1 and out:
                    out.append("")
                out.append(((marker[0] or indent[-1]) + "".join(line)).rstrip(" "))
                marker[0] = ""
                line, gap = [], 0
            space = False

        def put(data: str) -> None:
            nonlocal space
            if space and line:
                line.append(" ")
            space = False
            line.append(data)

        def block(margin: bool) -> None:
            nonlocal gap
            flush()
            gap = max(gap, 2 if margin else 1)

        steps: list = [(n, True) for n in reversed(nodes)]
        while steps:
            node, opening = steps.pop()
            if isinstance(node, str):
                if pre:
                    for k, piece in enumerate(node.split("\n")):
                        if k:
                            if not line:
                                if out and gap < 2:
                                    out.append("")
                            else:
                                flush()
                        if piece:
                            line.append(piece)
                    continue
                words = BLANKS.split(node)
                for k, w in enumerate(words):
                    if k and line:
                        space = True
                    if w:
                        put(w)
                continue
            tag = node.tag
            margin = tag in MARGIN and not (tag in LISTS and lists)
            if not opening:
                if tag in ("pre", "xmp"):
                    pre -= 1
                if tag in BLOCK:
                    block(margin if tag not in LISTS else len(lists) <= 1)
                if tag == "li":
                    if marker[0] and not line:  # an empty item
                        line.append("")
                        flush()
                        gap = 1
                    indent.pop()
                elif tag in ("blockquote", "dd"):
                    indent.pop()
                elif tag in LISTS and lists:
                    lists.pop()
                elif tag == "q":
                    put('"')
                continue
            if tag == "br":
                if line:
                    flush()
                elif out:
                    gap = 2
            elif tag == "hr":
                block(True)
                line.append("---")
                block(True)
            elif tag == "input":
                put(BLANKS.sub(" ", node.attrs.get("value", "")).strip() or node.attrs["type"].capitalize())
            elif tag == "wbr" or tag == "img":
                pass
            elif tag == "table":
                block(True)
                for row in self.table(node):
                    line.append(row)
                    if not row:
                        out.append("")
                        line.clear()
                    flush()
                block(True)
            else:
                if tag in BLOCK:
                    block(margin)
                if tag in ("pre", "xmp"):
                    pre += 1
                    if node.children and isinstance(node.children[0], str):
                        node.children[0] = node.children[0].removeprefix("\n")
                if tag in LISTS:
                    back = tag == "ol" and "reversed" in node.attrs
                    items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
                    lists.append([tag == "ol", _number(node.attrs.get("start"), items if back else 1), -1 if back else 1])
                elif tag == "li":
                    own = lists[-1] if lists else [False, 1, 1]
                    own[1] = _number(node.attrs.get("value"), own[1])
                    sign = f"{own[1]}. " if own[0] else "- "
                    own[1] += own[2]
                    marker[0] = (marker[0] or indent[-1]) + sign
                    indent.append(indent[-1] + " " * len(sign))
                elif tag in ("blockquote", "dd"):
                    indent.append(indent[-1] + "  ")
                elif tag == "q":
                    put('"')
                if tag == "details" and "open" not in node.attrs:
                    shown = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
                else:
                    shown = node.children
                steps.append((node, False))
                steps.extend((c, True) for c in reversed(shown))
        flush()
        while out and not out[-1]:
            out.pop()
        return out

    def table(self, table: Node) -> list[str]:
        """Lines of a table: columns as wide as their widest cell, cells of spanned columns over all of them."""
        top, rows = [], []
        todo = list(reversed(table.children))
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                if child.strip():
                    top.append(child)
            elif child.tag in ("tbody", "thead", "tfoot"):
                todo += reversed(child.children)
            elif child.tag == "tr":
                cells, inner = [], list(reversed(child.children))
                while inner:  # what stands in a row outside its cells goes before the table; what wraps cells there is looked through
                    c = inner.pop()
                    if isinstance(c, Node) and c.tag in ("td", "th"):
                        cells.append(c)
                    elif isinstance(c, Node) and c.tag != "table" and _holds_cells(c):
                        inner += reversed(c.children)
                    elif isinstance(c, Node) or c.strip():
                        top.append(c)
                rows.append(cells)
            elif child.tag not in ("colgroup", "col"):
                top.append(child)
        grid: list[list[tuple[int, int, list[str], str]]] = []
        taken: dict[int, int] = {}  # column -> rows that a cell from above still covers
        for cells in rows:
            placed, col = [], 0
            for cell in cells:
                while taken.get(col, 0) > 0:
                    col += 1
                wide = _span(cell.attrs.get("colspan"), MAX_COLUMNS)
                style = cell.attrs.get("align", "").lower() or (re.search(r"text-align\s*:\s*(\w+)", cell.attrs.get("style", ""), re.I) or ["", ""])[1].lower()
                placed.append((col, wide, self.lines(cell.children), style))
                for c in range(col, col + wide):
                    taken[c] = max(taken.get(c, 0), _span(cell.attrs.get("rowspan"), MAX_ROWS))
                col += wide
            for c in list(taken):
                taken[c] -= 1
            grid.append(placed)
        width: dict[int, int] = {}
        for placed in grid:
            for col, wide, text, _ in placed:
                if wide == 1:
                    width[col] = max(width.get(col, 0), *(text_width(t) for t in text), 0) if text else width.get(col, 0)
        for placed in grid:
            for col, wide, text, _ in placed:
                have = sum(width.get(c, 0) for c in range(col, col + wide)) + GAP * (wide - 1)
                need = max((text_width(t) for t in text), default=0)
                if need > have:
                    width[col + wide - 1] = width.get(col + wide - 1, 0) + need - have
        left, edge = {}, 0
        for c in range(max(width, default=-1) + 1):
            left[c] = edge
            edge += width.get(c, 0) + (GAP if width.get(c, 0) else 0)
        out = self.lines(top) if top else []
        for placed in grid:
            for k in range(max((len(t) for _, _, t, _ in placed), default=0)):
                line = ""
                for col, wide, text, style in placed:
                    if k < len(text):
                        room = sum(width.get(c, 0) + (GAP if width.get(c, 0) else 0) for c in range(col, col + wide)) - GAP
                        spare = max(0, room - text_width(text[k]))
                        cell = " " * (spare if style == "right" else spare // 2 if style == "center" else 0) + text[k]
                        line += " " * max(0, left.get(col, 0) - text_width(line)) + cell
                out.append(line.rstrip(" "))
        return out


def _holds_cells(node: Node) -> bool:
    """Whether cells stand below a node before any table does."""
    todo = [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node) and c.tag in ("td", "th"):
                return True
            if isinstance(c, Node) and c.tag != "table":
                todo.append(c)
    return False


def _span(value: str | None, most: int) -> int:
    """A span as HTML reads it: leading digits, one if there are none; a rowspan of 0 reaches to the last row."""
    digits = re.match(r"[ \t\n\r\f]*\+?([0-9]{1,9})", value or "")
    found = int(digits[1]) if digits else 1
    return min(found or (most if most == MAX_ROWS else 1), most)


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", value) else default


def render(source: str | None) -> str:
    """Visible text of a page."""
    if not source:
        return ""
    root, styles = build(source)
    show(root, style_rules(styles))
    return "\n".join(Layout().lines([root]))


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [render(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines of every row of pages(page_id, url, html)."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rendered = plain.mapInArrow(_render, "page_id long, url string, text string")
    lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    return rendered.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
