"""Text of web pages as a layout shows it.

A tree builder supplies the end tags that HTML lets authors leave out and ignores those that close
nothing. A walk over the tree then drops what is not displayed, by element, attribute or style rule,
and writes the rest: blocks on lines of their own, paragraphs apart, list items with their marks, table
cells padded to columns, also where cells span several rows or columns or hold tables themselves.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("rp head script style template title noscript iframe noembed noframes datalist object audio video canvas meta link".split())
#: Not displayed inside of these elements.
HIDDEN_IN = {"svg": frozenset("defs desc metadata symbol clippath mask pattern marker".split()), "math": frozenset("annotation annotation-xml".split())}
BLOCK = frozenset("address article aside body center details dialog dd div dl dt fieldset figcaption figure footer form header hgroup html legend main nav option search section select summary li tr caption tbody thead tfoot".split())
APART = frozenset("blockquote h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
CLOSES_P = BLOCK - {"option", "select", "tr", "caption", "tbody", "thead", "tfoot", "legend", "body", "html"} | APART
#: An opening tag closes these open elements, up to a border.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
}
TABLE_PARTS = frozenset("table tr td th tbody thead tfoot caption body html".split())
BORDER = frozenset(("table", "td", "th", "caption", "button", "body", "html", "template"))

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
#: A tag behind its name, up to its > or the end of the page: a value is quoted only behind =, and an open quote that never closes is none.
_TAG_REST = re.compile(r"""(?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\r\f"'>][^ \t\n\r\f>]*+|(?=>|\Z)))?+)*+""")
_DISPLAY = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_SELECTOR = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)", re.I)
_COMBINED = re.compile(r"\s*(>)\s*|\s+")
#: Media queries are judged for a screen of so many pixels, a mouse, and no preferences.
VIEWPORT = {"width": 1280.0, "height": 800.0}
_FEATURE = re.compile(r"\(\s*(?:([\d.]+\w*)\s*(<=?)\s*)?(min-|max-)?(width|height)\s*(?:(:|<=?|>=?|=)\s*([\d.]+\w*))?\s*\)")
_MATCHING = {"orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference", "scripting": "enabled", "update": "fast"}
#: Pixels of a length's unit.
_PIXELS = {"px": 1.0, "": 1.0, "em": 16.0, "rem": 16.0, "pt": 4 / 3, "cm": 96 / 2.54, "mm": 96 / 25.4, "in": 96.0}
_BUTTON = frozenset(("submit", "button", "reset"))
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: Cells span so many columns and rows at most, as HTML has it.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None = None) -> None:
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up


class _Open:
    """The open elements, and at which depths those of each name are, so that no search walks through the stack."""

    def __init__(self, root: Node) -> None:
        self.stack, self.depths = [root], {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        """Close the element at this depth and all in it."""
        for node in self.stack[depth:]:
            self.depths[node.tag].pop()
        del self.stack[depth:]

    def last(self, tags: Iterable[str]) -> int:
        """The greatest depth of an open element of these names, 0 without one."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def close(self, tag: str) -> None:
        """Close the nearest open element of this name; a table's cell keeps inner end tags to itself."""
        depth = self.last((tag,))
        if depth and (tag in TABLE_PARTS or self.last(("td", "th", "caption")) <= depth):
            self.cut(depth)

    def close_within(self, tags: Iterable[str], border: Iterable[str]) -> None:
        """Close the outermost open element of these names that stands inside the border."""
        edge = self.last([t for t in border if t not in tags])
        inside = [d[i] for t in tags if (d := self.depths.get(t)) and (i := bisect_right(d, edge)) < len(d)]
        if inside:
            self.cut(min(inside))


def parse(html: str) -> tuple[Node, list[str]]:
    """The tree of a page and the texts of its style elements for the screen; never fails."""
    root = Node("#root", {})
    opened, styles = _Open(root), []
    at, n, last_end = 0, len(html), html.rfind(">")
    while at < n:
        mark = html.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            opened.stack[-1].kids.append(html[at:mark])
        at = mark
        if at >= n:
            break
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        if at > last_end:  # no tag can end here any more
            rest = html[at:]
            stop = re.search("<[!?]", rest)
            opened.stack[-1].kids.append(rest[: stop.start()] if stop else rest)
            break
        m = _NAME.match(html, at)
        if not m or m.end() > last_end:
            opened.stack[-1].kids.append("<")
            at += 1
            continue
        end = _TAG_REST.match(html, m.end()).end()  # the > outside of quotes; the page's end if all stand in quotes
        tag, closing = m[1].lower(), html[at + 1] == "/"
        inside, at = html[m.end() : end], end + 1
        if closing:
            opened.close(tag)
            continue
        attrs: dict[str, str] = {}
        for a in _ATTRIBUTE.finditer(inside) if inside.strip(" /") else ():
            attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")  # of repeated attributes the first counts
        if tag in CLOSES_P:
            opened.close_within(("p",), BORDER)
        if tag in IMPLIED:
            opened.close_within(*IMPLIED[tag])
        node = Node(tag, attrs, opened.stack[-1])
        opened.stack[-1].kids.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            node.kids.append(html[at : stop.start() if stop else n])
            if tag == "style" and media_applies(attrs.get("media", "")):
                styles.append(node.kids[0])
            if not stop:
                break
            end = html.find(">", stop.end())
            at = n if end < 0 else end + 1
        elif tag not in VOID and not inside.endswith("/"):
            opened.push(node)
    return root, styles


def _pixels(length: str) -> float | None:
    m = re.fullmatch(r"([\d.]+)(\w*)", length)
    return float(m[1]) * _PIXELS[m[2]] if m and m[2] in _PIXELS and m[1].count(".") < 2 and m[1] != "." else None


def _compares(a: float | None, sign: str, b: float | None) -> bool:
    if a is None or b is None:
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}.get(sign, a == b)


def _feature_applies(feature: str) -> bool:
    m = _FEATURE.fullmatch(feature)
    if m:
        size, ok = VIEWPORT[m[4]], True
        if m[1]:
            ok = _compares(_pixels(m[1]), m[2], size)
        if m[5]:
            sign = {"min-": ">=", "max-": "<="}.get(m[3], "=") if m[5] == ":" else m[5]
            ok = ok and _compares(size, sign, _pixels(m[6]))
        return ok
    name, _, value = feature.strip("() ").partition(":")
    return name.strip() == "color" and not value or _MATCHING.get(name.strip(), "") == value.strip() != ""


def media_applies(query: str) -> bool:
    """Whether a media query holds for VIEWPORT; of a list one must. Features that are not known do not apply, nor their negations."""
    for one in query.lower().split(",") if query.strip() else ("all",):
        words = re.findall(r"\([^()]*\)|[\w-]+", one)
        negated = words[:1] == ["not"]
        rest = words[1:] if words and words[0] in ("not", "only") else words
        kinds = [w for w in rest if w[0] != "(" and w not in ("and", "or")]
        features = [w for w in rest if w[0] == "("]
        known = all(_FEATURE.fullmatch(f) or f.strip("() ").partition(":")[0].strip() in (*_MATCHING, "color") for f in features) and "((" not in one.replace(" ", "")
        holds = [_feature_applies(f) for f in features]
        applies = all(k in ("all", "screen") for k in kinds) and (any(holds) if "or" in rest else all(holds))
        if known and applies != negated:
            return True
    return False


class Rules:
    """What style rules say about display and visibility.

    Selectors are names, classes and ids, also of several elements with a space or > between, which are matched from the right: the
    element first, then those around it. The more specific rule wins, then the later one; a style attribute wins over rules, and what
    is !important over what is not. Rules with other selectors (attributes, states, siblings) are not followed.
    """

    def __init__(self, styles: Iterable[str]) -> None:
        self.by_key: dict[str, list[tuple[tuple[int, int], list[tuple[str, str, frozenset[str]]], dict[str, tuple[bool, str]]]]] = {}
        number = 0
        for text in styles:
            for selectors, said in _blocks(_COMMENT.sub("", text)):
                for one in selectors.split(","):
                    steps = _steps(one.strip())
                    if steps:
                        number += 1
                        weight = sum(100 * sum(x[0] == "#" for x in marks) + 10 * sum(x[0] == "." for x in marks) + (tag != "*") for _, tag, marks in steps)
                        _, tag, marks = steps[0]
                        self.by_key.setdefault(min(marks, default=tag), []).append(((weight, number), steps, said))

    def of(self, node: Node) -> dict[str, str]:
        """display and visibility as far as they are set for the element itself."""
        fits = []
        if self.by_key:
            own = _marks(node)
            for k in (*own, node.tag, "*"):
                fits += [(w, said) for w, steps, said in self.by_key.get(k, ()) if _matches(node, steps)]
        said_in_order = [said for _, said in sorted(fits, key=lambda f: f[0])]
        if "style" in node.attrs:
            said_in_order.append(_said(node.attrs["style"]))
        out: dict[str, tuple[bool, str]] = {}
        for said in said_in_order:
            out |= {k: v for k, v in said.items() if v[0] or not out.get(k, v)[0]}
        return {k: v for k, (_, v) in out.items()}


def _marks(node: Node) -> set[str]:
    own = {"." + c for c in node.attrs.get("class", "").split()}
    if "id" in node.attrs:
        own.add("#" + node.attrs["id"])
    return own


def _steps(selector: str) -> list[tuple[str, str, frozenset[str]]]:
    """A selector from right to left: how each part is joined to the one on its right ("" for the last), its name and marks; empty if it is of another kind."""
    out, join = [], ""
    parts = _COMBINED.split(selector)  # part, ">" or None, part ...
    for i in range(len(parts) - 1, -1, -2):
        m = _SELECTOR.fullmatch(parts[i] or "")
        if not m or not m[0]:
            return []
        out.append((join, (m[1] or "*").lower(), frozenset(re.findall(r"[.#][\w-]+", m[2]))))
        join = (parts[i - 1] or " ") if i else ""
    return [] if len(out) == 1 and out[0][1:] == ("*", frozenset()) else out


def _matches(node: Node, steps: list[tuple[str, str, frozenset[str]]]) -> bool:
    """Whether the element, and elements around it, are those of the selector. A part joined by a space takes the nearest fit; before > that fit may have to move on."""
    fits = lambda x, s: s[1] in ("*", x.tag) and (not s[2] or s[2] <= _marks(x))
    if not fits(node, steps[0]):
        return False
    # places up to which each step has been tried, so that no element is looked at twice for one step
    spots, i = [node], 1
    while i < len(steps):
        join, at = steps[i][0], spots[i - 1].up
        while at is not None and at.up is not None and not fits(at, steps[i]):
            at = None if join == ">" else at.up
        if at is not None and at.up is not None:
            spots.append(at)
            i += 1
            continue
        # the latest part before that was joined by a space moves outward
        i -= 1
        while i > 0 and steps[i][0] == ">":
            i -= 1
            spots.pop()
        if i <= 0:
            return False
        at = spots.pop().up
        while at is not None and at.up is not None and not fits(at, steps[i]):
            at = at.up
        if at is None or at.up is None:
            return False
        spots.append(at)
        i += 1
    return True


def _said(declarations: str) -> dict[str, tuple[bool, str]]:
    """display and visibility: whether important, and the value."""
    out: dict[str, tuple[bool, str]] = {}
    for m in _DISPLAY.finditer(declarations):
        k, v = m[1].lower(), (bool(m[3]), m[2].lower())
        if v[0] or not out.get(k, v)[0]:
            out[k] = v
    return out


def _blocks(text: str) -> Iterator[tuple[str, dict[str, tuple[bool, str]]]]:
    """Selectors and what they say, of the rules that apply to VIEWPORT and speak of display or visibility."""
    at, skip = 0, 0  # how many blocks that do not apply are open
    while (m := re.compile(r"[{}]").search(text, at)) is not None:
        head = text[at : m.start()].rpartition(";")[2].strip()
        at = m.end()
        if m[0] == "}":
            skip = max(0, skip - 1)
        elif skip or head.startswith("@"):
            rule = re.match(r"@(media|supports|layer)\b(.*)", head, re.S)
            if skip or not rule or (rule[1] == "media" and not media_applies(rule[2])) or (rule[1] == "supports" and rule[2].strip().startswith("not")):
                skip += 1
        else:
            end = text.find("}", at)
            end = len(text) if end < 0 else end
            said = _said(text[at:end])
            if said:
                yield head, said
            at = end + 1


class _Writer:
    """Lines of text; spaces and blank lines between words and blocks are written only when something follows."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space, self.mark = 0, False, ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s == " ":
            self.space = True
        elif s:
            self._lead(s[0] == " ")
            self.parts.append(s.strip(" "))
            self.space = s[-1] == " "

    def verbatim(self, s: str) -> None:
        if s.strip("\n"):
            self._lead(False)
            self.parts.append(s.strip("\n"))

    def _lead(self, space: bool) -> None:
        if self.breaks and self.parts:
            self.parts.append("\n" * self.breaks)
        elif (self.space or space) and self.parts and not self.mark:
            self.parts.append(" ")
        if self.mark:
            self.parts.append(self.mark)
        self.breaks, self.space, self.mark = 0, False, ""

    def block(self, lines: int) -> None:
        self.breaks, self.space = max(self.breaks, lines), False

    def item(self, mark: str) -> None:
        self.block(1)
        self.mark = mark

    def done(self) -> str:
        return "".join(self.parts)


def columns_of(text: str) -> int:
    """Columns that a text takes: two for a wide character, none for one that is written over another."""
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


def _padded(text: str, size: int) -> str:
    return text + " " * max(0, size - columns_of(text))


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "").strip()
    n = int(value) if value.isdecimal() and len(value) < 10 else 1
    return min(n, most) or (most if name == "rowspan" else 1)


def layout(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """The lines of a table whose rows have cells (lines, columns, rows spanned); columns in which no cell begins take no room.

    A cell stands in the first column that cells from above leave free. Its text is in its first row; it
    is padded to the width of all columns that it spans.
    """
    placed: list[list[tuple[int, int, list[str]]]] = []
    until: dict[int, tuple[int, int]] = {}  # column: end row and end column of a cell from above
    for r, cells in enumerate(rows):
        column, row = 0, []
        for lines, wide, high in cells:
            while column in until and until[column][0] > r:
                column = until[column][1]
            row.append((column, column + wide, lines))
            if high > 1:
                for c in range(column, column + wide):
                    until[c] = r + high, column + wide
            column += wide
        placed.append(row)
    begins = sorted({c for row in placed for c, _, _ in row})
    number = {c: i for i, c in enumerate(begins)}
    width = [0] * len(begins)
    spread = []
    for row in placed:
        for c, end, lines in row:
            i, j, size = number[c], bisect_right(begins, end - 1), max(map(columns_of, lines), default=0)
            if j - i == 1:
                width[i] = max(width[i], size)
            else:
                spread.append((j - i, i, j, size))
    for _, i, j, size in sorted(spread):  # what a wide cell lacks goes to its last column
        width[j - 1] += max(0, size - sum(width[i:j]) - 3 * (j - i - 1))
    out = []
    for row in placed:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            parts, at = [], 0
            for c, end, lines in row:
                i, j = number[c], bisect_right(begins, end - 1)
                parts += [" " * width[x] for x in range(at, i)]
                parts.append(_padded(lines[k] if k < len(lines) else "", sum(width[i:j]) + 3 * (j - i - 1)))
                at = j
            out.append(" | ".join(parts).rstrip())
    return out


def render(root: Node, styles: Iterable[str] = ()) -> str:
    """The visible text of a tree, without recursion, so that deep trees are safe."""
    out, rules = _Writer(), Rules(styles)
    writers, tables, lists, pre = [], [], [], 0
    inside = dict.fromkeys(HIDDEN_IN, 0)
    seen = [True]  # visibility, which elements inherit and may set anew
    todo: list[tuple[Node | str, bool]] = [(root, True)]
    while todo:
        node, entering = todo.pop()
        if isinstance(node, str):
            if seen[-1]:
                (out.verbatim if pre else out.text)(unescape(node))
            continue
        tag = node.tag
        if entering:
            said = rules.of(node) if rules.by_key or "style" in node.attrs else {}
            closed = "hidden" in node.attrs or "popover" in node.attrs or (tag == "dialog" and "open" not in node.attrs)
            shown = said.get("display", "none" if closed else "") != "none"
            if tag in HIDDEN or not shown or (tag == "input" and node.attrs.get("type", "").lower() == "hidden") or any(n and tag in HIDDEN_IN[t] for t, n in inside.items()):
                continue
            visibility = said.get("visibility")
            if tag == "br":
                out.breaks += 1
                continue
            if tag == "input":  # a button's label is its value
                if node.attrs.get("type", "").lower() in _BUTTON and (seen[-1] if visibility in (None, "inherit") else visibility not in ("hidden", "collapse")):
                    out.text(unescape(node.attrs.get("value", "")))
                continue
            seen.append(seen[-1] if visibility in (None, "inherit") else visibility not in ("hidden", "collapse"))
            if tag == "li":
                depth = "  " * max(0, len(lists) - 1)
                if lists and lists[-1] is not None:
                    value = node.attrs.get("value", "")
                    lists[-1] = int(value) if value.isdecimal() and len(value) < 10 else lists[-1] + 1
                    out.item(f"{depth}{lists[-1]}. ")
                else:
                    out.item(f"{depth}- ")
            elif tag in ("td", "th") and tables:
                writers.append(out)
                out = _Writer()
            elif tag in APART:
                out.block(1 if tag in ("ul", "ol") and lists else 2)
            elif tag in BLOCK:
                out.block(1)
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "")
                lists.append(None if tag != "ol" else int(start) - 1 if start.isdecimal() and len(start) < 10 else 0)
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            if inside["svg"] and tag == "text":
                out.block(1)
            pre += tag == "pre"
            if tag in inside:
                inside[tag] += 1
            todo.append((node, False))
            kids = node.kids
            if tag == "details" and "open" not in node.attrs:
                kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"]
            todo.extend((k, True) for k in reversed(kids))
            continue
        seen.pop()
        pre -= tag == "pre"
        if tag in inside:
            inside[tag] -= 1
        if inside["svg"] and tag == "text":
            out.block(1)
        if tag in ("td", "th") and tables:
            lines = [x.rstrip() for x in out.done().split("\n") if x.strip()]  # blocks, lists and tables in a cell keep their lines
            out = writers.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((lines, _span(node, "colspan", MOST_COLUMNS), _span(node, "rowspan", MOST_ROWS)))
            continue
        if tag in ("ul", "ol", "menu") and lists:
            lists.pop()
        elif tag == "table" and tables:
            lines = [x for x in layout(tables.pop()) if x.strip(" |")]
            for i, x in enumerate(lines):
                out.block(1 if i else 2)
                out.verbatim(x)
        if tag in APART:
            out.block(1 if tag in ("ul", "ol") and lists else 2)
        elif tag in BLOCK:
            out.block(1)
        if tag == "li":
            out.mark = ""
    return out.done()


def extract(html: str | None) -> str:
    return render(*parse(html)) if html else ""


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = [extract(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], batch.schema.names)


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep`` and ``text`` of each row of ``pages`` (html); rows stay in their partitions.

    Shown is what a screen of VIEWPORT shows without scripts. Pages of any length are parsed whole, in time and memory in proportion.

    Null and empty pages give an empty text; broken markup gives the text that a tolerant reader sees.
    Repeated rows are rendered each; other columns are ignored; an empty table gives an empty result.
    """
    pages = pages.select(*keep, F.col("html").cast("string").alias("text"))
    return pages.mapInArrow(_extracted, T.StructType([*pages.schema.fields[:-1], T.StructField("text", T.StringType())]))
