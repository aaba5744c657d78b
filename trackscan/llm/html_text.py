"""Visible text of HTML pages, laid out: blocks, lists and tables as a reader sees them.

A small tree builder with implied end tags reads the page in one pass of a regular expression;
rendering follows the tree: what is not shown is left out, blocks stand on lines of their own,
list items have marks, and the cells of a table's column start at the same place.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackscan.llm.common import mapped, ship, with_columns

# Element classes of the HTML standard (fixed values).
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset(
    "head script style template noscript iframe select datalist audio video canvas"
    " title meta link noembed noframes".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav"
    " ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption"
    .split()
)
#: Blocks with an empty line before and after.
SPACED = frozenset(
    "p blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol pre table ul dir article".split()
)
#: Opening one of these closes an open p.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary"
    " table ul".split()
)
#: Opening the first closes an open one of the second, unless one of the third is between.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
#: Start tags that leave an open head open; any other, or text, closes it.
IN_HEAD = frozenset(
    "base basefont bgsound head link meta noframes noscript script style template title".split()
)
#: Parts of svg and math that are not drawn where they stand.
FOREIGN_HIDDEN = frozenset(
    "defs desc metadata symbol clippath mask pattern marker filter lineargradient radialgradient"
    " annotation annotation-xml mphantom".split()
)
#: Elements of svg and math whose content is HTML again.
INTEGRATION = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
#: Start tags that end open svg and math.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li"
    " listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: An end tag doesn't reach beyond these.
SCOPE = frozenset("table td th caption html template".split())

# Every alternative ends at the end of the page at the latest, so a broken page costs no more.
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?|[\"'])*)(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?"
)
_SLASH_IN_VALUE = re.compile(r"=\s*[^\s\"'][^\s]*/\Z")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|\Z)")
_SPACES = re.compile(r"[ \t\n\f\r]+")
_NUMBER = re.compile(r"\s*([-+]?\d{1,9})")

#: Columns of a table that have a place, the furthest place, and the width of a cell that sets one.
MOST_COLUMNS, FURTHEST, WIDEST = 100, 200, 80
#: Lists, quotations and tables in one another that are indented or aligned; deeper ones stand as
#: blocks, with their marks.
MOST_NESTED = 16


class Node:
    __slots__ = ("children", "closed", "foreign", "name", "reverse", "seen", "shown", "span", "start")

    def __init__(self, name: str, shown: bool = True) -> None:
        self.name, self.shown = name, shown
        self.seen: bool | None = None  # its own visibility; None: that of its parent
        self.closed = False  # whether only its summary is shown
        self.start: int | None = None  # of a list's marks, or the mark of an item
        self.reverse = False  # whether the marks count down
        self.span = (1, 1)  # columns and rows of a cell; no rows: all that follow
        self.foreign = False  # whether its children are of svg or math
        self.children: list[Node | str] = []


def _number(written: str) -> int | None:
    m = _NUMBER.match(written)
    return int(m[1]) if m else None


def declared(style: str) -> dict[str, str]:
    """The display and visibility that a style attribute gives: the last one, an important one first."""
    found: dict[str, tuple[bool, str]] = {}
    for key, value, important in _DECLARED.findall(style.lower()):
        if important or not found.get(key, (False,))[0]:
            found[key] = (bool(important), value)
    return {key: value for key, (_, value) in found.items()}


def _made(name: str, written: str) -> Node:
    node = Node(name, name not in HIDDEN)
    found: dict[str, str] = {}
    if written and written != "/":
        for key, a, b, c in _ATTRIBUTE.findall(written):
            found.setdefault(key.lower(), a or b or c)
        style = declared(html.unescape(found["style"])) if found.get("style") else {}
        if style.get("display") == "none" or ("hidden" in found and "display" not in style):
            node.shown = False
        if name == "input" and found.get("type", "").lower() == "hidden":
            node.shown = False
        if name == "object" and found.get("data", "").strip():
            node.shown = False  # the resource is shown instead
        if "visibility" in style and style["visibility"] not in ("inherit", "unset"):
            node.seen = style["visibility"] not in ("hidden", "collapse")
        if name == "ol":
            node.start, node.reverse = _number(found.get("start", "")), "reversed" in found
        elif name == "li":
            node.start = _number(found.get("value", ""))
        elif name in ("td", "th"):
            rows = _number(found.get("rowspan", ""))
            node.span = (max(_number(found.get("colspan", "")) or 1, 1), 1 if rows is None or rows < 0 else rows)
    if name == "dialog" and "open" not in found:
        node.shown = False
    node.closed = name == "details" and "open" not in found
    return node


def tree(page: str) -> Node:
    """The page's elements, with the end tags that are implied."""
    root = Node("html")
    stack = Stack(root)
    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            if stack[-1].name == "head" and _SPACES.sub("", page[at : m.start()]):
                _leave_head(stack)
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            _close(stack, name)
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            _leave_head(stack)
        if stack[-1].foreign and name in BREAKOUT:
            while stack[-1].foreign:
                stack.cut(len(stack) - 1)
        _open_closes(stack, name)
        if name in ("html", "body") and len(stack) == 1:
            node = _made(name, m[3])
            root.shown &= node.shown
            root.seen = root.seen if node.seen is None else node.seen
            continue
        node = _made(name, m[3])
        within = stack[-1].foreign
        node.foreign = name in ("svg", "math") or (within and name not in INTEGRATION)
        if within and name in FOREIGN_HIDDEN:
            node.shown = False
        stack[-1].children.append(node)
        if (within or node.foreign) and m[3].endswith("/") and not _SLASH_IN_VALUE.search(m[3]):
            continue  # in svg and math a slash ends an element
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            text = page[at : end.start() if end else len(page)]
            node.children.append(html.unescape(text) if name in ("textarea", "title") else text)
            at = end.end() if end else len(page)
        elif name not in VOID:
            stack.push(node)
    if at < len(page):
        if _SPACES.sub("", page[at:]):
            _leave_head(stack)
        stack[-1].children.append(html.unescape(page[at:]))
    return root


def _leave_head(stack: Stack) -> None:
    while stack[-1].name == "head":
        stack.cut(len(stack) - 1)


class Stack(list):
    """The open elements, and where each name stands among them: looked up at any depth at once."""

    def __init__(self, root: Node) -> None:
        super().__init__([root])
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []

    def push(self, node: Node) -> None:
        self.places[node.name].append(len(self))
        if node.name in SCOPE:
            self.scopes.append(len(self))
        self.append(node)

    def cut(self, at: int) -> None:
        """Closes all from place at on."""
        while len(self) > at:
            name = self.pop().name
            self.places[name].pop()
            if name in SCOPE:
                self.scopes.pop()

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else 0

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0


def _close(stack: Stack, name: str) -> None:
    at = stack.last(name)
    if at and (at >= stack.scope() or name in ("table", "tr", "tbody", "thead", "tfoot")):
        stack.cut(at)


def _open_closes(stack: Stack, name: str) -> None:
    if name in CLOSES_P and stack.last("p") > stack.scope():
        stack.cut(stack.last("p"))
    if name in IMPLIED:
        closed, stops = IMPLIED[name]
        stop = max(map(stack.last, stops), default=0)
        found = []
        for x in closed:
            places = stack.places.get(x, ())
            i = bisect_right(places, stop)
            found += places[i : i + 1]
        if found:
            stack.cut(min(found))


class Lines:
    """Collects text as lines: collapsed white space, and at most one empty line in a row."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = False

    def text(self, text: str, keep_spaces: bool = False) -> None:
        if keep_spaces:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self._add(first)
            for line in more:
                self.end(keep_empty=True)
                self._add(line)
            return
        parts = _SPACES.split(text)
        if not parts[0] and len(parts) > 1:
            self.space = True
        for i, word in enumerate(parts):
            if i and word:
                self.space = True
            if word:
                if self.space and self.now:
                    self.now.append(" ")
                self._add(word)
        if len(parts) > 1 and not parts[-1]:
            self.space = True

    def _add(self, text: str) -> None:
        if text:
            self.now.append(text)
            self.space = False

    def end(self, keep_empty: bool = False) -> None:
        """Ends the line, if there is anything on it."""
        line = "".join(self.now).rstrip()
        if line or keep_empty:
            if self.gap and self.done and self.done[-1]:
                self.done.append("")
            self.gap = False
            self.done.append(line)
        self.now, self.space = [], False

    def empty_line(self) -> None:
        self.end()
        self.gap = True

    def add_all(self, lines: list[str]) -> None:
        self.end()
        for line in lines:
            self.now = [line] if line else []
            self.end(keep_empty=True)

    def finished(self) -> list[str]:
        self.end()
        while self.done and not self.done[-1]:
            self.done.pop()
        while self.done and not self.done[0]:
            self.done.pop(0)
        return self.done


def width(text: str) -> int:
    """Columns that text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1
        for c in text
    )


#: A step yields the steps that it waits for, so that trees of any depth need no recursion.
Steps = Generator["Steps", Any, Any]


def _done(first: Steps) -> Any:
    waiting, result = [first], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(result))
            result = None
        except StopIteration as end:
            waiting.pop()
            result = end.value
    return result


def _render(
    node: Node, out: Lines, pre: bool, seen: bool = True, nested: int = 0, drawing: bool = False
) -> Steps:
    """seen: whether text is visible; nested: lists, quotations and tables around.

    drawing: in svg, where only text elements and foreign objects have text.
    """
    children = node.children
    if node.closed:
        summaries = (x for x in children if isinstance(x, Node) and x.name == "summary")
        children = list(islice(summaries, 1))
    items = 0
    if node.reverse and node.start is None:
        items = sum(isinstance(x, Node) and x.name == "li" for x in children)
    number = node.start if node.start is not None else items or 1
    deep = nested >= MOST_NESTED
    for child in children:
        if isinstance(child, str):
            if seen and not drawing:
                out.text(child, pre)
            continue
        name = child.name
        if not child.shown:
            continue
        see = seen if child.seen is None else child.seen
        if child.foreign and name == "svg":
            yield _render(child, out, False, see, nested, True)
        elif drawing:
            texts = name in ("text", "foreignobject")
            out.space |= texts
            yield _render(child, out, False, see, nested, not texts)
            out.space |= texts
        elif child.foreign and name in ("mtr", "mtd"):  # rows and cells of a matrix
            out.end() if name == "mtr" else None
            yield _render(child, out, False, see, nested)
            out.space = True
        elif name == "br":
            if see:
                out.end(keep_empty=True)
        elif name == "hr":
            out.empty_line()
        elif name == "table" and not deep:
            out.empty_line()
            out.add_all((yield _table(child, see, nested + 1)))
            out.empty_line()
        elif name == "li":
            if child.start is not None:
                number = child.start
            mark = f"{number}. " if node.name == "ol" else "- "
            number += -1 if node.reverse else 1
            if deep:
                out.end()
                if see:
                    out.text(mark)
                yield _render(child, out, pre, see, nested + 1)
                out.end()
                continue
            own = Lines()
            yield _render(child, own, pre, see, nested + 1)
            lines = own.finished()
            if not see:
                mark = " " * len(mark)
            rest = " " * len(mark)
            out.add_all([(mark if not i else rest) + x if x else "" for i, x in enumerate(lines or ([""] if see else []))])
        elif name in BLOCK:
            spaced = name in SPACED and not (name in ("ul", "ol", "menu", "dir") and node.name == "li")
            yield _block(child, out, pre, see, nested, spaced)
        else:
            yield _render(child, out, pre, see, nested)  # inline


def _block(node: Node, out: Lines, pre: bool, seen: bool, nested: int, spaced: bool) -> Steps:
    out.empty_line() if spaced else out.end()
    if node.name in ("dd", "blockquote") and nested < MOST_NESTED:
        own = Lines()
        yield _render(node, own, pre, seen, nested + 1)
        out.add_all(["    " + x if x else "" for x in own.finished()])
    else:
        yield _render(node, out, pre or node.name == "pre", seen, nested)
    out.empty_line() if spaced else out.end()


def _rows(table: Node, seen: bool) -> Iterator[tuple[Node, Node, bool]]:
    """(group, row, whether its text is visible): rows of one group can have common cells."""
    for child in table.children:
        if isinstance(child, Node) and child.shown:
            see = seen if child.seen is None else child.seen
            if child.name == "tr":
                yield table, child, see
            elif child.name in ("thead", "tbody", "tfoot"):
                yield from _rows(child, see)


#: A cell: its column, how many columns it takes, and its lines.
Cell = tuple[int, int, list[str]]


def _table(table: Node, seen: bool, nested: int) -> Steps:
    """Lines of a table; a cell's further lines stand below its first, columns are aligned."""
    stray = Lines()  # captions, and what is not in a row
    for child in table.children:
        if isinstance(child, str):
            if seen:
                stray.text(child)
        elif child.shown and child.name not in ("tr", "thead", "tbody", "tfoot"):
            yield _render(child, stray, False, seen if child.seen is None else child.seen, nested)
            stray.end()
    grid: list[list[Cell]] = []
    group, taken = None, [0] * MOST_COLUMNS  # rows from here on in which a cell above goes on
    for own_group, row, see in _rows(table, seen):
        if own_group is not group:
            group, taken = own_group, [0] * MOST_COLUMNS
        cells: list[Cell] = []
        loose, column = Lines(), 0
        below = list(taken) if any(taken) else taken
        for child in row.children:
            if isinstance(child, Node) and child.name in ("td", "th"):
                if child.shown:
                    own = Lines()
                    yield _render(child, own, False, see if child.seen is None else child.seen, nested)
                    while column < MOST_COLUMNS and taken[column]:
                        column += 1
                    columns, rows = child.span
                    if rows != 1 and column < MOST_COLUMNS:
                        below = list(below)
                        for k in range(column, min(column + columns, MOST_COLUMNS)):
                            below[k] = rows or sys.maxsize
                    cells.append((column, columns, own.finished()))
                    column += columns
            elif isinstance(child, str):
                if see:
                    loose.text(child)
            elif child.shown:
                one = Node("span")
                one.children.append(child)
                yield _render(one, loose, False, see, nested)
        if below is not taken or any(taken):
            taken = [max(n - 1, 0) for n in below]
        stray.add_all(loose.finished())
        if any(lines for _, _, lines in cells):
            grid.append(cells)
    return stray.finished() + _aligned(grid)


def _aligned(grid: list[list[Cell]]) -> list[str]:
    """The lines of a table's rows.

    A cell that is wider than WIDEST, or spans columns, sets no column's width by itself, but
    pushes what follows on its line; no column begins beyond FURTHEST, and what comes later
    follows at a distance of two spaces. So the text grows with the page, whatever the cells.
    """
    wide = [0] * (MOST_COLUMNS + 1)
    spans = []
    for row in grid:
        for column, columns, lines in row:
            if column < MOST_COLUMNS:
                widths = [w for w in map(width, lines) if w <= WIDEST]
                if columns == 1:
                    wide[column] = max([wide[column], *widths])
                elif widths:
                    spans.append((column, min(column + columns, MOST_COLUMNS), max(widths)))
    for column, end, needed in sorted(spans, key=lambda x: (x[1] - x[0], x)):
        has = sum(wide[column:end]) + 2 * (end - column - 1)
        wide[end - 1] += max(needed - has, 0)
    starts = [0]
    for w in wide[:-1]:
        starts.append(starts[-1] + w + 2)
    out = []
    for row in grid:
        going = [(starts[c] if c < MOST_COLUMNS else FURTHEST + 1, lines) for c, _, lines in row]
        i = 0
        while going := [x for x in going if len(x[1]) > i]:
            parts, at = [], 0
            for start, lines in going:
                if not lines[i]:
                    continue
                gap = start - at if start <= FURTHEST else 0
                gap = max(gap, 2 if at else 0)
                parts += [" " * gap, lines[i]]
                at += gap + width(lines[i])
            out.append("".join(parts).rstrip())
            i += 1
    return out


def text_of(page: str | None) -> str:
    """All visible text of a page; an empty string for a null or empty page."""
    out = Lines()
    root = tree(page or "")
    if root.shown:
        _done(_render(root, out, False, root.seen is not False))
    return "\n".join(out.finished())


def title_of(page: str | None) -> str | None:
    m = re.search(r"<title[^>]*>(.*?)(?:</title|\Z)", page or "", re.I | re.S)
    return _SPACES.sub(" ", html.unescape(m[1])).strip() if m else None


def extracted(pages: DataFrame) -> DataFrame:
    """pages with title and text added; html is read whole, and all rows and columns stay.

    A null page gives a null title and an empty text. Columns named title or text are replaced.
    """
    ship(pages.sparkSession)
    rows = pages.drop("title", "text")
    at = rows.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(title_of(p), text_of(p)) for p in batch.column(at).to_pylist()]
            yield pa.record_batch(
                [*batch.columns, *(pa.array([x[k] for x in found], pa.string()) for k in (0, 1))],
                [*batch.schema.names, "title", "text"],
            )

    return mapped(rows, run, with_columns(rows, "title string, text string"))
