"""Layout-aware text of HTML pages.

A page is cut into comments, tags and text; a tree builder opens and closes elements with the
implied end tags of HTML (a block ends a paragraph, an item ends an item, a cell ends a cell, the
end of a container ends what is open in it); a visibility rule drops scripts, styles, templates, the
head, hidden elements and inline styles that hide. The renderer then emits all visible text:
blocks on lines of their own, paragraphs and headings with a blank line around them, list items
with a mark and indentation, preformatted text as it stands, table cells padded to columns. A cell of
several lines makes a row of several lines, a cell over several columns or rows takes their places, and characters of
double width count as two. Columns are padded to `PAD` characters at most (longer cells stay whole), a gap of more than `REACH` blanks
is cut to that, and of the cells that reach into later rows `REACHING` a table are followed, so padding never outgrows a page.
All that stands in a row is emitted: text and elements outside cells are cells of their own. Buttons, lists and input fields stand apart from the words
beside them, options are lines; names of buttons and of groups of options are text.

Hidden are what `hidden`, `display: none`, no opacity or hidden content hide, with all inside, and texts whose nearest `visibility` is not visible. Styles
come from the element, else from the page's rules for a single class or id in a <style> before it; rules under conditions such as @media,
other selectors and other files are not followed.

Null or empty pages give empty text, an empty table no rows; repeated rows and ids are rendered each by itself. Unclosed
and stray tags never fail. A tag whose quotes do not end ends at the next >; without one it is text; where such tags have cost `SCANS` times
the page, tags end at the next > whatever their quotes, so time grows with the page. Nesting beyond `DEEPEST` levels is written as if on that level, but what is hidden stays hidden, at any depth. Each page
is handled on its own: no shuffle. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S)
NAMED = re.compile(r"</?[a-zA-Z]")
UP_TO_END = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
SCANS = 20
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDING = re.compile(r"(?<![\w-])(?:display\s*:\s*none|content-visibility\s*:\s*hidden|opacity\s*:\s*0*(?:\.0*)?\s*(?:;|!|$))", re.I)
DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*[a-z]", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SINGLE = re.compile(r"[.#][\w-]+")
BRACE = re.compile(r"[{}]")
SPACE = re.compile(r"[ \t\n\r\f]+")
DEEPEST, OPEN = 150, 4_000
PAD, REACH, REACHING = 60, 200, 200
COLUMNS, ROWS = 1_000, 65_534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes datalist audio video title desc defs metadata".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption xmp".split()
)
KEPT = frozenset("textarea xmp pre".split())
APART = frozenset("button select input".split())
NAMED_BUTTONS = frozenset("submit button reset".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption body html".split())
#: An opening tag closes the nearest open one of these, unless one of the fences lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "caption": ({"caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, set()),
}
CELLS = frozenset("table td th caption tr tbody thead tfoot".split())
FENCES = frozenset("table td th caption li div section article body html".split())


class Node:
    __slots__ = ("tag", "seen", "items", "start", "veiled", "across", "down", "label")

    def __init__(self, tag: str, seen: bool = True, veiled: bool = False):
        self.tag, self.seen, self.veiled, self.start, self.across, self.down, self.label = tag, seen, veiled, 1, 1, 1, ""
        self.items: list = []


class Sheet:
    """The page's own rules that hide: single classes and ids."""

    def __init__(self):
        self.gone: set[str] = set()
        self.veils: dict[str, bool] = {}

    def read(self, text: str) -> None:
        at = depth = 0
        head, text = "", COMMENT.sub("", text)
        for m in BRACE.finditer(text):
            piece, at = text[at : m.start()], m.end()
            if m[0] == "{":
                head = head if depth else piece.rpartition(";")[2].strip()
                depth += 1
            elif depth:
                depth -= 1
                if not depth and not head.startswith("@"):
                    self._rule([x.strip() for x in head.split(",")], piece)

    def _rule(self, selectors: list[str], body: str) -> None:
        gone, veils = HIDING.search(body), VISIBILITY.findall(body)
        for x in filter(SINGLE.fullmatch, selectors):
            if gone:
                self.gone.add(x)
            elif DISPLAY.search(body):
                self.gone.discard(x)
            if veils:
                self.veils[x] = veils[-1].lower() != "visible"

    def of(self, found: dict[str, str]) -> tuple[bool, bool | None]:
        if not (self.gone or self.veils):
            return False, None
        names = ["." + x for x in found.get("class", "").split()] + ["#" + found.get("id", "").strip()]
        return any(x in self.gone for x in names), next((self.veils[x] for x in reversed(names) if x in self.veils), None)


def _number(text: str | None, most: int) -> int | None:
    return min(int(text), most) if text and text.isascii() and text.isdigit() and len(text) < 9 else None


def _element(tag: str, attributes: str, veiled: bool, sheet: Sheet) -> Node:
    node = Node(tag, tag not in UNSEEN and tag != "dialog", veiled)
    if tag in UNSEEN or not attributes or attributes.isspace():
        return node
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    style = found.get("style", "")
    gone, veil = sheet.of(found)
    own = VISIBILITY.findall(style)
    gone = HIDING.search(style) or gone and not DISPLAY.search(style)
    node.seen = (node.seen or "open" in found) and "hidden" not in found and not gone
    node.veiled = own[-1].lower() != "visible" if own else veiled if veil is None else veil
    start = found.get("start", "")
    if tag == "ol" and start.lstrip("-").isdigit() and len(start) < 9:
        node.start = int(start)
    elif tag in ("td", "th"):
        node.across = max(1, _number(found.get("colspan"), COLUMNS) or 1)
        down = _number(found.get("rowspan"), ROWS)
        node.down = 1 if down is None else down or ROWS  # 0: up to the end of the section
    elif tag == "optgroup":
        node.label = entities.unescape(found.get("label", ""))
    elif tag == "input" and found.get("type", "").lower() in NAMED_BUTTONS:
        node.label = entities.unescape(found.get("value", ""))
    return node


def tree(page: str) -> Node:
    root, sheet = Node("html"), Sheet()
    stack, opened = [root], Counter()

    def add(text: str) -> None:
        stack[-1].items.append(" " if stack[-1].veiled else text)

    def close(tags, fences) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                opened.subtract(x.tag for x in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in fences:
                return

    at, last, lost = 0, page.rfind(">"), 0
    while at < len(page):
        if at > last:  # nothing closes a tag from here on
            mark = min((x for x in (page.find("<!", at), page.find("<?", at)) if x >= 0), default=len(page))
            add(entities.unescape(page[at:mark]))
            break
        named = NAMED.match(page, at)
        m = UP_TO_END.match(page, at) if named and lost > SCANS * len(page) else TOKEN.match(page, at)
        if named and m[2] is None:  # a quote that does not end: the tag ends at the next >
            lost += len(page) - at
            m = UP_TO_END.match(page, at) or m
        at = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?")):
                add(entities.unescape(m[0]) if "&" in m[0] else m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if tag in VOID:
                continue
            if tag == "p" or tag not in BLOCK:
                close({tag}, FENCES)
            elif tag in CELLS:
                close({tag}, () if tag == "table" else {"table"})
            else:
                close({tag}, CELLS)
            continue
        if tag in ("html", "body") and len(stack) > 1 and tag == "html":
            continue
        if tag in ("tbody", "thead", "tfoot"):
            close({"tr"}, {"table"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ENDS_P:
            close({"p"}, FENCES)
        if tag in BLOCK and tag not in ("html", "head"):
            close({"head"}, ())
        veiled = stack[-1].veiled
        node = _element(tag, m[3], veiled, sheet)
        deep = len(stack) >= DEEPEST
        if not deep or tag in VOID or tag in RAW:
            stack[-1].items.append(node)
        elif node.seen:
            node.items = stack[-1].items  # written as if on the level above
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            text = page[at : end.start() if end else len(page)]
            if tag in KEPT and not node.veiled:
                node.items.append(entities.unescape(text) if tag == "textarea" else text)
            elif tag == "style" and ("media" not in m[3].lower() or "screen" in m[3].lower()):
                sheet.read(text)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].rstrip().endswith("/") and (len(stack) < OPEN or not node.seen or node.veiled != veiled):
            stack.append(node)
            opened[tag] += 1
    return root


class _Writer:
    """Lines under an indentation; blank lines are asked for and merged."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.indent, self.blank, self.mark = "", "", False, ""

    def text(self, t: str) -> None:
        t = SPACE.sub(" ", t)
        if not self.line or self.line.endswith(" "):
            t = t.lstrip(" ")
        self.line += t

    def end(self) -> None:
        line = self.line.rstrip(" ")
        self.line = ""
        if line:
            self.put(line)

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        if self.mark:
            self.lines.append(self.mark + line)
            self.mark = ""
        else:
            self.lines.append(self.indent + line)


def _holds_cells(node: Node) -> bool:
    return any(isinstance(c, Node) and (c.tag in ("td", "th") or c.tag not in BLOCK | {"form"} and _holds_cells(c)) for c in node.items)


Cell = tuple[list[str], int, int]  # lines, columns, rows


def _row(node: Node) -> list[Cell]:
    """The cells of a row; wrappers around cells are looked through, whatever else is visible is a cell."""
    cells = []
    for c in node.items:
        if isinstance(c, str):
            if c.strip():
                cells.append(([" ".join(c.split())], 1, 1))
        elif c.seen and c.tag not in ("td", "th") and _holds_cells(c):
            cells += _row(c)
        elif c.seen:
            text = render(c) if c.tag in ("td", "th") else _rendered_alone(c)
            if text or c.tag in ("td", "th"):
                cells.append((text.split("\n"), c.across, c.down))
    return cells


def _rendered_alone(node: Node) -> str:
    holder = Node("div")
    holder.items.append(node)
    return render(holder)


def _cells(table: Node) -> tuple[list[str], list[list[Cell] | None]]:
    """Captions, and rows of cells; None where a section begins or ends."""
    captions, rows = [], []
    for x in table.items:
        if isinstance(x, str):
            if x.strip():
                captions.append(" ".join(x.split()))
        elif not x.seen:
            continue
        elif x.tag == "tr":
            rows.append(_row(x))
        elif x.tag in ("tbody", "thead", "tfoot") or x.tag not in ("td", "th", "table", "caption") and any(isinstance(c, Node) and c.tag in ("tr", "tbody", "thead", "tfoot") for c in x.items):
            more, inner = _cells(x)
            captions += more
            rows += [None, *inner, None] if x.tag in ("tbody", "thead", "tfoot") else inner
        elif x.tag in ("td", "th"):
            rows.append([(render(x).split("\n"), x.across, x.down)])
        elif x.tag not in ("col", "colgroup"):
            captions.append(render(x) if x.tag == "caption" else _rendered_alone(x))
    return captions, rows


def _placed(rows: list[list[Cell] | None]) -> list[list[tuple[int, int, list[str]]]]:
    """Per row that shows something: first column, column after the last, lines of each cell."""
    out, reaching = [], []  # reaching: first column, column after the last, row after the last
    for r, row in enumerate(rows):
        if row is None:
            reaching = []
            continue
        reaching = sorted(x for x in reaching if x[2] > r)
        held, new, placed, column = iter([*reaching, (1 << 60, 0, 0)]), [], [], 0
        nearest = next(held)
        for lines, across, down in row:
            while nearest[0] < column + across:  # what reaches into this row takes its place
                column = max(column, nearest[1])
                nearest = next(held)
            placed.append((column, column + across, lines))
            if down > 1 and len(reaching) + len(new) < REACHING:
                new.append((column, column + across, r + down))
            column += across
        reaching += new
        if any(any(lines) for _, _, lines in placed):
            out.append(placed)
    return out


def _width(line: str) -> int:
    """Columns that a line takes: two for wide characters, none for marks that combine."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


def _fitted(rows: list[list[tuple[int, int, list[str]]]]) -> tuple[list[list[tuple[int, int, list[str]]]], list[int]]:
    """The rows with columns numbered by the places where cells begin, and where each column begins when written."""
    begins = sorted({a for row in rows for a, _, _ in row})
    number = {a: i for i, a in enumerate(begins)}
    rows = [[(number[a], max(number[a] + 1, bisect_left(begins, b)), lines) for a, b, lines in row] for row in rows]
    widths = [0] * len(begins)
    for several in (False, True):  # cells over several columns widen the last of them by what they lack
        for row in rows:
            for i, j, lines in row:
                if (j - i > 1) == several:
                    need = min(PAD, max(map(_width, lines), default=0)) - (sum(widths[i : j - 1]) + 2 * (j - i - 1))
                    widths[j - 1] = max(widths[j - 1], need)
    return rows, [0, *accumulate(w + 2 for w in widths)]


def _table(x: Node, out: "_Writer") -> None:
    captions, rows = _cells(x)
    for c in captions:
        for line in c.split("\n"):
            out.put(line)
    placed, begins = _fitted(_placed(rows))
    for row in placed:
        for k in range(max(len(lines) for _, _, lines in row)):
            line, at = "", 0
            for i, j, lines in row:
                text = lines[k] if k < len(lines) else ""
                line += " " * min(REACH, begins[i] - begins[at]) + text
                line += " " * min(REACH, max(2, begins[j] - begins[i] - _width(text)))
                at = j
            out.put(line.rstrip(" "))


def _write(node: Node, out: _Writer, pre: bool) -> None:
    number = node.start
    for x in node.items:
        if isinstance(x, str):
            if pre:
                first, *rest = x.split("\n")
                out.line += first
                for more in rest:
                    out.put(out.line) if out.line or out.lines else None
                    out.line = more
            else:
                out.text(x)
            continue
        tag = x.tag
        if not x.seen:
            continue
        if tag == "br":
            out.put(out.line.rstrip(" "))
            out.line = ""
            continue
        if tag in ("option", "optgroup"):
            out.end()
            out.text("" if x.veiled else x.label)
            _write(x, out, pre)
            out.end()
            continue
        if tag not in BLOCK:
            if tag in APART:
                out.text(" ")
                out.text("" if x.veiled else x.label)
            _write(x, out, pre or tag in KEPT)
            if tag in APART:
                out.text(" ")
            continue
        out.end()
        if tag in SPACED and not (node.tag == "li" and tag in ("ul", "ol")):
            out.blank = True
        if tag == "hr":
            out.put("---") if not x.veiled else None
        elif tag == "table":
            _table(x, out)
        elif tag == "li":
            held = out.indent
            out.mark = held + (f"{number}. " if node.tag == "ol" else "- ")
            number += 1
            out.indent = held + "  "
            _write(x, out, pre)
            out.end()
            out.indent, out.mark = held, ""
        else:
            held = out.indent
            if tag in ("blockquote", "dd"):
                out.indent += "  "
            _write(x, out, pre or tag in KEPT)
            out.end()
            out.indent = held
        if tag in SPACED and not (node.tag == "li" and tag in ("ul", "ol")):
            out.blank = True


def render(node: Node) -> str:
    out = _Writer()
    _write(node, out, False)
    out.end()
    return "\n".join(out.lines)


def text_of(page: str) -> str:
    return render(tree(page)) if page else ""


def _render(batches):
    for pdf in batches:
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": [text_of(h) for h in pdf["html"]]})


def rendered(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, n_lines."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kind = p.schema["page_id"].dataType.simpleString()
    out = p.mapInPandas(_render, f"page_id {kind}, url string, text string")
    lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0)
    return out.withColumn("n_chars", F.length("text").cast("long")).withColumn("n_lines", lines.cast("long"))
