"""HTML to text by layout-aware rendering.

A tokenizer feeds a tree builder that opens and closes elements as browsers imply them (head, body, tbody, p, li, dt, dd,
table parts, options; void elements; stray end tags). Visibility rules leave out what a browser wouldn't show: head,
scripts, styles, templates, the `hidden` attribute, closed details and dialogs, hidden and typed-in secret form values, options of a
drop-down that aren't chosen, and what styles hide. Styles are inline ones and those of the page's style elements whose selectors are
simple (names, classes and ids; other selectors, at-rules and style elements for other media are passed over), in the order of importance, place, specificity and
order: display:none takes an element with all that is in it, visibility is inherited and can be taken back further in. Everything
else is rendered, with the alt text of images: white space collapses except in pre and textarea, blocks start on new lines, paragraphs, headings and lists are set apart by an
empty line, list items carry markers and indents, form controls show their text, and table cells, with their row and
column spans, are padded to the width of their column. What stands in a table outside its cells is shown above it.

Every character is looked at a bounded number of times, whatever is left open: the tokenizer moves forward only, the tree
builder knows the innermost open element of each name, and the renderer keeps its own stack, so depth has no limit.
Layout, not text, has bounds, which are parameters (`Layout`): a cell wider than `pad` doesn't widen its column, columns beyond `line`
aren't aligned (nor those beyond the standard's 1,000), lists deeper than `indent` levels aren't indented further, and tables inside
`nested` tables are shown as blocks, a row a line.

One projection, no shuffle; a page at a time.

Defined results: null and empty pages give the empty text; broken markup never raises; an unfinished tag, comment or quoted
value at the end of a page runs to its end and shows nothing, as in browsers; very long pages are rendered whole; repeated
rows give equal texts; an empty table gives an empty result; `render_pages` keeps the other columns.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import slices_of


@dataclass(frozen=True)
class Layout:
    """Bounds of the layout: width of a cell that widens its column, place of an aligned column, levels of indented lists, tables in tables with columns."""

    pad: int = 120
    line: int = 1000
    indent: int = 24
    nested: int = 8


#: Fixed values of the HTML standard.
MOST_COLUMNS, MOST_ROWSPAN = 1000, 65534
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
IN_HEAD = frozenset("base link meta title style script template noscript".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
BLOCK = CLOSES_P | frozenset("html body li dt dd tr caption legend optgroup option thead tbody tfoot textarea".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
UNSEEN = frozenset("head script style template title noscript iframe object audio video canvas svg math datalist noembed noframes meter progress".split())
LISTS = frozenset("ul ol menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS, SECTIONS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
PARTS = CELLS | SECTIONS | {"tr"}
#: Has rows or lines of its own; parts of a table in it aren't the outer table's.
OWN_GRID = frozenset(("table", "td", "th", "caption"))
P_BORDERS = frozenset("button td th caption table object".split())
#: Kinds of input whose value isn't shown as it is.
MUTE_INPUTS = frozenset("hidden checkbox radio file password image color range".split())
BUTTON_TEXT = {"submit": "Submit", "reset": "Reset"}
#: An opening tag closes these open elements, up to the named border.
IMPLIED_ENDS = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
NAME = re.compile(r"[^\s/>]+")
#: What may stand before an attribute; its name, which may begin with =; the sign before its value.
GAP = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(\s*=\s*)?")
BARE = re.compile(r"[^\s>]*")
COMMENT_END = re.compile(r"--!?>")
SPACE = re.compile(r"[ \t\n\r\f]+")
#: A declaration that bears on visibility: property, value, importance.
DECLARED = re.compile(r"(?:^|(?<=;))\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
#: A selector of one element: a name or *, then classes and ids.
SIMPLE = re.compile(r"(\*|[a-zA-Z][a-zA-Z0-9-]*)?((?:[.#][a-zA-Z0-9_\u0080-\U0010ffff-]+)*)$")
MEDIA = re.compile(r"\s*(?:(?:only\s+)?(?:all|screen)\s*(?:,|$)|$)", re.I)


def _declared(text: str) -> dict[str, tuple[bool, str]]:
    """Of a list of declarations the importance and the value that count for display and visibility."""
    found: dict[str, tuple[bool, str]] = {}
    for name, value, important in DECLARED.findall(text):
        name = name.lower()
        if important or not found.get(name, (False,))[0]:
            found[name] = (bool(important), value.lower())
    return found


class Element:
    """A node. `holds`: a shown part of a table lies in it, outside the cells and tables in it."""

    __slots__ = ("attributes", "children", "hidden", "holds", "tag", "veiled")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        a = attributes or {}
        self.tag, self.attributes, self.children, self.holds, self.veiled = tag, a, [], False, False
        #: What the element is by itself; `Styles` has the last word.
        self.hidden = tag in UNSEEN or bool(a) and ("hidden" in a or tag == "dialog" and "open" not in a or "style" in a and _declared(a["style"]).get("display", (0, ""))[1] == "none") or tag == "dialog" and not a


class Styles:
    """Rules of a page's style elements, by what a selector names first, and the visibility of its elements."""

    def __init__(self):
        #: (specificity, order, name, classes, ids, declarations) under an id, a class, a name or *.
        self.rules: dict[str, list[tuple]] = {}
        self.n = 0

    def read(self, sheet: str) -> None:
        sheet, at = CSS_COMMENT.sub(" ", sheet), 0
        while (brace := sheet.find("{", at)) >= 0:
            head = sheet[at:brace]
            # an at-rule without a block ends at its semicolon
            head = head.rpartition(";")[2].strip()
            depth, end = 1, brace + 1
            for m in re.compile(r"[{}]").finditer(sheet, end):
                depth += 1 if m[0] == "{" else -1
                end = m.end()
                if not depth:
                    break
            else:
                end = len(sheet) + 1
            if not head.startswith("@"):
                self._rule(head, _declared(sheet[brace + 1 : end - 1]))
            at = end

    def _rule(self, head: str, declared: dict[str, tuple[bool, str]]) -> None:
        if not declared:
            return
        for selector in head.split(","):
            m = SIMPLE.match(selector.strip())
            if not m or not m[0]:
                continue
            name = (m[1] or "*").lower()
            parts = re.findall(r"([.#])([^.#]+)", m[2])
            classes, ids = frozenset(x for c, x in parts if c == "."), frozenset(x for c, x in parts if c == "#")
            under = f"#{min(ids)}" if ids else f".{min(classes)}" if classes else name
            self.n += 1
            self.rules.setdefault(under, []).append(((len(ids), len(classes), int(name != "*")), self.n, name, classes, ids, declared))

    def _won(self, e: Element) -> dict[str, str]:
        """The value of display and visibility that counts for an element."""
        a = e.attributes
        best: dict[str, tuple] = {}
        if "style" in a:
            for name, (important, value) in _declared(a["style"]).items():
                best[name] = ((important, 1, (0, 0, 0), 0), value)
        if self.rules:
            own, classes = a.get("id", ""), set(a.get("class", "").split())
            for under in ("*", e.tag, f"#{own}", *(f".{c}" for c in classes)):
                for weight, order, name, needed, ids, declared in self.rules.get(under, ()):
                    if name in ("*", e.tag) and needed <= classes and ids <= {own}:
                        for k, (important, value) in declared.items():
                            rank = (important, 0, weight, order)
                            if k not in best or rank > best[k][0]:
                                best[k] = (rank, value)
        return {k: value for k, (_, value) in best.items()}

    def apply(self, root: Element) -> None:
        """Set `hidden` of every element, and take the text out of those that aren't visible."""
        order, stack = [], [(root, True)]
        while stack:
            e, visible = stack.pop()
            order.append(e)
            won = self._won(e)
            if e.tag not in UNSEEN:
                display = won.get("display", "inherit")
                if display == "none":
                    e.hidden = True
                elif display not in ("inherit", "unset", "initial", "revert"):
                    e.hidden = False
            said = won.get("visibility", "inherit")
            visible = visible if said in ("inherit", "unset", "revert") else said in ("visible", "initial")
            if e.hidden:
                continue
            if not visible:
                e.veiled = True
                e.children = [x for x in e.children if not isinstance(x, str)]
            stack += [(x, visible) for x in e.children if isinstance(x, Element)]
        for e in reversed(order):
            e.holds = any(isinstance(x, Element) and not x.hidden and (x.tag in PARTS or x.holds and x.tag not in OWN_GRID) for x in e.children)


class TreeBuilder:
    def __init__(self):
        self.root = Element("html")
        self.open = [self.root]
        #: Places in `open` of the elements of each name.
        self.at: dict[str, list[int]] = {}
        self.body: Element | None = None

    def _cut(self, k: int) -> None:
        """Close the open elements from place k on."""
        for e in self.open[k:]:
            self.at[e.tag].pop()
        del self.open[k:]

    def _innermost(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=0)

    def _enter_body(self) -> None:
        if self.body is None:
            self._cut(1)
            self.body = Element("body")
            self._push(self.body)

    def text(self, text: str) -> None:
        if self.open[-1] is self.root or (self.open[-1].tag == "head" and text.strip()):
            if not text.strip():
                return
            self._enter_body()
        self.open[-1].children.append(text)

    def _close_up_to(self, tags: Iterable[str], borders: Iterable[str]) -> None:
        while (k := self._innermost(tags)) > self._innermost(borders):
            self._cut(k)

    def start(self, tag: str, attributes: dict[str, str], empty: bool) -> None:
        if tag in ("html", "body", "head"):
            if tag == "body":
                self._enter_body()
                self._more(self.body, attributes)
            elif tag == "head" and self.body is None and len(self.open) == 1:
                self._push(Element("head"))
            elif tag == "html":
                self._more(self.root, attributes)
            return
        if self.body is None:
            if tag in IN_HEAD:
                if len(self.open) == 1:
                    self._push(Element("head"))
            elif self.open[-1].tag in ("html", "head"):
                self._enter_body()
        if tag in CLOSES_P and (k := self._innermost(("p",))) > self._innermost(P_BORDERS):
            self._cut(k)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._cut(len(self.open) - 1)
        if tag in IMPLIED_ENDS:
            self._close_up_to(*IMPLIED_ENDS[tag])
        if tag == "tr" and self.open[-1].tag == "table":
            self._push(Element("tbody"))
        if tag in CELLS:
            if self.open[-1].tag == "table":
                self._push(Element("tbody"))
            if self.open[-1].tag in SECTIONS:
                self._push(Element("tr"))
        element = Element(tag, attributes)
        # a form between the parts of a table stays empty; what follows it is the table's
        if tag in VOID or empty and tag in ("svg", "path", "math") or tag == "form" and self.open[-1].tag in ("table", "thead", "tbody", "tfoot", "tr"):
            self.open[-1].children.append(element)
        else:
            self._push(element)

    @staticmethod
    def _more(e: Element, attributes: dict[str, str]) -> None:
        for k, v in attributes.items():
            e.attributes.setdefault(k, v)
        e.hidden = Element(e.tag, e.attributes).hidden

    def _push(self, element: Element) -> None:
        self.open[-1].children.append(element)
        if element.tag in PARTS and not element.hidden:
            for e in reversed(self.open):
                if e.holds or e.hidden or e.tag in OWN_GRID:
                    break
                e.holds = True
        self.at.setdefault(element.tag, []).append(len(self.open))
        self.open.append(element)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Element("br"))
            return
        if tag == "p" and not self.at.get("p"):
            self.start("p", {}, False)
        if tag in ("html", "body"):
            return
        # a table part's end tag stays inside its table; a cell isn't left by the end of something outside it
        k = self._innermost(HEADINGS if tag in HEADINGS else (tag,))
        if k and (tag in PARTS or tag == "table" or k >= self._innermost(OWN_GRID)):
            if tag in PARTS and k < self._innermost(("table",)):
                return
            self._cut(k)


def _tag(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes (the first of a name counts), whether it ends with a slash, and the place behind the tag; -1 if it is never finished."""
    found: dict[str, str] = {}
    n = len(page)
    while True:
        at = (gap := GAP.match(page, at)).end()
        if at >= n:
            return found, False, -1
        if page[at] == ">":
            return found, gap.end() > gap.start() and page[at - 1] == "/", at + 1
        m = ATTRIBUTE.match(page, at)
        name, at, value = m[1].lower(), m.end(), ""
        if m[2]:
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return found, False, -1
                value, at = page[at + 1 : end], end + 1
            else:
                value = BARE.match(page, at)[0]
                at += len(value)
        found.setdefault(name, html.unescape(value))


def parse(page: str) -> Element:
    """The tree of a page, with the visibility of its elements."""
    styles = Styles()
    root = _tree(page, styles)
    if styles.rules or "visibility" in page.lower():
        styles.apply(root)
    return root


def _tree(page: str, styles: Styles) -> Element:
    build, at, n = TreeBuilder(), 0, len(page)
    shown = 0
    while at < n:
        start = page.find("<", at)
        if start < 0:
            break
        close = page[start + 1 : start + 2] == "/"
        first = page[start + 1 + close : start + 2 + close]
        letter = first.isascii() and first.isalpha()
        if not letter and not (close and first) and first not in ("!", "?"):
            at = start + 1
            continue
        if start > shown:
            build.text(html.unescape(page[shown:start]))
        if letter:
            m = NAME.match(page, start + 1 + close)
            tag = m[0].lower()
            attributes, slash, at = _tag(page, m.end())
        elif page.startswith("<!--", start):
            empty = re.compile(r"-?>").match(page, start + 4)
            m = empty or COMMENT_END.search(page, start + 4)
            at = m.end() if m else -1
        else:
            at = page.find(">", start) + 1 or -1
        if at < 0:
            return build.root
        shown = at
        if not letter:
            continue
        if close:
            build.end(tag)
            continue
        build.start(tag, attributes, slash)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            end = stop.start() if stop else n
            content = page[at:end]
            if tag == "style" and MEDIA.match(attributes.get("media", "")) and attributes.get("type", "text/css").strip().lower() in ("", "text/css"):
                styles.read(content)
            if content and build.open[-1].tag == tag:
                build.open[-1].children.append(html.unescape(content) if tag in ("textarea", "title") else content)
            at = shown = end
    if shown < n:
        build.text(html.unescape(page[shown:]))
    return build.root


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Collects lines; `blank` asks for an empty line before the next text, `fresh` for a new line.

    Items nest: inside one, lines are indented, and its first line starts with its mark.
    """

    def __init__(self, layout: Layout):
        self.layout = layout
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False
        self.indent = self.base = ""
        #: Marks of the items that have no text yet, the outermost first; they stand behind `base`.
        self.marks: list[str] = []

    def add(self, text: str, keep: bool = False) -> None:
        if keep:
            first, *rest = text.split("\n")
            self._put(first)
            for line in rest:
                self._end(force=True)
                self._put(line)
            return
        if not text:
            return
        core = SPACE.sub(" ", text)
        if core[0] == " ":
            self.space = True
        core, tail = core.strip(" "), core[-1] == " "
        if core:
            self._put((" " if self.space and self.now else "") + core)
            self.space = False
        self.space |= tail

    def _put(self, text: str) -> None:
        if text:
            if not self.now:
                if self.gap:
                    if self.lines and self.lines[-1]:
                        self.lines.append("")
                    self.gap = False
                if self.marks:
                    self.now.append(self.base + "".join(self.marks))
                    self.marks = []
                else:
                    self.now.append(self.indent)
            self.now.append(text)

    def _end(self, force: bool = False) -> None:
        if self.now or force and not self.marks:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False

    def fresh(self) -> None:
        self._end()

    def blank(self) -> None:
        self._end()
        if not self.marks:
            self.gap = True

    def enter(self, mark: str) -> tuple[str, int, int]:
        """Begin an item; what `leave` needs."""
        self._end()
        before = (self.indent, len(self.lines), len(self.marks))
        if not self.marks:
            self.base = self.indent
        if len(self.indent) < 2 * self.layout.indent:
            self.indent += " " * len(mark)
        self.marks.append(mark)
        return before

    def leave(self, before: tuple[str, int, int], empty: str = "") -> None:
        """End an item; `empty` is its line if it had no text."""
        indent, n_lines, n_marks = before
        if len(self.marks) > n_marks and empty:
            self.marks[-1] = empty
            self._put(" ")
        if len(self.marks) > n_marks:
            self.marks.pop()
            self.space = False
        else:
            self._end()
            while len(self.lines) > n_lines and not self.lines[-1]:
                self.lines.pop()
            self.gap = False
        self.indent = indent

    def result(self) -> list[str]:
        self._end()
        lines, first, last = self.lines, 0, len(self.lines)
        while first < last and not lines[last - 1]:
            last -= 1
        while first < last and not lines[first]:
            first += 1
        return lines[first:last]


#: A step of the renderer: it hands back the steps it needs done first.
Step = Generator["Step", None, None]


def _run(step: Step) -> None:
    """Carry out a step and those that it asks for, without the interpreter's stack."""
    stack = [step]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _render(e: Element, out: Lines, pre: bool, nested: int) -> Step:
    if e.tag == "details" and "open" not in e.attributes:
        summary = next((x for x in e.children if isinstance(x, Element) and x.tag == "summary"), None)
        if summary and not summary.hidden:
            yield _render_element(summary, out, pre, nested)
        return
    for child in e.children:
        if isinstance(child, str):
            out.add(child, pre)
        elif child.tag == "br":
            out._end(force=True)
        elif not child.hidden:
            yield _render_element(child, out, pre, nested)


def _block(lines: list[str], out: Lines) -> None:
    """Ready lines, put as they are."""
    for line in lines:
        if line:
            out._put(line)
            out._end()
        else:
            out._end()
            out.lines.append("")


def _control(e: Element, out: Lines) -> None:
    """The text that an input shows."""
    if e.veiled:
        return
    kind = e.attributes.get("type", "text").strip().lower()
    if kind == "image":
        out.add(e.attributes.get("alt", ""))
    elif kind not in MUTE_INPUTS:
        value = e.attributes.get("value", BUTTON_TEXT.get(kind, "")) or ("" if kind in ("submit", "reset", "button") else e.attributes.get("placeholder", ""))
        out.add(f" {value} " if value.strip() else "")


def _options(e: Element) -> list[Element]:
    """The options that a select shows: all of a list box, the chosen one of a drop-down."""
    found: list[Element] = []
    stack = [e]
    while stack:
        x = stack.pop()
        if x.tag == "option" and not x.hidden:
            found.append(x)
        elif x is e or x.tag == "optgroup" and not x.hidden:
            stack += [c for c in reversed(x.children) if isinstance(c, Element)]
    size = e.attributes.get("size", "")
    if "multiple" in e.attributes or size.isdecimal() and size.isascii() and size.lstrip("0") not in ("", "1"):
        return found
    return ([x for x in found if "selected" in x.attributes][-1:] or found[:1])


def _render_element(e: Element, out: Lines, pre: bool, nested: int) -> Step:
    tag = e.tag
    if tag == "table":
        out.blank()
        if nested < out.layout.nested:
            yield _table(e, out, nested)
        else:
            yield _flat(e, out, nested)
        out.blank()
    elif tag in LISTS:
        inside = "\0nested" in e.attributes
        out.fresh() if inside else out.blank()
        yield _list(e, out, pre, nested)
        out.fresh() if inside else out.blank()
    elif tag == "input":
        _control(e, out)
    elif tag == "img":
        if not e.veiled:
            out.add(e.attributes.get("alt", ""))
    elif tag == "select":
        out.add(" ")
        many = len(shown := _options(e)) > 1
        for x in shown:
            if many:
                out.fresh()
            yield _render(x, out, pre, nested)
        out.fresh() if many else out.add(" ")
    elif tag in BLOCK:
        out.blank() if tag in SPACED else out.fresh()
        if tag == "dd":
            before = out.enter("  ")
            yield _render(e, out, pre, nested)
            out.leave(before)
        else:
            yield _render(e, out, pre or tag in ("pre", "textarea"), nested)
        out.blank() if tag in SPACED else out.fresh()
    else:
        yield _render(e, out, pre, nested)


def _list(e: Element, out: Lines, pre: bool, nested: int) -> Step:
    start = e.attributes.get("start", "")
    number = int(start) if re.fullmatch(r"-?\d{1,6}", start) else 1
    for child in e.children:
        if isinstance(child, str):
            out.add(child, pre)
        elif child.hidden:
            continue
        elif child.tag == "li":
            value = child.attributes.get("value", "")
            number = int(value) if re.fullmatch(r"-?\d{1,6}", value) else number
            mark = f"{number}. " if e.tag == "ol" else "- "
            number += 1
            for x in child.children:
                if isinstance(x, Element) and x.tag in LISTS:
                    x.attributes["\0nested"] = "1"
            if child.veiled:
                mark = " " * len(mark)
            before = out.enter(mark)
            yield _render(child, out, pre, nested)
            out.leave(before, mark.rstrip())
        else:
            yield _render_element(child, out, pre, nested)


def _stray(child: Element | str, before: Lines, nested: int) -> Step:
    """What stands in a table outside its cells is shown above it."""
    if isinstance(child, str):
        before.add(child)
    elif child.tag == "br":
        before._end(force=True)
    elif not child.hidden:
        yield _render_element(child, before, False, nested)


def _flat(e: Element, out: Lines, nested: int) -> Step:
    """A table without columns: each row a line, each cell's text behind the one before."""
    for child in e.children:
        if isinstance(child, str):
            out.add(child)
        elif child.hidden:
            continue
        elif child.tag in CELLS:
            out.add(" ")
            yield _render(child, out, False, nested)
            out.add(" ")
        elif child.tag == "tr" or child.tag in SECTIONS or child.holds and child.tag not in OWN_GRID:
            out.fresh()
            yield _flat(child, out, nested)
            out.fresh()
        else:
            yield _stray(child, out, nested)


def _grid(e: Element, rows: list[list[Element]], before: Lines, nested: int) -> Step:
    """Adds to rows the cells of each row in e, in order; other visible content goes to before.

    An element put between the parts of a table, as a form, is looked through. Rows that broken markup puts inside a row
    part it.
    """
    stack: list[tuple[Iterator, list[Element], bool]] = [(iter(e.children), [], False)]
    while stack:
        children, cells, in_row = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            # what is looked through inside a row shares the row's cells
            if cells and not (stack and stack[-1][1] is cells):
                rows.append(cells[:])
        elif isinstance(child, str):
            before.add(child)
        elif child.hidden:
            continue
        elif child.tag in CELLS:
            cells.append(child)
        elif child.tag == "tr" or child.tag in SECTIONS or child.holds and child.tag not in OWN_GRID and not in_row:
            if cells:
                rows.append(cells[:])
                cells.clear()
            stack.append((iter(child.children), [], child.tag == "tr"))
        elif child.holds and child.tag not in OWN_GRID:
            stack.append((iter(child.children), cells, True))
        else:
            yield _stray(child, before, nested)


def _number(e: Element, name: str, most: int) -> int:
    text = e.attributes.get(name, "1").strip()
    return min(int(text), most) if text.isascii() and text.isdecimal() and len(text) < 8 else 1


def _table(e: Element, out: Lines, nested: int) -> Step:
    before = Lines(out.layout)
    rows: list[list[Element]] = []
    yield _grid(e, rows, before, nested + 1)
    grid: list[list[tuple[int, list[str]]]] = []
    taken: list[int] = []
    for r, row in enumerate(rows):
        cells: list[tuple[int, list[str]]] = []
        at = 0
        for c in row:
            inner = Lines(out.layout)
            yield _render(c, inner, False, nested + 1)
            while at < len(taken) and taken[at] > r:
                at += 1
            cells.append((at, inner.result()))
            wide, down = max(1, _number(c, "colspan", MOST_COLUMNS)), _number(c, "rowspan", MOST_ROWSPAN)
            # cells that find no column any more stand behind the last one
            wide = min(wide, MOST_COLUMNS - at)
            if down != 1 and wide:
                taken += [0] * (at + wide - len(taken))
                taken[at : at + wide] = [r + (down or len(rows))] * wide
            at += wide
        grid.append(cells)
    widths: dict[int, int] = {}
    for k, lines in (cell for row in grid for cell in row):
        widths[k] = max(widths.get(k, 0), max((w for x in lines if (w := _width(x)) <= out.layout.pad), default=0))
    starts, place = {}, 0
    for k in sorted(widths):
        starts[k] = min(place, out.layout.line)
        # an empty column takes no place
        place += widths[k] + 2 if widths[k] else 0
    _block(before.result(), out)
    for row in grid:
        for j in range(max((len(lines) for _, lines in row), default=0)):
            parts, at = [], 0
            for k, lines in row:
                if j < len(lines) and lines[j]:
                    # a cell too wide for its column pushes the next one on
                    gap = max(starts[k] - at, 2 if parts else 0)
                    parts.append(" " * gap + lines[j])
                    at += gap + _width(lines[j])
            line = "".join(parts).rstrip()
            if line:
                out._put(line)
                out._end()
            else:
                out._end()
                out.lines.append("")


def render(page: str | None, layout: Layout = Layout()) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    out = Lines(layout)
    root = parse(page)
    if not root.hidden:
        _run(_render(root, out, False, 0))
    return "\n".join(out.result())


def render_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text", layout: Layout = Layout()) -> DataFrame:
    """pages with the rendered text in text_col in place of the HTML column; an existing text_col is replaced."""
    keep = [c for c in pages.columns if c not in (html_col, text_col)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices_of(batch, len(keep), 4 << 20):
                text = pa.array([render(p.as_py(), layout) for p in own.column(len(keep))], pa.string())
                yield pa.RecordBatch.from_arrays([*own.columns[: len(keep)], text], names=[*keep, text_col])

    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`"))
    schema = pages.select(*[F.col(f"`{c}`") for c in keep]).schema.add(text_col, "string")
    return rows.mapInArrow(run, schema)
