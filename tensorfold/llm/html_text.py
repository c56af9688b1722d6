"""HTML to text as it is laid out.

A tree builder with implied start and end tags turns markup into elements; visibility rules drop what a browser
wouldn't show (scripts, styles, templates, the head, ``hidden``, closed details, and what ``display`` and ``visibility``
say inline or in the page's own style sheets); the renderer writes the rest: white space collapsed as in CSS except in
``pre``, blocks on lines of their own, paragraphs, headings, lists and tables set off by an empty line, list items with
marker and indent, table cells aligned in columns, also beside cells that span rows.

Of style sheets, rules with a tag, class or id as selector count, or a compound of these; they cascade by importance,
specificity and order, inline styles above them. Rules inside ``@media`` and ``@supports`` count where their condition
names the screen or all media and nothing else, those in ``@layer`` always; other at-rules are skipped. ``display: none``
hides all inside; ``visibility`` is inherited and can be made visible again inside. ``hidden`` gives way to a
``display`` of the page's own.

Nulls and empty pages give the empty text. A page is scanned once from front to back, whatever its markup: time and
memory are linear in its length, and nothing recurses, so nesting may be as deep as it likes: beyond ``MOST_INDENTS``
levels lists aren't indented further. Cells wider than ``WIDE`` don't widen their column. Repeated rows come out
repeated; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes audio video canvas object datalist".split())
#: Set off by an empty line, and only by a line end.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure fieldset hr".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body center details dialog dd dir div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr caption".split())
#: By start tag: the open elements it ends, and those that end the search.
_TABLE = frozenset("table html".split())
_ENDS = {
    "li": ({"li"}, frozenset("ul ol menu dir table".split())),
    "dt": ({"dt", "dd"}, frozenset("dl table".split())),
    "dd": ({"dt", "dd"}, frozenset("dl table".split())),
    "option": ({"option"}, frozenset("select datalist optgroup".split())),
    "optgroup": ({"option", "optgroup"}, frozenset("select".split())),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, _TABLE),
    "td": ({"td", "th", "caption"}, _TABLE | {"tr"}),
    "th": ({"td", "th", "caption"}, _TABLE | {"tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, _TABLE),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, _TABLE),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, _TABLE),
    "body": ({"head"}, frozenset()),
}
_CLOSE_P = PARAGRAPHS | frozenset("address article aside center details dialog dir div fieldset figcaption footer form header hgroup main nav search section summary li dd dt".split())
_P_STOPS = frozenset("button table td th caption object template".split())
_CELL_PARTS = frozenset("table tr td th tbody thead tfoot caption".split())
_CELLS = frozenset("td th caption".split())
_HEAD_TAGS = frozenset("html head title base link meta style script noscript template".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Up to the next quote or the tag's end; a quote counts as such behind an equals sign.
_STOP = re.compile(r"""[>"']""")
_AFTER_EQUALS = re.compile(r"=\s*\Z")
_SPACE = re.compile(r"[ \t\n\r\f]+")
MOST_INDENTS, WIDE = 20, 60


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


class _Scanner:
    """Finds the tokens of a page in one pass: what isn't found ahead once is never looked for again."""

    def __init__(self, html: str):
        self.html, self.n, self.gone = html, len(html), set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        i = self.html.find(what, at)
        if i < 0:
            self.gone.add(what)
        return i

    def tag_end(self, at: int) -> int:
        """Behind the ``>`` of a tag whose attributes start at ``at``; -1 if none follows. Quoted values may hold ``>``."""
        if self.find(">", at) < 0:
            return -1
        html, first = self.html, at
        while m := _STOP.search(html, at):
            if m[0] == ">":
                return m.end()
            # At most the white space before a quote is looked at again.
            back = m.start() - 1
            while back >= first and html[back] in " \t\n\r\f":
                back -= 1
            at = m.end()
            if back >= first and html[back] == "=":
                close = self.find(m[0], at)
                if close >= 0:
                    at = first = close + 1
                else:
                    first = at
        return -1

    def next(self, at: int):
        """(start, end, kind, name, attributes) of the next token; kind is "/" for end tags, "" for start tags, "!" else."""
        html = self.html
        while (i := self.find("<", at)) >= 0:
            c = html[i + 1 : i + 2]
            if c == "!" or c == "?":
                if html.startswith("<!--", i):
                    if html.startswith((">", "->"), i + 4):
                        return i, html.index(">", i + 4) + 1, "!", "", ""
                    ends = [(e, e + len(s)) for s in ("-->", "--!>") if (e := self.find(s, i + 4)) >= 0]
                    return i, min(ends)[1] if ends else self.n, "!", "", ""
                end = self.find(">", i)
                if end >= 0:
                    return i, end + 1, "!", "", ""
            else:
                slash = c == "/"
                if (m := _NAME.match(html, i + 1 + slash)) and (end := self.tag_end(m.end())) >= 0:
                    return i, end, "/" if slash else "", m[0], html[m.end() : end - 1]
            at = i + 1
        return None


def parse(html: str) -> Element:
    """The document's elements; text is in plain strings."""
    root, scan = Element("#root", {}), _Scanner(html)
    stack, at, n = [root], 0, len(html)
    #: How many elements of each tag are open.
    opened: Counter[str] = Counter()

    def close(to: int) -> None:
        for e in stack[to:]:
            opened[e.tag] -= 1
        del stack[to:]

    def end(tags, stops=frozenset()) -> bool:
        """Close the nearest open element among ``tags`` that isn't beyond one of ``stops``."""
        if not any(opened[t] for t in tags):
            return False
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                close(i)
                return True
            if stack[i].tag in stops:
                return False
        return False

    def text(value: str) -> None:
        if not value:
            return
        if stack[-1].tag == "head" and value.strip(" \t\n\r\f"):
            close(len(stack) - 1)
        stack[-1].children.append(unescape(value))

    def push(element: Element) -> None:
        stack[-1].children.append(element)
        stack.append(element)
        opened[element.tag] += 1

    while at < n:
        token = scan.next(at)
        if token is None:
            text(html[at:])
            break
        start, stop, kind, name, attributes = token
        text(html[at:start])
        at = stop
        if kind == "!":
            continue
        tag = name.lower()
        if kind:
            if tag == "br":
                stack[-1].children.append(Element("br", {}))
            elif tag == "p" and not opened["p"]:
                stack[-1].children.append(Element("p", {}))
            elif tag not in ("html", "body"):
                # A cell's inner end tags don't reach out of the cell.
                end({tag}, frozenset() if tag in _CELL_PARTS else _CELLS)
            continue
        attrs = _attributes(attributes) if attributes and not attributes.isspace() else {}
        if stack[-1].tag == "head" and tag not in _HEAD_TAGS:
            close(len(stack) - 1)
        if tag in _CLOSE_P:
            end({"p"}, _P_STOPS)
        if tag in _ENDS:
            tags, stops = _ENDS[tag]
            while end(tags, stops):
                pass
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Element("tr", {}))
        element = Element(tag, attrs)
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS and tag not in RAW:
            stack[-1].children.append(element)
        elif tag in RAW:
            stack[-1].children.append(element)
            low = at
            while (i := scan.find("</", low)) >= 0 and not (html[i + 2 : i + 2 + len(tag)].lower() == tag and html[i + 2 + len(tag) : i + 3 + len(tag)] in (" ", "\t", "\n", "\r", "\f", "/", ">")):
                low = i + 2
            value = html[at:i] if i >= 0 else html[at:]
            element.children.append(unescape(value) if tag in ("textarea", "title") else value)
            at = (scan.find(">", i) + 1 or n) if i >= 0 else n
        else:
            push(element)
    return root


# ---- visibility ------------------------------------------------------------------------------------------------

_SCREEN = frozenset(("", "all", "screen", "only screen", "only all"))
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_SIMPLE = re.compile(r"([.#])([\w-]+)")
_BRACES = re.compile(r"[{}]")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)


def _declared(body: str) -> dict[str, tuple[bool, bool]]:
    """(shown, important) by property of a declaration block, of ``display`` and ``visibility``; the last one wins."""
    found: dict[str, tuple[bool, bool]] = {}
    for part in body.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if not colon or name not in ("display", "visibility"):
            continue
        value, bang, important = value.strip().lower().partition("!")
        value, weight = value.strip(), bool(bang) and important.strip() == "important"
        if value and (name not in found or weight or not found[name][1]):
            found[name] = (value != "none" if name == "display" else value not in ("hidden", "collapse"), weight)
    return found


def style_rules(sheet: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of the rules of a sheet that hold on a screen, in order; one pass."""
    sheet, out, at, depth, skipped = _COMMENT.sub("", sheet), [], 0, 0, None
    head = 0
    while m := _BRACES.search(sheet, at):
        at = m.end()
        if m[0] == "}":
            depth -= 1
            if skipped is not None and depth <= skipped:
                skipped = None
            depth, head = max(depth, 0), at
            continue
        prelude = sheet[head : m.start()].rpartition(";")[2].strip() if "@" in sheet[head : m.start()] else sheet[head : m.start()].strip()
        head = at
        if prelude.startswith("@"):
            name, _, condition = prelude.partition(" ")
            name, holds = name.lower(), False
            if name == "@media":
                holds = not _SCREEN.isdisjoint(" ".join(c.split()).lower() for c in condition.split(","))
            elif name in ("@layer", "@supports"):
                holds = name == "@layer"
            if not holds and skipped is None:
                skipped = depth
            depth += 1
        else:
            close = sheet.find("}", at)
            body = sheet[at : close if close >= 0 else len(sheet)]
            inner = body.find("{")
            if inner >= 0:
                # A nested rule: what comes before it are declarations.
                depth += 1
                body = body[:inner]
            elif close < 0:
                at = len(sheet)
            else:
                at = head = close + 1
            if skipped is None:
                out.append((prelude, body))
    return out


class Sheets:
    """What a page's own style sheets say about ``display`` and ``visibility``."""

    def __init__(self, root: Element):
        #: By the selector's id, else class, else tag: (other parts, property, rank, shown).
        self.rules: dict[str, list] = {}
        self.any: list = []
        todo, sheets = [root], []
        while todo:
            e = todo.pop()
            if e.tag == "style":
                if not _SCREEN.isdisjoint(" ".join(x.split()).lower() for x in e.attrs.get("media", "").split(",")):
                    sheets.append("".join(c for c in e.children if isinstance(c, str)))
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]
        order = 0
        for sheet in sheets:
            for selectors, body in style_rules(sheet):
                said = _declared(body)
                if not said:
                    continue
                for s in selectors.split(","):
                    order += 1
                    if (m := _COMPOUND.fullmatch(s.strip())) and s.strip():
                        self._add(m, said, order)

    def _add(self, m: re.Match, said: dict, order: int) -> None:
        tag = (m[1] or "*").lower()
        parts = _SIMPLE.findall(m[2])
        ids, classes = [n for k, n in parts if k == "#"], [n for k, n in parts if k == "."]
        weight = (len(ids), len(classes), tag != "*")
        key = f"#{ids[0]}" if ids else f".{classes[0]}" if classes else tag
        for name, (shown, important) in said.items():
            rule = (tag, ids, classes, name, (important, 0, *weight, order), shown)
            (self.any if key == "*" else self.rules.setdefault(key, [])).append(rule)

    def of(self, e: Element) -> dict[str, bool]:
        """What holds for an element: by property, whether it is shown."""
        a, best = e.attrs, {}
        own = a.get("id")
        classes = a.get("class", "").split() if a else []
        found = [*self.any, *self.rules.get(e.tag, ())] if self.rules or self.any else []
        if own is not None or classes:
            for key in dict.fromkeys([f"#{own}", *(f".{c}" for c in classes)]):
                found += self.rules.get(key, ())
        for tag, ids, names, name, rank, shown in found:
            if (tag == "*" or tag == e.tag) and all(i == own for i in ids) and all(c in classes for c in names) and (name not in best or rank > best[name][0]):
                best[name] = rank, shown
        if a and "style" in a:
            for name, (shown, important) in _declared(a["style"]).items():
                if name not in best or (important, 1) >= best[name][0][:2]:
                    best[name] = (important, 1), shown
        return {name: shown for name, (_, shown) in best.items()}


# ---- layout ----------------------------------------------------------------------------------------------------


class Writer:
    """Lines of text with collapsed white space, block spacing and indents."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.blank = False
        self.indents: list[str] = []
        self.marker: str | None = None

    def start(self) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        if self.marker is not None:
            self.parts.append("".join(self.indents[:-1]) + self.marker)
            self.marker = None
        elif self.indents:
            self.parts.append("".join(self.indents))

    def text(self, value: str) -> None:
        words = _SPACE.sub(" ", value)
        if words[:1] == " ":
            self.space = bool(self.parts)
            words = words[1:]
        if not words:
            return
        trailing = words[-1] == " "
        words = words.rstrip(" ")
        if not self.parts:
            self.start()
        elif self.space:
            self.parts.append(" ")
        self.parts.append(words)
        self.space = trailing

    def verbatim(self, value: str) -> None:
        first, *rest = value.split("\n")
        for i, line in enumerate([first, *rest]):
            if i:
                self.line(keep=True)
            if line:
                if not self.parts:
                    self.start()
                self.parts.append(line)
        self.space = False

    def line(self, keep: bool = False) -> None:
        """End the line; an empty one stays only if asked for."""
        if self.parts:
            self.lines.append("".join(self.parts).rstrip(" "))
            self.parts = []
        elif keep and self.lines:
            self.blank = False
            self.lines.append("")
        self.space = False

    def paragraph(self) -> None:
        self.line()
        self.blank = True

    def finish(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(text: str | None, otherwise: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?\d{1,9}\s*", text) else otherwise


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[list[str], int, int]]]:
    """(lines, first column, columns) of each row's cells; cells that span rows take their columns in those below."""
    out, taken = [], {}
    for i, row in enumerate(rows):
        at, placed = 0, []
        for lines, span, down in row:
            while taken.get(at, 0) > i:
                at += 1
            placed.append((lines, at, span))
            if down > 1:
                for c in range(at, at + span):
                    taken[c] = i + down
            at += span
        out.append(placed)
    return out


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """The lines of a table: two spaces between columns, cells of several lines side by side."""
    placed = _placed(rows)
    widths: dict[int, int] = {}
    for row in placed:
        for lines, at, span in row:
            widest = max((len(x) for x in lines), default=0)
            if span == 1 and widest <= WIDE:
                widths[at] = max(widths.get(at, 0), widest)
    most = max((at + span for row in placed for _, at, span in row), default=0)
    begin = [0]
    for c in range(most):
        begin.append(begin[-1] + widths.get(c, 0) + 2)
    out = []
    for row in placed:
        for k in range(max((len(lines) for lines, _, _ in row), default=0)):
            line = ""
            for lines, at, _ in row:
                if k < len(lines) and lines[k]:
                    line = line.ljust(begin[at]) + ("  " if line and len(line) > begin[at] else "") + lines[k]
            out.append(line.rstrip())
    return out


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    root = parse(html)
    sheets = Sheets(root)
    writers, tables, lists = [Writer()], [], []
    # Elements wait with the visibility that they inherit.
    todo: list = [("node", root, True)]
    while todo:
        kind, node, visible = todo.pop()
        w = writers[-1]
        if kind == "node" and isinstance(node, str):
            if visible:
                w.text(node)
        elif kind == "pre" and isinstance(node, str):
            if visible:
                w.verbatim(node)
        elif kind in ("end", "cell"):
            tag = node.tag
            if kind == "cell":
                done = writers.pop().finish()
                if not tables[-1]:
                    tables[-1].append([])
                span = min(max(_number(node.attrs.get("colspan"), 1), 1), 1000)
                tables[-1][-1].append((done, span, min(max(_number(node.attrs.get("rowspan"), 1), 1), 65534)))
            elif tag == "table":
                for i, line in enumerate(_aligned(tables.pop())):
                    if i:
                        w.line(keep=True)
                    if line:
                        w.verbatim(line)
                w.paragraph()
            elif tag == "li":
                if w.marker is not None:
                    if visible:
                        w.start()
                    w.marker = None
                w.line()
                w.indents.pop()
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                w.line() if lists else w.paragraph()
            elif tag == "dd":
                w.line()
                w.indents.pop()
            elif tag in PARAGRAPHS:
                w.paragraph()
            else:
                w.line()
        else:
            tag, children = node.tag, node.children
            if tag in UNSEEN:
                continue
            said = sheets.of(node)
            if not said.get("display", not ("hidden" in node.attrs or tag == "dialog" and "open" not in node.attrs)):
                continue
            visible = said.get("visibility", visible)
            if tag == "br":
                w.line(keep=True)
                continue
            if tag == "input":
                if visible and node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                    w.text(node.attrs.get("value", ""))
                continue
            if tag in ("td", "th") and tables:
                writers.append(Writer())
                todo.append(("cell", node, visible))
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag == "table":
                w.paragraph()
                tables.append([])
                todo.append(("end", node, visible))
            elif tag in ("ul", "ol", "menu", "dir"):
                w.line() if lists else w.paragraph()
                lists.append([tag, _number(node.attrs.get("start"), 1), -1 if "reversed" in node.attrs else 1])
                todo.append(("end", node, visible))
            elif tag == "li":
                w.line()
                own = lists[-1] if lists else ["ul", 1, 1]
                value = _number(node.attrs.get("value"), own[1])
                own[1] = value + own[2]
                w.marker = f"{value}. " if own[0] == "ol" else "- "
                w.indents.append(" " * len(w.marker) if len(w.indents) < MOST_INDENTS else "")
                todo.append(("end", node, visible))
            elif tag == "dd":
                w.line()
                w.indents.append("  " if len(w.indents) < MOST_INDENTS else "")
                todo.append(("end", node, visible))
            elif tag in BLOCKS:
                w.paragraph() if tag in PARAGRAPHS else w.line()
                todo.append(("end", node, visible))
            if tag in ("pre", "textarea", "xmp"):
                todo += [("pre" if isinstance(c, str) else "node", c.removeprefix("\n") if isinstance(c, str) and i == 0 else c, visible) for i, c in reversed(list(enumerate(children)))]
            elif tag == "details" and "open" not in node.attrs:
                todo += [("node", c, visible) for c in children if isinstance(c, Element) and c.tag == "summary"][:1]
            else:
                todo += [("node", c, visible) for c in reversed(children)]
    return "\n".join(writers[0].finish()).replace("\xa0", " ")


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text) of each row: the visible text. A projection without shuffle."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(h) for h in part.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    rows = pages.select(pages[page_id].cast("bigint").alias("page_id"), pages[html].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, text string")


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    """The visible text of every page, and its lines."""
    text = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return text.withColumn("lines", F.when(F.col("text") == "", 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1))
