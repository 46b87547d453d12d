"""Layout-aware text of HTML pages.

A tokenizer feeds a tree builder that closes and opens implied elements (paragraphs, list items, table
parts, unclosed tags at the end) and moves what a table cannot hold in front of it. Rendering walks the
tree: invisible parts are left out, every other text appears. Invisible are head matter, scripts,
``hidden``, ``aria-hidden``, hidden inputs, and what ``display:none`` or an inherited ``visibility``
hides, in ``style`` attributes or in the page's own style sheets (rules whose selector is one tag, id
and classes; other selectors hide nothing). Of SVG the ``text`` shows, of MathML all but annotations,
of a choice list the chosen option, of input fields the value that a reader can see.
Blocks stand on lines of their own, paragraphs and headings with a blank line around them, list items
behind a bullet or number and indented by depth (to ``DEEPEST`` levels), cells of a table in columns
padded to the widest cell, over spanned columns and rows; ``pre`` text as it is.

Nulls and edges: a null page gives an empty text; broken markup never fails; deep nesting is walked
without recursion; a page of any length is read whole.
"""

import hashlib
import html
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from logweave.llm.textscan import slices

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INVISIBLE = frozenset("head script style template noscript title meta link base datalist noembed noframes iframe object audio video canvas annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside details dialog dd div dt figcaption footer form header hgroup hr li main nav section summary center legend tr caption menu thead tbody tfoot".split())
CLOSES_P = (BLOCK - frozenset("tr caption thead tbody tfoot html body".split()))
# An element that opens closes the open ones on the right, up to the nearest element in the third column.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
# The open elements under which a table part belongs; all that is open within them ends.
_ROWS = frozenset("tbody thead tfoot table".split())
HOLDERS = {"td": _ROWS | {"tr"}, "th": _ROWS | {"tr"}, "tr": _ROWS} | dict.fromkeys("tbody thead tfoot caption colgroup col".split(), frozenset(["table"]))
TABLE_LEVEL = _ROWS | {"tr"}
TABLE_OWN = frozenset("caption colgroup col tbody thead tfoot tr td th style script template".split())
# HTML elements that end SVG and MathML, and elements of those that may hold HTML.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
SVG_UNSHOWN = frozenset("defs symbol desc metadata clippath mask pattern marker".split())
NO_VALUE = frozenset("hidden checkbox radio password file range color image".split())
DEEPEST = 40
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # of one cell's span
FENCES = frozenset("table td th caption button object template html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_RULE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_SHEET = re.compile(r"/\*.*?(?:\*/|\Z)|([^{};]*)(?:([{};])|\Z)", re.S)
_SPACES = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag, attrs=""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self):
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attrs)}


class Styles:
    """What hides elements: attributes, ``style`` attributes and the rules of style sheets."""

    def __init__(self, sheets):
        self.rules = {}  # by the id, class or tag that an element must have
        for order, (selector, body) in enumerate(rule for sheet in sheets for rule in _rules(sheet)):
            said = {m[1].lower(): (bool(m[3]), m[2].lower()) for m in _RULE.finditer(body)}
            for one in selector.split(",") if said else ():
                m = _COMPOUND.fullmatch(one.strip())
                if not m or not m[0]:
                    continue
                marks = re.findall(r"[.#][\w-]+", m[2])
                tag = "" if m[1] in (None, "*") else m[1].lower()
                weight = (sum(k[0] == "#" for k in marks), sum(k[0] == "." for k in marks), bool(tag), order)
                self.rules.setdefault(marks[0] if marks else tag or "*", []).append((tag, set(marks), weight, said))

    def of(self, node):
        """Whether an element is left out with all in it, and its own visibility, None if it says nothing."""
        if node.tag in INVISIBLE:
            return True, None
        if not node.attrs and not self.rules:
            return False, None
        a = node.attributes() if node.attrs else {}
        if a.get("aria-hidden", "").lower() == "true" or node.tag == "input" and a.get("type", "").lower() == "hidden":
            return True, None
        said = {"display": [((False, False), "none")]} if "hidden" in a else {}
        for m in _RULE.finditer(a.get("style", "")):
            said.setdefault(m[1].lower(), []).append(((bool(m[3]), True, m.start()), m[2].lower()))
        if self.rules:
            marks = {"." + c for c in a.get("class", "").split()} | ({"#" + a["id"]} if a.get("id") else set())
            for key in (*marks, node.tag, "*"):
                for tag, wanted, weight, rule in self.rules.get(key, ()):
                    if tag in ("", node.tag) and wanted <= marks:
                        for name, (important, value) in rule.items():
                            said.setdefault(name, []).append(((important, False, weight), value))
        display, visibility = (max(said[n])[1] if n in said else None for n in ("display", "visibility"))
        return display == "none", None if visibility in (None, "inherit", "unset") else visibility in ("visible", "initial")


def _rules(sheet):
    """Selectors and bodies of a style sheet; of conditional groups only those for every screen."""
    groups, selector = [], None
    for m in _SHEET.finditer(sheet):
        head, mark = (m[1] or "").strip(), m[2]
        if selector is not None:
            if mark == "{":
                selector = None  # a nested rule is not read
                groups.append(False)
            elif mark == "}":
                yield selector, body + head
                selector = None
            else:
                body += head + ";"
        elif mark == "{":
            if head.startswith("@"):
                groups.append(re.fullmatch(r"@media\s+(all|screen)|@layer\b.*", head, re.I | re.S) is not None)
            elif all(groups):
                selector, body = head, ""
            else:
                groups.append(False)
        elif mark == "}" and groups:
            groups.pop()


def parse(page):
    """The tree of a page, and its style sheets."""
    root = Node("html")
    stack = [root]
    count = Counter()  # open elements by tag
    sheets = []

    def add(node):
        """Put a text or element where it belongs: what a table can't hold goes in front of it."""
        if stack[-1].tag in TABLE_LEVEL and count["table"] and (node.strip() if isinstance(node, str) else node.tag not in TABLE_OWN):
            i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "table")
            before = stack[i - 1].children  # the table, still open, is the last of them
            before.insert(len(before) - 1, node)
        else:
            stack[-1].children.append(node)

    def push(node):
        add(node)
        stack.append(node)
        count[node.tag] += 1

    def pop(i):
        count.subtract(s.tag for s in stack[i:])
        del stack[i:]

    def close(tags, fence):
        """Close the nearest open element of ``tags`` and all within it, unless a fence comes first."""
        if not any(count[t] for t in tags):
            return False
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                pop(i)
                return True
            if stack[i].tag in fence:
                return False
        return False
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(html.unescape(page[at:]))
            break
        if m.start() > at:
            add(html.unescape(page[at:m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not count["p"]:
                add(Node("p"))
            elif tag == "br":
                add(Node("br"))
            else:
                close({tag}, {"table"} if tag not in ("table", "body", "html") else ())
            continue
        if tag == "html":
            continue
        if tag in ENDS_FOREIGN and (count["svg"] or count["math"]):
            close({"svg", "math"}, HOLDS_HTML)
        if tag in HOLDERS and count["table"]:
            pop(1 + next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in HOLDERS[tag]))
        if tag in CLOSES_P:
            close({"p"}, FENCES)
        if tag == "table" and stack[-1].tag in TABLE_LEVEL:
            close({"table"}, ())
        if tag[0] == "h" and tag[1:] in "123456" and len(tag) == 2 and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            pop(-1)
        if tag in IMPLIED:
            while close(*IMPLIED[tag]):
                pass
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push(Node("tr"))
        if tag not in ("html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template") and stack[-1].tag == "head":
            pop(-1)
        node = Node(tag, m[3] or "")
        in_table = stack[-1].tag in TABLE_LEVEL and count["table"]
        if tag == "form" and in_table:
            continue  # holds nothing there
        push(node)
        if tag in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?|\Z", re.I).search(page, at)
            text = page[at:end.start()]
            node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            if tag == "style" and node.attributes().get("media", "all").strip().lower() in ("", "all", "screen"):
                sheets.append(text)
            at = end.end()
            pop(-1)
        elif tag in VOID or m[0].endswith("/>") and tag not in BLOCK:
            pop(-1)
    return root, sheets


class _Lines:
    """Text laid out in lines: words of inline text, breaks and blank lines between blocks."""

    def __init__(self):
        self.lines, self.now, self.gap, self.space = [], [], 0, False

    def text(self, text, pre=False):
        if pre:
            first, *rest = text.split("\n")
            self._put(first)
            for line in rest:
                self.flush(True)
                self._put(line)
            return
        words = _SPACES.sub(" ", text)
        if words.startswith(" "):
            self.space = True
            words = words[1:]
        if words.rstrip(" "):
            self._put((" " if self.space and self.now else "") + words.rstrip(" "))
            self.space = words.endswith(" ")

    def _put(self, text):
        if text:
            if not self.now and self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            self.now.append(text)

    def flush(self, force=False):
        if self.now or force:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False

    def block(self, gap):
        self.flush()
        self.gap = max(self.gap, gap)

    def done(self):
        self.flush()
        return self.lines


def _table(node, styles, shown):
    """Rows of a table as lists of ``(cell, shown)``, without those of tables inside, and its captions alike."""
    rows, captions, todo = [], [], [(node, shown)]
    while todo:
        this, shown = todo.pop()
        if this.tag == "tr":
            rows.append([])
        elif this.tag in ("td", "th"):
            rows[-1].append((this, shown))
            continue
        elif this.tag == "caption":
            captions.append((this, shown))
            continue
        for child in reversed(this.children):
            if isinstance(child, Node) and child.tag in TABLE_OWN:
                gone, own = styles.of(child)
                if not gone:
                    todo.append((child, shown if own is None else own))
    return rows, captions


def _chosen(node, styles):
    """The options of a choice list that show: all of an open list, else the last selected, else the first."""
    options, todo = [], [node]
    while todo:
        this = todo.pop()
        if this.tag == "option":
            options.append(this)
        else:
            todo.extend(c for c in reversed(this.children) if isinstance(c, Node) and not styles.of(c)[0])
    a = node.attributes() if node.attrs else {}
    if "multiple" in a or re.fullmatch(r"[2-9]|[1-9]\d+", a.get("size", "").strip()):
        return options
    selected = [o for o in options if o.attrs and "selected" in o.attributes()]
    return selected[-1:] or options[:1]


def _svg_texts(node, styles, shown):
    """The texts of a drawing, each with its visibility."""
    todo = [(node, shown)]
    while todo:
        this, shown = todo.pop()
        if this.tag in ("text", "foreignobject"):
            yield this, shown
            continue
        for child in reversed(this.children):
            if isinstance(child, Node) and child.tag not in SVG_UNSHOWN:
                gone, own = styles.of(child)
                if not gone:
                    todo.append((child, shown if own is None else own))


def render(page):
    """Visible text of a page."""
    root, sheets = parse(page or "")
    return "\n".join(_walk(root, Styles(sheets))).strip("\n")


def _walk(root, styles, shown=True):
    """Lines of a subtree. A frame of the stack is a node's children still to come, what to do at its end,
    whether blanks stay and whether texts show."""
    out = _Lines()
    frames = [(iter(root.children), None, False, shown)]
    results = []  # outer line buffers, for tables and list items
    lists = []
    while frames:
        children, end, pre, shown = frames[-1]
        node = next(children, None)
        if node is None:
            frames.pop()
            if end:
                out = end(out)
            continue
        if isinstance(node, str):
            if shown:
                out.text(node, pre)
            continue
        tag = node.tag
        gone, own = styles.of(node)
        if gone:
            continue
        shown = shown if own is None else own
        if tag == "br":
            out.flush(True)
        elif tag == "hr":
            out.block(1)
        elif tag in ("img", "area"):
            alt = node.attributes().get("alt", "") if "alt" in node.attrs.lower() else ""
            if shown:
                out.text(alt)
        elif tag == "input":
            a = node.attributes()
            if shown and a.get("type", "").lower() not in NO_VALUE:
                out.text(a.get("value", "") or a.get("placeholder", ""))
        elif tag == "select":
            for i, option in enumerate(_chosen(node, styles)):
                if shown:
                    out.text((" " if i else "") + " ".join(" ".join(_strings(option, styles)).split()))
        elif tag == "svg":
            for text, seen in _svg_texts(node, styles, shown):
                for line in _cell(text, styles, seen):
                    out.block(1)
                    out.text(line, True)
                    out.block(1)
        elif tag in ("ul", "ol", "menu"):
            out.block(1 if lists else 2)
            start = node.attributes().get("start", "1") if tag == "ol" and node.attrs else "1"
            lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])

            def end(lines, gap=1 if len(lists) > 1 else 2):
                lists.pop()
                lines.block(gap)
                return lines
            frames.append((iter(node.children), end, pre, shown))
        elif tag in ("li", "dd", "blockquote") and len(results) < DEEPEST:
            mark = "  "
            if tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    value = node.attributes().get("value", "") if node.attrs else ""
                    if re.fullmatch(r"-?\d{1,9}", value):
                        lists[-1][1] = int(value)
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
            out.block(2 if tag == "blockquote" else 1)
            results.append(out)

            def end(lines, mark=mark, quote=tag == "blockquote"):
                outer, inner = results.pop(), lines.done()
                while inner and not inner[0]:
                    inner.pop(0)
                for i, line in enumerate(inner):
                    outer.text((mark if i == 0 else " " * len(mark)) + line if line else "", True)
                    outer.flush(True)
                outer.block(2 if quote else 1)
                return outer
            out = _Lines()
            frames.append((iter(node.children), end, pre, shown))
        elif tag == "table":
            out.block(2)
            rows, captions = _table(node, styles, shown)
            for cell, seen in captions:
                for line in _cell(cell, styles, seen):
                    out.text(line, True)
                    out.flush(True)
            for line in _aligned([[(*_span(c), _cell(c, styles, seen)) for c, seen in row] for row in rows]):
                out.text(line, True)
                out.flush(True)
            out.block(2)
        elif tag in BLOCK:  # also list items below DEEPEST levels
            gap = 2 if tag in SPACED else 1
            out.block(gap)

            def end(lines, gap=gap):
                lines.block(gap)
                return lines
            frames.append((iter(node.children), end, pre or tag == "pre", shown))
        else:
            frames.append((iter(node.children), None, pre, shown))
    return out.done()


_DEPTH = [0]


def _cell(node, styles, shown):
    """Lines of a table cell; tables nested deeper than half ``DEEPEST`` are laid out as plain blocks."""
    inner = Node("div")
    inner.children = node.children
    if _DEPTH[0] >= DEEPEST // 2:
        return [" ".join(" ".join(_strings(inner, styles, shown)).split())]
    _DEPTH[0] += 1
    try:
        lines = _walk(inner, styles, shown)
    finally:
        _DEPTH[0] -= 1
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return lines


def _strings(node, styles, shown=True):
    todo = [(node, shown)]
    while todo:
        this, shown = todo.pop()
        if isinstance(this, str):
            if shown:
                yield this
            continue
        gone, own = styles.of(this)
        if not gone:
            todo.extend((c, shown if own is None else own) for c in reversed(this.children))


def _span(cell):
    """Columns and rows that a cell covers; 0 rows are all that follow."""
    a = cell.attributes() if "span" in cell.attrs.lower() else {}
    columns, rows = (int(v) if re.fullmatch(r"\d{1,9}", v := a.get(n, "1").strip()) else 1 for n in ("colspan", "rowspan"))
    return min(max(columns, 1), MOST_COLUMNS), min(rows, MOST_ROWS) or MOST_ROWS


def _width(text):
    """Places that a text takes on a screen of fixed pitch."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _aligned(rows):
    """Lines of a grid of cells ``(columns, rows, lines)``; a column is as wide as the widest line that it alone holds,
    and the last column under a wider cell makes up for it. Columns in which no cell starts take no room."""
    placed, covered = [], {}  # covered: column -> rows still covered from above
    for row in rows:
        cells, at = [], 0
        for columns, down, lines in row:
            while covered.get(at):
                at += 1
            cells.append((at, columns, lines))
            for c in range(at, at + columns) if down > 1 else ():
                covered[c] = max(covered.get(c, 0), down)
            at += columns
        placed.append(cells)
        covered = {c: n - 1 for c, n in covered.items() if n > 1}
    number = {c: i for i, c in enumerate(sorted({at for cells in placed for at, _, _ in cells}))}
    widths = [0] * len(number)
    spans = []
    for cells in placed:
        for at, columns, lines in cells:
            wide = max(map(_width, lines), default=0)
            held = [number[c] for c in range(at, at + columns) if c in number] if columns > 1 else [number[at]]
            if len(held) > 1:
                spans.append((held, wide))
            else:
                widths[held[0]] = max(widths[held[0]], wide)
    for held, wide in spans:
        widths[held[-1]] += max(0, wide - sum(widths[i] for i in held) - 2 * (len(held) - 1))
    begins = [0]
    for w in widths:
        begins.append(begins[-1] + w + 2)
    for cells in placed:
        for k in range(max([len(lines) for _, _, lines in cells], default=0)):
            line, wide = [], 0
            for at, _, lines in cells:
                if k < len(lines) and lines[k]:
                    begin = begins[number[at]]
                    line += [" " * (begin - wide), lines[k]]
                    wide = max(begin, wide) + _width(lines[k])
            yield "".join(line).rstrip()


def extract(pages):
    """``page_id, text, n_chars, n_lines, text_sha256`` of every page (page_id, html)."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [render(p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column("page_id"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                    pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in texts], pa.string())],
                    ["page_id", "text", "n_chars", "n_lines", "text_sha256"])
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "html")
    return plain.mapInArrow(run, "page_id long, text string, n_chars long, n_lines long, text_sha256 string")
