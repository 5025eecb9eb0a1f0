"""All visible text of HTML pages, laid out in lines: blocks, lists and aligned table cells."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element classes of the HTML standard that decide on nesting, visibility and layout.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
HIDDEN = frozenset("head script style template noscript noembed noframes iframe title datalist object audio video canvas".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table hr figure form fieldset".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body center details dialog dd div dt figcaption footer header hgroup html legend li main menu nav option optgroup search section summary caption".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "caption", "legend"}
#: An element that begins ends open elements of the second set, up to the nearest of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist", "table"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist", "table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]
SCOPE = frozenset({"table", "td", "th", "caption", "html", "template"})

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
NO_TEXT = frozenset("hidden password checkbox radio file range color image".split())  # fixed values: inputs that show no value; all others do
GAP = re.compile(r"[ \t\n\r\f]+")
WIDEST = 60  # columns are aligned up to this width; longer cells are written out whole and push the rest of their line


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(text)}


class Flow:
    """Lines of one block of text; a page has one, and so has every table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.space, self.bullet = 0, False, ""
        self.lists: list[list] = []  # [number or None, indent]

    def text(self, s: str) -> None:
        if s[0] in " \t\n\r\f":
            self.space = True
        words = GAP.sub(" ", s).strip(" ")
        if words:
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(words)
            self.space = s[-1] in " \t\n\r\f"

    def verbatim(self, s: str) -> None:
        first, *rest = s.split("\n")
        self.now.append(first)
        for line in rest:
            self.end_line(keep=True)
            self.now.append(line)

    def put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        indent = self.lists[-1][1] if self.lists else ""
        if self.bullet:
            indent, self.bullet = indent[: -len(self.bullet)] + self.bullet, ""
        self.lines.append(indent + line)

    def end_line(self, keep: bool = False) -> None:
        line, self.now, self.space = "".join(self.now), [], False
        if line.strip() or keep and (line or self.lines):
            self.put(line)

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)


def table_lines(rows: list[list[tuple[list[str], int]]]) -> Iterator[str]:
    """Rows of (lines, columns spanned) with cells padded to the width of their column."""
    widths: Counter = Counter()
    for row in rows:
        at = 0
        for lines, span in row:
            if span == 1:
                widths[at] = max(widths[at], min(WIDEST, max(map(len, lines), default=0)))
            at += span
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            out, at = [], 0
            for lines, span in row:
                width = sum(widths[at + i] for i in range(span)) + 2 * (span - 1)
                out.append((lines[k] if k < len(lines) else "").ljust(width))
                at += span
            if line := "  ".join(out).rstrip():
                yield line


class Page:
    """Builds the tree as a stack of open elements and lays the text out while it goes."""

    def __init__(self):
        self.open: list[str] = []
        self.count: Counter = Counter()
        self.flows, self.tables = [Flow()], []
        self.unseen_at: int | None = None  # depth of the outermost element that hides what it holds
        self.veils: list[tuple[int, bool]] = []  # depths of elements that say whether what they hold is visible; the last one counts
        self.pre = 0

    @property
    def veiled(self) -> bool:
        """An element of invisible text takes its place, and elements in it may be visible again."""
        return bool(self.veils) and self.veils[-1][1]

    @property
    def flow(self) -> Flow:
        return self.flows[-1]

    def start(self, tag: str, rest: str) -> None:
        if tag in CLOSES_P and self.count["p"]:
            self.close_within({"p"}, SCOPE)
        if tag in ENDS:
            self.close_within(*ENDS[tag])
        if tag in ("td", "th") and self.tables and self.count["tr"] < self.count["table"]:
            self.start("tr", "")
        attrs = attributes(rest) if rest and not rest.isspace() else {}
        self.open.append(tag)
        self.count[tag] += 1
        if self.unseen_at is None:
            if tag in HIDDEN or "hidden" in attrs or UNSEEN.search(attrs.get("style", "")):
                self.unseen_at = len(self.open)
            else:
                if found := VISIBILITY.findall(attrs.get("style", "")):
                    self.veils.append((len(self.open), found[-1].lower() != "visible"))
                self.show(tag, attrs)
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS | RAW and tag not in ENDS and tag != "table":
            self.pop()

    def show(self, tag: str, attrs: dict[str, str]) -> None:
        flow = self.flow
        if tag == "br":
            flow.end_line(keep=True)
        elif tag == "img":
            if attrs.get("alt", "").strip() and not self.veiled:
                flow.text(f" {attrs['alt']} ")
        elif tag == "input":
            if attrs.get("type", "").strip().lower() not in NO_TEXT and attrs.get("value", "").strip() and not self.veiled:
                flow.text(f" {attrs['value']} ")
        elif tag in ("ul", "ol", "menu"):
            flow.block(0 if flow.lists else 1)
            start = attrs.get("start", "")
            flow.lists.append([(int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if tag == "ol" else None, flow.lists[-1][1] if flow.lists else ""])
        elif tag == "li":
            flow.block(0)
            if not flow.lists:
                flow.lists.append([None, ""])
            own = flow.lists[-1]
            mark = "- " if own[0] is None else f"{own[0]}. "
            own[0] = None if own[0] is None else own[0] + 1
            flow.lists.append(["item", own[1] + " " * len(mark)])
            flow.bullet = mark
        elif tag == "table":
            flow.block(1)
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            span = attrs.get("colspan", "1")
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append(([], min(int(span), 1000) if re.fullmatch(r"[1-9]\d{0,8}", span) else 1))
            self.flows.append(Flow())
        elif tag in BLOCKS:
            flow.block(1 if tag in PARAGRAPHS else 0)
            self.pre += tag == "pre"

    def hide(self, tag: str) -> None:
        """What the end of a visible element does."""
        flow = self.flow
        if tag in ("ul", "ol", "menu"):
            flow.end_line()
            while flow.lists and flow.lists[-1][0] == "item" and len(flow.lists) > 1:
                flow.lists.pop()
            if flow.lists:
                flow.lists.pop()
            flow.block(0 if flow.lists else 1)
        elif tag == "li":
            flow.end_line()
            flow.bullet = ""
            if flow.lists and flow.lists[-1][0] == "item":
                flow.lists.pop()
        elif tag in ("td", "th") and len(self.flows) > 1 and self.tables:
            flow.end_line()
            self.flows.pop()
            self.tables[-1][-1][-1][0].extend(flow.lines)
        elif tag == "table" and self.tables:
            for line in table_lines(self.tables.pop()):
                self.flow.put(line)
            self.flow.block(1)
        elif tag in BLOCKS:
            flow.block(1 if tag in PARAGRAPHS else 0)
            self.pre -= tag == "pre"

    def pop(self) -> None:
        tag = self.open.pop()
        self.count[tag] -= 1
        if self.unseen_at is None:
            if tag not in VOID:
                self.hide(tag)
        elif len(self.open) < self.unseen_at:
            self.unseen_at = None
        while self.veils and len(self.open) < self.veils[-1][0]:
            self.veils.pop()

    def close_within(self, tags: set[str], until: frozenset | set) -> None:
        """End the outermost open element of ``tags`` that lies above the nearest of ``until``."""
        if not any(self.count[t] for t in tags):
            return
        depth = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] in tags:
                depth = k
            elif self.open[k] in until:
                break
        while depth is not None and len(self.open) > depth:
            self.pop()

    def end(self, tag: str) -> None:
        if tag == "p" and not self.count["p"]:
            self.start("p", "")
        if tag in VOID:
            if tag == "br":
                self.start("br", "")
            return
        if not self.count[tag]:
            return
        inner = tag not in SCOPE and tag not in ("tr", "tbody", "thead", "tfoot", "body")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] == tag:
                while len(self.open) > k:
                    self.pop()
                return
            if inner and self.open[k] in ("td", "th", "caption"):
                return

    def data(self, s: str) -> None:
        if self.unseen_at is None and not self.veiled:
            s = html.unescape(s) if "&" in s else s
            if self.pre:
                self.flow.verbatim(s.replace("\r\n", "\n"))
            elif s:
                self.flow.text(s)


def visible_text(source: str) -> str:
    """Lay out one page; markup that never ends and stray end tags are taken as browsers do."""
    page, at = Page(), 0
    low = None
    while at < len(source):
        m = TOKEN.match(source, at)
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                page.end(tag)
                continue
            page.start(tag, m[3])
            if tag in RAW:
                low = source.lower() if low is None else low
                if len(low) != len(source):  # a letter whose small form is longer
                    low = "".join(c if len(c.lower()) > 1 else c.lower() for c in source)
                stop = low.find(f"</{tag}", at)
                stop = len(source) if stop < 0 else stop
                page.data(source[at:stop])
                at = stop
        elif m[0][0] != "<" or len(m[0]) == 1:
            page.data(m[0])
    while page.open:
        page.pop()
    page.flow.end_line()
    return "\n".join(page.flow.lines)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html gives an empty text. Pages are independent, so repeated rows give repeated results
    and an empty table gives none. Columns other than page_id, url and html are not read.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(x.as_py() or "") for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(render, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text"))
