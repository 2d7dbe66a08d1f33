"""Page extraction: one pass of the standard-library parser per page, in Arrow batches.

The parser does not repair markup the way browsers do. The rules used here: void elements never
nest; a start tag closes an innermost open element listed in IMPLIED_END; an end tag closes up to
its matching open element and is ignored when there is none.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.batches import in_slices

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text is never part of get-text style output.
SILENT = frozenset(("script", "style", "template"))
# Elements that are not main content.
BOILERPLATE = SILENT | frozenset("head title noscript svg nav footer aside form iframe button".split())
BLOCKS = frozenset(
    "address article blockquote body br center dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr "
    "html li main ol p pre section table tbody td tfoot th thead tr ul".split()
)
CLOSES_PARAGRAPH = BLOCKS - frozenset(("body", "html", "br", "td", "th", "tr", "tbody", "thead", "tfoot"))
IMPLIED_END = {
    **{tag: frozenset(("p",)) for tag in CLOSES_PARAGRAPH},
    "li": frozenset(("li", "p")),
    "dt": frozenset(("dt", "dd", "p")),
    "dd": frozenset(("dt", "dd", "p")),
    "td": frozenset(("td", "th", "p")),
    "th": frozenset(("td", "th", "p")),
    "tr": frozenset(("td", "th", "tr", "p")),
    "option": frozenset(("option",)),
    "body": frozenset(("head",)),
}

PAGE_TYPE = (
    "struct<title:string,description:string,main_content:string,content_hash:string,"
    "sections:array<struct<heading:string,level:int,content:string>>,"
    "tables:array<array<array<string>>>,anchors:array<struct<text:string,href:string,pos:int>>,error:string>"
)


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "Element | None") -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def walk(self):
        """Elements and strings below this one in document order, without recursion."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            else:
                yield child
                if isinstance(child, Element):
                    stack.append(iter(child.children))

    def find_all(self, *tags: str):
        return [e for e in self.walk() if isinstance(e, Element) and e.tag in tags]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.top.tag in IMPLIED_END.get(tag, ()):
            self.top = self.top.parent
        element = Element(tag, dict(reversed(attrs)), self.top)
        self.top.children.append(element)
        if tag not in VOID:
            self.top = element

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.top.tag == tag and tag not in VOID:
            self.top = self.top.parent

    def handle_endtag(self, tag):
        node = self.top
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.top = node.parent

    def handle_data(self, data):
        siblings = self.top.children
        if siblings and isinstance(siblings[-1], str):
            siblings[-1] += data
        else:
            siblings.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def title_of(root: Element) -> str:
    node = next(iter(root.find_all("title")), None)
    while isinstance(node, Element):
        node = node.children[0] if len(node.children) == 1 else None
    return (node or "").strip()


def description_of(root: Element) -> str:
    for meta in root.find_all("meta"):
        if meta.attrs.get("name") == "description":
            return (meta.attrs.get("content") or "").strip()
    return ""


def main_text_of(root: Element) -> str:
    """Text outside BOILERPLATE, one line per block element, white space collapsed."""
    parts, stack = [], [(root, iter(root.children))]
    while stack:
        owner, children = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if owner.tag in BLOCKS:
                parts.append("\n")
        elif isinstance(child, str):
            parts.append(re.sub(r"\s+", " ", child))
        elif child.tag not in BOILERPLATE:
            if child.tag in BLOCKS:
                parts.append("\n")
            stack.append((child, iter(child.children)))
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


class Outline:
    """Headings, tables and links of a page from one pass over its elements.

    Stripped strings outside SILENT elements are gathered in one list, so the text of an element is a slice of it, known when the
    element closes. Whatever waits for a text is noted when the element opens, which keeps document order.
    """

    def __init__(self, root: Element, base_url: str) -> None:
        self.sections: list[dict] = []
        self._tables: list[list[list[str]]] = []
        self._links: dict[str, str] = {}
        self._positions: dict[str, int] = {}
        self._n_anchors = 0
        self._strings: list[str] = []
        self._base_url = base_url
        self._open_tables: list[list] = []
        self._open_rows: list[list] = []
        self._pass(root)

    def _pass(self, root: Element) -> None:
        # Per open element: what is left of its children, its start in the strings, what to do with its text, and the section
        # that its children contribute to: that of the last heading among them.
        levels = [[iter(root.children), 0, (), None, root]]
        while levels:
            children, start, uses, section, owner = levels[-1]
            child = next(children, None)
            if isinstance(child, str):
                if owner.tag not in SILENT and (stripped := child.strip()):
                    self._strings.append(stripped)
            elif child is not None:
                if child.tag in HEADINGS:
                    section = {"heading": "", "level": int(child.tag[1]), "content": []}
                    self.sections.append(section)
                    levels[-1][3] = section
                    uses = [lambda text, s=section: s.update(heading=text)]
                else:
                    uses = [] if section is None else [lambda text, s=section: s["content"].append(text)]
                levels.append([iter(child.children), len(self._strings), uses + self._opened(child), None, child])
            else:
                levels.pop()
                text = " ".join(self._strings[start:]) if uses else ""
                for use in uses:
                    use(text)
                if owner.tag == "table":
                    self._open_tables.pop()
                elif owner.tag == "tr":
                    self._open_rows.pop()
        for section in self.sections:
            section["content"] = "\n".join(text for text in section["content"] if text)

    def _opened(self, element: Element) -> list:
        """Takes note of a table, row, cell or link; returns what to do with its text."""
        if element.tag == "table":
            self._open_tables.append([])
            self._tables.append(self._open_tables[-1])
        elif element.tag == "tr":
            # Rows and cells of nested tables belong to the outer ones too.
            self._open_rows.append([])
            for table in self._open_tables:
                table.append(self._open_rows[-1])
        elif element.tag in ("td", "th") and self._open_rows:
            rows = [(row, len(row)) for row in self._open_rows]
            for row, _ in rows:
                row.append("")
            return [lambda text: [row.__setitem__(at, text) for row, at in rows]]
        elif element.tag == "a" and element.attrs.get("href") is not None:
            # The first anchor of a target counts, even one without text.
            href = urljoin(self._base_url, element.attrs["href"])
            self._positions.setdefault(href, self._n_anchors)
            self._n_anchors += 1
            if href not in self._links:
                self._links[href] = ""
                return [lambda text: self._links.__setitem__(href, text)]
        return []

    @property
    def tables(self) -> list[list[list[str]]]:
        filled = ([row for row in table if any(row)] for table in self._tables)
        return [table for table in filled if table]

    @property
    def anchors(self) -> list[dict]:
        """The first anchor of every web target, with its place among all anchors of the page."""
        return [
            {"text": text, "href": href, "pos": self._positions[href]}
            for href, text in self._links.items()
            if urlparse(href).scheme in ("http", "https")
        ]

    @property
    def links(self) -> list[dict]:
        return [{"text": a["text"], "href": a["href"]} for a in self.anchors if a["text"]]


def extract(html: str | None, url: str) -> dict | None:
    """Everything read from one page. A page that cannot be read yields its error instead."""
    import xxhash

    if html is None:
        return None
    try:
        root = parse(html)
        main = main_text_of(root)
        outline = Outline(root, url or "")
        return {
            "title": title_of(root),
            "description": description_of(root),
            "main_content": main,
            "content_hash": xxhash.xxh128_hexdigest(main.encode("utf-8")),
            "sections": outline.sections,
            "tables": outline.tables,
            "anchors": outline.anchors,
            "error": None,
        }
    except (ValueError, AssertionError, UnicodeError) as problem:
        return {"error": f"{type(problem).__name__}: {problem}"}


_STRING = pa.string()
_ARROW_PAGE = pa.struct(
    [
        ("title", _STRING),
        ("description", _STRING),
        ("main_content", _STRING),
        ("content_hash", _STRING),
        ("sections", pa.list_(pa.struct([("heading", _STRING), ("level", pa.int32()), ("content", _STRING)]))),
        ("tables", pa.list_(pa.list_(pa.list_(_STRING)))),
        ("anchors", pa.list_(pa.struct([("text", _STRING), ("href", _STRING), ("pos", pa.int32())]))),
        ("error", _STRING),
    ]
)


def extracted(html: Column, url: Column) -> Column:
    """Struct PAGE_TYPE per page. Marked non-deterministic so that it runs once per page: Catalyst
    must not copy it into filters."""

    def some(pages: pa.Array, urls: pa.Array) -> pa.Array:
        return pa.array([extract(h, u) for h, u in zip(pages.to_pylist(), urls.to_pylist())], _ARROW_PAGE)

    @F.arrow_udf(PAGE_TYPE)
    def run(pages: pa.Array, urls: pa.Array) -> pa.Array:
        return in_slices(some, _ARROW_PAGE, pages, urls)

    return run.asNondeterministic()(html, url)
