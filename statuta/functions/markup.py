"""HTML and XML to text, with the standard library only, in Arrow batches; each row has a status of its own."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.functions.text import strip

#: Elements without content of their own.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
NOISE = frozenset(("script", "style", "nav", "header", "footer"))
BLOCKS = frozenset(("address", "article", "blockquote", "dd", "div", "dl", "dt", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "main", "ol", "p", "pre", "section", "table", "tr", "ul"))
#: What holds the content of a page, the first that occurs counts.
CONTENT = ("main", "article", "[role=main]", "#content", ".content")
#: XML elements that give the title, and those whose text starts a line.
TITLES, LINES = frozenset(("jurabk", "amtabk", "titel", "Titel")), frozenset(("P", "BR", "text", "Text", "Content", "norm"))


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self):
        """This node and all below it, in order; without recursion, as trees may be of any depth."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def folded(self, of):
        """of(node, children) from the leaves up: children are texts, or what it gave for nodes."""
        done = {}
        for node in reversed(list(self.walk())):
            done[id(node)] = of(node, [c if isinstance(c, str) else (done.pop(id(c)),) for c in node.children])
        return done[id(self)]


class Tree(HTMLParser):
    """A forgiving tree: an end tag closes up to the nearest element of its name, an unknown one is passed over."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _fits(node: Node, rule: str) -> bool:
    if rule[0] == "#":
        return node.attrs.get("id") == rule[1:]
    if rule[0] == ".":
        return rule[1:] in node.attrs.get("class", "").split()
    if rule[0] == "[":
        key, value = rule[1:-1].split("=")
        return node.attrs.get(key) == value
    return node.tag == rule


def content_node(root: Node) -> Node:
    for rule in (*CONTENT, "body"):
        for node in root.walk():
            if _fits(node, rule):
                return node
    return root


def clean_text(html: str) -> str:
    return lines_of(Tree(html).root)


def lines_of(node: Node) -> str:
    """Text of all elements but noise, a line each; empty lines and runs of spaces squeezed."""
    parts: list[str] = []

    todo = node.children[::-1]
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            if child.strip():
                parts.append(child.strip())
        elif child.tag not in NOISE:
            todo.extend(reversed(child.children))
    return re.sub(" +", " ", re.sub(r"\n\s*\n", "\n\n", "\n".join(parts))).strip()


def markdown(html: str) -> str:
    """The content of a page as Markdown: headings, lists, emphasis, links, code and rules."""
    out: list[str] = []

    def joined(children: list) -> str:
        return "".join(re.sub(r"\s+", " ", c) if isinstance(c, str) else c[0] for c in children)

    def inline(node: Node) -> str:
        return node.folded(lambda n, children: joined(children) if n is node else marked(n, joined(children)))

    def span(node: Node) -> str:
        return node.folded(lambda n, children: marked(n, joined(children)))

    def marked(node: Node, text: str) -> str:
        if node.tag in ("script", "style"):
            return ""
        if node.tag == "br":
            return "\n"
        if not text.strip():
            return text
        if node.tag in ("b", "strong"):
            return f"**{text.strip()}**"
        if node.tag in ("i", "em"):
            return f"*{text.strip()}*"
        if node.tag == "code":
            return f"`{text.strip()}`"
        if node.tag == "a" and node.attrs.get("href"):
            return f"[{text.strip()}]({node.attrs['href']})"
        return text

    def block(node: Node) -> Iterator[Node]:
        """Writes a block; yields those inside it, which are written before it goes on."""
        line = ""

        def flush() -> None:
            nonlocal line
            if line.strip():
                out.append("\n".join(x.strip() for x in line.strip().split("\n")))
            line = ""

        number = 0
        for child in node.children:
            if isinstance(child, str):
                line += re.sub(r"\s+", " ", child)
            elif child.tag in ("script", "style", "head"):
                continue
            elif child.tag == "li":
                flush()
                number += 1
                mark = f"{number}." if node.tag == "ol" else "-"
                at = len(out)
                yield child
                out[at:] = [f"{mark} " + "\n".join(out[at:])] if len(out) > at else []
            elif re.fullmatch("h[1-6]", child.tag):
                flush()
                if inline(child).strip():
                    out.append("#" * int(child.tag[1]) + " " + inline(child).strip())
            elif child.tag == "hr":
                flush()
                out.append("---")
            elif child.tag in BLOCKS or any(isinstance(c, Node) and c.tag in BLOCKS for c in child.walk() if c is not child):
                flush()
                yield child
            else:
                line += span(child)
        flush()

    todo = [block(content_node(Tree(html).root))]
    while todo:
        inside = next(todo[-1], None)
        if inside is None:
            todo.pop()
        else:
            todo.append(block(inside))
    return "\n\n".join(out).strip()


def links(html: str, base: str | None = None) -> list[str]:
    from urllib.parse import urljoin

    found = (n.attrs["href"] for n in Tree(html).root.walk() if n.tag == "a" and n.attrs.get("href"))
    return list(dict.fromkeys(urljoin(base, x) if base else x for x in found))


def xml_document(xml: str) -> tuple[str, str]:
    """Title and content in event order. Text after an end tag still belongs to the element opened last."""
    events: list[tuple[str, str]] = []

    class Target:
        def __init__(self):
            self.data_, self.tag = "", ""

        def start(self, tag, attrs):
            self.flush()
            self.tag = tag.rpartition("}")[2]

        def end(self, tag):
            self.flush()

        def data(self, data):
            self.data_ += data

        def flush(self):
            if self.data_.strip():
                events.append((self.tag, self.data_.strip()))
            self.data_ = ""

        def close(self):
            self.flush()

    parser = ElementTree.XMLParser(target=Target())
    parser.feed(xml)
    parser.close()
    title, content = "", ""
    for tag, text in events:
        if tag in TITLES:
            title = title or text
        else:
            content += ("\n" if tag in LINES else " ") * bool(content) + text
    return title, content.strip()


#: Where a portal's page has its law, first match; elements and classes of its sections, their numbers and titles.
LAW_AT = ("div.law-content", "div.content", "main", "article")
SECTION_TAGS, SECTION_CLASS = ("section", "div"), "section|paragraph|article"
NUMBER_TAGS, NUMBER_CLASS = ("h2", "h3", "h4", "span"), "number|num"
TITLE_TAGS, TITLE_CLASS = ("h2", "h3", "h4"), "title|heading"


def classed(node: Node, tags: tuple[str, ...], pattern: str) -> Iterator[Node]:
    """Elements below a node with one of these names and a class that the pattern is in, in order; also those inside each other."""
    return (n for n in node.walk() if n is not node and n.tag in tags and re.search(pattern, n.attrs.get("class", "")))


def law_node(root: Node) -> Node | None:
    for rule in LAW_AT:
        tag, _, name = rule.partition(".")
        for node in root.walk():
            if node.tag == tag and (not name or name in node.attrs.get("class", "").split()):
                return node
    return None


def sections_by_class(root: Node) -> list[dict[str, str]]:
    """Sections of a law's page: elements that are sections by their class, each with number, title and all its text."""
    out = []
    for node in classed(law_node(root) or root, SECTION_TAGS, SECTION_CLASS):
        number, title = next(classed(node, NUMBER_TAGS, NUMBER_CLASS), None), next(classed(node, TITLE_TAGS, TITLE_CLASS), None)
        out.append({"number": clean(number) if number else "", "title": clean(title) if title else "", "text": lines_of(node)})
    return out


def structured(html: str) -> dict:
    """Title, CELEX number, sections and the whole text of the law on a portal's page.

    Sections are elements that say so by their class; on a page without any, every heading with the text up to the next one."""
    tree = Tree(html).root
    found = _structured(html, tree)
    law = law_node(tree)
    return found | {"sections": sections_by_class(tree) or found["sections"], "full_text": lines_of(law) if law else ""}


def _structured(html: str, tree: Node) -> dict:
    title = next((clean(n) for n in tree.walk() if n.tag == "h1" and clean(n)), "") or next((clean(n) for n in tree.walk() if n.tag == "title"), "")
    sections, number = [], 0
    for node in content_node(tree).walk():
        if re.fullmatch("h[2-6]", node.tag):
            number += 1
            sections.append({"number": str(number), "title": clean(node), "text": ""})
        elif node.tag == "p" and sections:
            sections[-1]["text"] = (sections[-1]["text"] + "\n" + clean(node)).strip()
    celex = re.search("[0-9]{4}[A-Z][0-9]{4}", html)
    return {"title": title, "celex": celex.group(0) if celex else None, "sections": sections}


def clean(node: Node) -> str:
    return node.folded(lambda _, children: re.sub(r"\s+", " ", "".join(c if isinstance(c, str) else c[0] for c in children)).strip())


def _each(function, text, empty: str) -> tuple[str | None, str | None]:
    if text is None or not str(text).strip():
        return None, empty
    try:
        found = function(text)
    except Exception as e:  # the row's own error; other rows go on
        return None, f"{type(e).__name__}: {e}"
    return (found, None) if found else (None, "no text content")


RESULT = "struct<text:string,error:string>"


def batched(kind: str):
    """A function over pandas columns as one over Spark columns, made when it is called: workers import this module too."""

    def wrap(f):
        return functools.wraps(f)(lambda *columns: F.pandas_udf(f, kind)(*columns))

    return wrap


@batched(RESULT)
def html_markdown(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_each(markdown, x, "empty HTML") for x in html], columns=["text", "error"])


@batched(RESULT)
def html_text(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_each(clean_text, x, "empty HTML") for x in html], columns=["text", "error"])


@batched("array<string>")
def html_links(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([links(x, b) if x else [] for x, b in zip(html, base, strict=True)])


@batched("struct<title:string,content:string,error:string>")
def xml_text(xml: pd.Series) -> pd.DataFrame:
    out = []
    for x in xml:
        found, error = _each(xml_document, x, "empty XML")
        title, content = found or (None, None)
        if found and not title and not content:
            title, content, error = None, None, "no text content"
        out.append((title, content, error))
    return pd.DataFrame(out, columns=["title", "content", "error"])


@batched("struct<title:string,celex:string,sections:array<struct<number:string,title:string,text:string>>,full_text:string>")
def html_sections(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([structured(x or "") for x in html], columns=["title", "celex", "sections", "full_text"])


def closed(html: Column) -> Column:
    """A page in which a reference that no semicolon closes is text, as one that was cut off; an HTML parser takes some of these for signs."""
    return F.regexp_replace(html, "&(?!#?[0-9A-Za-z]+;)", "&amp;")


def html_title(html: Column) -> Column:
    """The first title of a page, whatever its case, trimmed; else the empty text."""
    return F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"^\s+|\s+$", "")


def article_text(html: Column) -> Column:
    """Text of the first article without a parser: tags become spaces, white space is squeezed."""
    inner = F.regexp_extract(html, r"(?s)<article[^>]*>(.*?)</article>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def hrefs(html: Column) -> Column:
    """Link targets in order of appearance, each once, by pattern."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1)))


def xml_flat(xml: Column) -> Column:
    """All text of an XML document, pieces parted by an empty line."""
    return F.array_join(F.filter(F.transform(F.xpath(xml, F.lit("//text()")), strip), lambda x: x != ""), "\n\n")
