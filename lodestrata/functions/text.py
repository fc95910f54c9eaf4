"""Markup and prose to plain text: one tokenising pass over tags, and columns for what needs no state."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The named entities that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "sect": "§", "para": "¶", "deg": "°",
}
#: Elements that begin and end lines, and elements that aren't text.
HTML_BLOCKS = ("p", "div", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote")
HTML_HIDDEN = ("script", "style", "head", "nav", "footer")
XML_BLOCKS = ("section", "subsection", "paragraph", "subparagraph", "clause", "text", "header", "enum", "toc-entry", "title", "official-title")


class Rules(NamedTuple):
    """What tags give: at their beginning, at their end, and otherwise; elements that are hidden; marks around what is in an element."""

    opens: dict[str, str]
    closes: dict[str, str]
    other: str
    hidden: tuple[str, ...] = ()
    marks: dict[str, tuple[str, str]] = {}
    lines: str = ""  # elements whose names begin so begin and end lines


HTML = Rules(
    opens={"br": "\n", **dict.fromkeys(HTML_BLOCKS, "\n")},
    closes={"td": "\t", "th": "\t", **dict.fromkeys(HTML_BLOCKS, "\n")},
    other="",
    hidden=HTML_HIDDEN,
    marks={**dict.fromkeys(("s", "strike", "del"), ("[-", "-]")), **dict.fromkeys(("ins", "u"), ("{+", "+}"))},
)
#: What of a state's bill documents is a record and no text.
CAML_HIDDEN = ("caml:id", "caml:versionnum", "caml:history", "caml:legislativeinfo", "caml:authors", "caml:measureindicators", "caml:digestkey")
_CAML_BLOCKS = dict.fromkeys(("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "blockquote"), "\n")
CAML = Rules(opens={"br": "\n", **_CAML_BLOCKS}, closes=_CAML_BLOCKS, other=" ", hidden=CAML_HIDDEN, lines="caml:")
XML = Rules(opens=dict.fromkeys(XML_BLOCKS, "\n"), closes=dict.fromkeys(XML_BLOCKS, "\n"), other=" ")

#: A comment, an instruction, or a tag with its name.
_TAG = re.compile(r"(?s)<!--.*?-->|<\?.*?\?>|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)[^>]*>|<[^>]+>")
_ENTITY = re.compile(r"&(?:#(?P<number>[0-9]+)|#[xX](?P<hex>[0-9a-fA-F]+)|(?P<name>[A-Za-z]+));")


def _without_tags(source: str, rules: Rules) -> str:
    """The text of a document in one pass. Marks are put when their element ends, and only around text; an element that has no end marks nothing."""
    out: list[str] = []
    begun: list[tuple[str, int]] = []
    at = 0
    while tag := _TAG.search(source, at):
        out.append(source[at : tag.start()])
        at, name = tag.end(), (tag["name"] or "").lower()
        if not name:
            if not tag[0].startswith(("<!", "<?")):
                out.append(rules.other)
        elif name in rules.hidden and not tag["end"]:
            end = re.compile(f"(?i)</{name}>").search(source, at)
            at = end.end() if end else at
        elif name in rules.marks:
            if not tag["end"]:
                begun.append((name, len(out)))
            elif any(n == name for n, _ in begun):
                while (was := begun.pop())[0] != name:
                    pass
                inner = "".join(out[was[1] :])
                before, after = rules.marks[name]
                out[was[1] :] = [before, inner, after] if inner.strip() else []
        elif rules.lines and name.startswith(rules.lines):
            out.append("\n")
        else:
            out.append((rules.closes if tag["end"] else rules.opens).get(name, rules.other))
    return "".join([*out, source[at:]])


def _character(e: re.Match) -> str:
    if e["name"]:
        return ENTITIES.get(e["name"].lower(), e[0])
    digits = (e["number"] or e["hex"]).lstrip("0")
    code = int(digits, 10 if e["number"] else 16) if 0 < len(digits) < 9 else 0
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else e[0]


#: Pieces up to this length are decoded once a process, so many of them at most.
_PIECE, _PIECES = 17, 65_536


class _Pieces(dict):
    """What follows an ampersand, up to the next one, to its text with the entity decoded or the ampersand kept."""

    def __missing__(self, piece: str) -> str:
        head, end, rest = piece.partition(";")
        e = _ENTITY.fullmatch(f"&{head};") if end else None
        found = _character(e) + rest if e else f"&{piece}"
        if len(piece) <= _PIECE and len(self) < _PIECES:
            self[piece] = found
        return found


_pieces = _Pieces()


def _decoded(source: str) -> str:
    """An entity has no ampersand inside, so the pieces between ampersands are looked at, each once."""
    first, *others = source.split("&")
    return "".join([first, *map(_pieces.__getitem__, others)])


def _mapped(f: Callable[[str], str]) -> Callable[[Column | str], Column]:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return run


#: Numeric and named entities as their characters, each once: what a decoded character completes stays. Unknown names and impossible numbers stay.
decode_entities = _mapped(_decoded)
#: HTML without tags: blocks as lines, cells as tabs, deletions as [-…-] and insertions as {+…+}.
html_markup_out = _mapped(lambda s: _without_tags(s, HTML))
_html_decoded = _mapped(lambda s: _decoded(_without_tags(s, HTML)))
_xml_decoded = _mapped(lambda s: _decoded(_without_tags(s, XML)))


_caml_decoded = _mapped(lambda s: _decoded(_without_tags(s, CAML)))


def caml_to_text(c: Column) -> Column:
    """A state's bill as text: its records go, its elements are lines."""
    return tidy(_caml_decoded(c))


_HEADED = re.compile(r"(?is)<(?:h(?P<level>[1-6])|p)\b[^>]*>(?P<inner>.*?)(?=</?(?:h[1-6]|p)\b|\Z)")


def sections_about(c: Column, wanted: str, stop: str) -> Column:
    """The paragraphs of a page below headings that match `wanted`, with those headings and all below them, until a heading matches `stop` or one of their own level doesn't match.

    A stack of heading levels is folded over the page: what is below a kept heading is kept. An unclosed heading or paragraph ends where the next begins. Null where nothing is.
    """
    keep, leave = re.compile(wanted, re.I), re.compile(stop, re.I)

    def kept(page: str) -> str | None:
        stack: list[tuple[int, bool]] = []
        out: list[str] = []
        for m in _HEADED.finditer(page):
            said = " ".join(_decoded(_without_tags(m["inner"], HTML)).split())
            if not said:
                continue
            if m["level"]:
                level = int(m["level"])
                while stack and stack[-1][0] >= level:
                    stack.pop()
                inside = bool(stack) and stack[-1][1]
                stack.append((level, not leave.search(said) and (inside or bool(keep.search(said)))))
            if stack and stack[-1][1]:
                out.append(said + ":" if m["level"] else said)
        return "\n".join(out) or None

    return _mapped(kept)(c)


def tidy(c: Column) -> Column:
    """Line ends made one kind, lines without blanks at their ends and without wide gaps inside, one blank line at most between others; indentation stays."""
    lines = F.split(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    bare = F.transform(lines, lambda x: F.regexp_replace(F.rtrim(x, F.lit(" \t")), r"(?<=\S)[ \t]{9,}", "  "))
    return F.regexp_replace(F.array_join(bare, "\n"), r"\A\n+|(?<=\n\n)\n+|\s+\z", "")


def html_to_text(c: Column) -> Column:
    return tidy(_html_decoded(c))


def xml_to_text(c: Column) -> Column:
    return tidy(_xml_decoded(c))


#: Inline marks of Markdown, each with what stays of it; numbers in brackets are references and go.
_INLINE = re.compile(r"\*\*(?P<strong>.+?)\*\*|\*(?P<soft>.+?)\*|`(?P<code>.+?)`|\[[\d.\s,;v-]+\]|\[(?P<label>[^\]]+)\]\([^)]+\)")
_BULLET = re.compile(r"\s*(?:[-*+]|\d+\.)\s+")
_RULE = re.compile(r"\s*(?:-{3,}|\*{3,})\s*")


def _unmarked(line: str) -> str:
    def inner(m: re.Match) -> str:
        return next((_INLINE.sub(inner, g) for g in m.groups() if g), "")

    return _INLINE.sub(inner, line)


def _prose(markdown: str) -> str:
    out, fenced = [], False
    for line in markdown.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
            continue
        heading = line.lstrip("#")
        if fenced or (0 < len(line) - len(heading) < 7 and heading[:1].isspace()) or _RULE.fullmatch(line):
            continue
        bullet = _BULLET.match(line)
        line = _unmarked(line[bullet.end() :] if bullet else line)
        if line.strip():
            out.append(line)
    return "\n".join(out).strip()


#: Markdown without its marks: no headings, fenced code, rules or bullets; blank lines go.
plain_prose = _mapped(_prose)


SHELL = "enable javascript to run this app"


def is_shell(c: Column) -> Column:
    """Whether a page's text is only what a script-driven site shows to a reader without scripts."""
    return (F.length(c) > 0) & (F.length(c) < 400) & F.lower(c).contains(SHELL)


def journal_of(c: Column) -> Column:
    """The journal's name at the head of a reference; null if shorter than three characters."""
    name = F.rtrim(F.split_part(F.split(c, r"\s+\d+[\s,]", 2)[0], F.lit("("), F.lit(1)))
    name = F.rtrim(F.trim(name), F.lit(".,;:"))
    return F.when(F.length(name) >= 3, name)


def format_of(head: Column) -> Column:
    """zip, pdf, json, xml, html, csv or text by how the content begins."""
    h = F.trim(F.substring(head, 1, 512))
    low = F.lower(h)
    return (
        F.when(h.startswith("PK"), "zip")
        .when(h.startswith("%PDF"), "pdf")
        .when(h.startswith("{") | h.startswith("["), "json")
        .when(low.startswith("<!doctype html") | low.startswith("<html"), "html")
        .when(low.startswith("<"), "xml")
        .when(F.split_part(h, F.lit("\n"), F.lit(1)).contains(","), "csv")
        .otherwise("text")
    )


@F.pandas_udf(T.ArrayType(T.StructType().add("title", "string").add("xml", "string")))
def top_sections(bodies: pd.Series) -> pd.Series:
    """The outermost <sec> elements with their titles: inner ones are counted in and out, never taken for an end."""

    def sections(body: str | None) -> list[dict] | None:
        if body is None:
            return None
        depth, start, out = 0, 0, []
        for m in re.finditer(r"<(/?)sec\b[^>]*>", body):
            opening = not m[1]
            if opening and depth == 0:
                start = m.start()
            was, depth = depth, max(0, depth + (1 if opening else -1))
            if was == 1 and depth == 0:
                xml = body[start : m.end()]
                title = re.search(r"(?s)<title[^>]*>(.*?)</title>", xml)
                out.append({"title": re.sub(r"<[^>]+>", "", title[1]).strip() if title else "", "xml": xml})
        return out

    return bodies.map(sections)


def div_by_class(bodies: Column, name: str) -> Column:
    """What is inside the first <div> that has the class, inner divs included; null without one. Without its end it goes to the end of the page."""

    @F.pandas_udf("string")
    def inside(texts: pd.Series) -> pd.Series:
        tags = re.compile(r"(?i)<(/?)div\b([^>]*)>")
        has = re.compile(rf"""(?i)\bclass\s*=\s*["'](?:[^"']*\s)?{re.escape(name)}(?:\s[^"']*)?["']""")

        def one(body: str | None) -> str | None:
            depth, start = 0, None
            for m in tags.finditer(body or ""):
                if start is None:
                    start, depth = (m.end(), 1) if not m[1] and has.search(m[2]) else (None, 0)
                    continue
                depth += -1 if m[1] else 1
                if depth == 0:
                    return body[start : m.start()]
            return body[start:] if start is not None else None

        return texts.map(one)

    return inside(bodies)


def marked(c: Column, query: str) -> Column:
    """Each occurrence of query, whatever its case, between « and »."""
    return F.regexp_replace(c, f"(?i)({re.escape(query)})", "«$1»")


def snippet(c: Column, query: str, around: int = 40) -> Column:
    """The text around the first occurrence, marked; null where there is none."""
    at = F.instr(F.lower(c), F.lit(query.lower()))
    piece = c.substr(F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(query)))
    return F.when(at > 0, marked(piece, query))
