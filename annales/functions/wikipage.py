"""Wikitext pages to sections, infobox, links and categories, in an Arrow function.

A reader of its own in one pass over the marks that nest (templates, tables,
links); malformed markup stays text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAD = "Mở đầu"
#: Names by which infobox templates begin (fixed values).
INFOBOX = ("thông tin", "hộp thông tin", "infobox")
#: Namespaces of categories and of what is no link to an article (fixed values).
CATEGORY = ("thể loại", "category")
FOREIGN = ("tập tin", "file", "image", "hình", "wikipedia", "wp", "bản mẫu", "template", "trợ giúp", "help", "cổng thông tin", "portal", "đặc biệt", "special", "media", "mediawiki", "thành viên", "user")
#: Tags whose content goes, and templates that show an argument (fixed values).
HIDDEN = ("ref", "gallery", "math", "timeline", "score", "imagemap", "style", "script", "noinclude", "includeonly", "source", "syntaxhighlight", "templatestyles")
SHOWN = {"nowrap": 0, "nobr": 0, "small": 0, "big": 0, "lang": -1, "nihongo": 0, "chữ đậm": 0, "quote": 0, "cquote": 0, "blockquote": 0, "khung trích dẫn": 0}
DATES = ("ngày sinh", "ngày mất", "birth date", "death date", "ngày bắt đầu", "start date", "ngày kết thúc", "end date", "ngày sinh và tuổi", "birth date and age", "ngày mất và tuổi", "death date and age")
SCHEMA = (
    "struct<sections:array<struct<path:string,text:string>>,infobox:struct<template:string,fields:map<string,struct<text:string,links:array<string>>>>,"
    "links:array<struct<surface:string,target:string,section:string,offset:int>>,categories:array<string>>"
)
_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]|\{\||\|\}")
_HEADING = re.compile(r"^(={2,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", re.MULTILINE)


@dataclass
class Page:
    sections: list[dict] = field(default_factory=list)
    infobox: dict | None = None
    links: list[dict] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)


def target(raw: str) -> str | None:
    """Article a link leads to: no namespace or language, no anchor, capital first letter; null for others."""
    name = raw.split("#", 1)[0].replace("_", " ").strip().lstrip(":")
    prefix = name.split(":", 1)[0].strip().lower() if ":" in name else ""
    if not name or prefix in CATEGORY or prefix in FOREIGN or re.fullmatch(r"[a-z]{2,3}(?:-[a-z]+)*", prefix):
        return None
    return name[0].upper() + name[1:]


def split_top(text: str, sep: str) -> list[str]:
    """Parts of text between separators outside nested links and templates."""
    parts, depth, begin, i = [], 0, 0, 0
    while i < len(text):
        two = text[i : i + 2]
        if two in ("{{", "[["):
            depth, i = depth + 1, i + 2
        elif two in ("}}", "]]"):
            depth, i = max(0, depth - 1), i + 2
        elif text[i] == sep and not depth:
            parts.append(text[begin:i])
            begin = i = i + 1
        else:
            i += 1
    return [*parts, text[begin:]]


class Reader:
    def __init__(self, page: Page) -> None:
        self.page = page
        self.found: list[tuple[str, str]] = []

    def text(self, raw: str) -> str:
        """Plain text of wikitext; links met are noted as (surface, target)."""
        raw = re.sub(r"<!--.*?(?:-->|\Z)", "", raw, flags=re.DOTALL)
        hidden = "|".join(HIDDEN)
        raw = re.sub(rf"<({hidden})\b[^<>]*/>|<({hidden})\b[^<>]*(?<!/)>.*?</\2\s*>", "", raw, flags=re.DOTALL | re.IGNORECASE)
        out = self._nested(raw)
        out = re.sub(r"<br\s*/?>", "\n", out, flags=re.IGNORECASE)
        out = re.sub(r"\[(?:https?:)?//[^\s\]]+[ \t]*([^\]]*)\]", r"\1", out)
        out = html.unescape(re.sub(r"</?[a-zA-Z][^<>]*>", "", out))
        out = re.sub(r"'{2,5}", "", out)
        out = re.sub(r"__[A-ZĐ_]+__", "", out)
        out = re.sub(r"^[*#:;]+[ \t]*", "", out, flags=re.MULTILINE)
        out = re.sub(r"\(\s*[,;]?\s*\)", "", out)
        out = re.sub(r"[ \t ]+", " ", out)
        out = re.sub(r" +([,.;:!?)])", r"\1", out)
        return re.sub(r"\n{2,}", "\n", "\n".join(line.strip() for line in out.split("\n"))).strip()

    def _nested(self, raw: str) -> str:
        out, i = [], 0
        while (m := _MARK.search(raw, i)) is not None:
            out.append(raw[i : m.start()])
            end = self._close(raw, m.start()) if m[0] in ("{{", "[[", "{|") else None
            if end is None:
                i = m.end() if m[0] in ("}}", "]]", "|}") else m.start() + 2
                out.append("" if m[0] in ("}}", "]]", "|}") else m[0] if m[0] == "{|" else "")
                continue
            inner = raw[m.end() : end - 2]
            out.append(self._template(inner) if m[0] == "{{" else self._link(inner) if m[0] == "[[" else self._table(inner))
            i = end
        out.append(raw[i:])
        return "".join(out)

    @staticmethod
    def _close(raw: str, at: int) -> int | None:
        pairs, stack = {"{{": "}}", "[[": "]]", "{|": "|}"}, []
        for m in _MARK.finditer(raw, at):
            if m[0] in pairs:
                stack.append(pairs[m[0]])
            elif stack and m[0] == stack[-1]:
                stack.pop()
                if not stack:
                    return m.end()
        return None

    def _link(self, inner: str) -> str:
        name, *rest = split_top(inner, "|")
        prefix = name.split(":", 1)[0].strip().lower() if ":" in name else ""
        if prefix in CATEGORY and not name.startswith(":"):
            self.page.categories.append(name.split(":", 1)[1].strip())
            return ""
        to = target(name)
        if to is None:
            return "" if not name.startswith(":") else self._nested(rest[-1] if rest else name[1:])
        surface = self._nested(rest[-1]) if rest else name.lstrip(":")
        self.found.append((re.sub(r"'{2,5}", "", surface).strip(), to))
        return surface

    def _template(self, inner: str) -> str:
        name, *args = split_top(inner, "|")
        name = " ".join(name.split()).lower()
        plain = [a for a in args if "=" not in re.sub(r"\[\[.*?\]\]|\{\{.*?\}\}", "", a, flags=re.DOTALL)]
        if name in DATES:
            numbers = [int(a) for a in plain if a.strip().isdigit()]
            return "/".join(str(n) for n in reversed(numbers[:3]))
        if name in SHOWN and plain:
            return self._nested(plain[SHOWN[name]])
        return ""

    def _table(self, inner: str) -> str:
        """Rows as lines: `header: cell; ...` where cells match the headers, else cells between bars."""
        headers: list[str] = []
        lines: list[str] = []
        for row in re.split(r"^[ \t]*\|-.*$", inner.split("\n", 1)[1] if "\n" in inner else "", flags=re.MULTILINE):
            cells: list[tuple[bool, str]] = []
            for line in row.split("\n"):
                line = line.strip()
                if line[:1] in "|!" and line[:2] not in ("|}", "|+") and line:
                    for cell in re.split(r"\|\||!!", line[1:]):
                        value = split_top(cell, "|")[-1]
                        cells.append((line[0] == "!", " ".join(self._nested(value).split())))
            shown = [c for _, c in cells]
            if cells and all(h for h, _ in cells) and not headers:
                headers = shown
            elif any(shown):
                lines.append("; ".join(f"{h}: {c}" for h, c in zip(headers, shown) if c) if headers and len(headers) == len(shown) else " | ".join(c for c in shown if c))
        return "\n" + "\n".join(lines) + "\n"


def read_page(wikitext: str | None, drop: tuple[str, ...] = ()) -> Page:
    """Sections under the lead's name and their heading paths, without those below a dropped top heading."""
    page = Page()
    if not wikitext:
        return page
    raw = re.sub(r"<!--.*?(?:-->|\Z)", "", wikitext, flags=re.DOTALL)
    for m in re.finditer(r"\{\{", raw):
        name = re.match(r"\{\{\s*([^|{}\n]*)", raw[m.start() :])[1].strip().lower()
        if name.startswith(INFOBOX) and (end := Reader._close(raw, m.start())) is not None:
            head, *args = split_top(raw[m.end() : end - 2], "|")
            fields = {}
            for arg in args:
                key, eq, value = arg.partition("=")
                reader = Reader(Page())
                if eq and (text := reader.text(value)):
                    fields[key.strip()] = {"text": text, "links": list(dict.fromkeys(t for _, t in reader.found))}
            page.infobox = {"template": " ".join(head.split()), "fields": fields}
            raw = raw[: m.start()] + raw[end:]
            break
    stack: list[tuple[int, str]] = []
    bounds = [(0, 0, None), *[(m.start(), m.end(), (len(m[1]), m[2])) for m in _HEADING.finditer(raw)], (len(raw), len(raw), None)]
    for (_, begin, heading), (end, _, _) in zip(bounds, bounds[1:]):
        if heading is not None:
            stack = [s for s in stack if s[0] < heading[0]]
            stack.append((heading[0], Reader(Page()).text(heading[1])))
        path = " > ".join(name for _, name in stack) or LEAD
        reader = Reader(page)
        text = reader.text(raw[begin:end])
        if stack and stack[0][1] in drop or not text:
            continue
        page.sections.append({"path": path, "text": text})
        cursor = 0
        for surface, to in reader.found:
            at = text.find(surface, cursor)
            at = at if at >= 0 else text.find(surface)
            if at >= 0:
                cursor = at + len(surface)
            page.links.append({"surface": surface, "target": to, "section": path, "offset": at if at >= 0 else None})
    return page


def parsed(wikitext: Column, drop: tuple[str, ...] = ()) -> Column:
    """Struct of sections, infobox, links and categories; null and empty texts give empty ones."""

    @F.pandas_udf(SCHEMA)
    def read(texts: pd.Series) -> pd.DataFrame:
        pages = [read_page(t, drop) for t in texts]
        return pd.DataFrame({"sections": [p.sections for p in pages], "infobox": [p.infobox for p in pages], "links": [p.links for p in pages], "categories": [p.categories for p in pages]})

    return read(wikitext)
