"""Plain text from wiki markup by one scanner: nested templates, links and tags close from the inside out.

The scanner walks over the marks of a text once and keeps a stack of what is open. What closes is replaced at once: a template
and a tag's content by nothing, a link by its label, a media link by nothing. What never closes stays as it was written.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = re.compile(r"(?P<comment><!--.*?(?:-->|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z]\w*)(?:\s[^<>]*?)?(?P<void>/?)>|(?P<two>\{\{|\}\}|\[\[|\]\])|(?P<web>\[https?://[^\s\[\]]*)|(?P<one>\])|&(?P<name>[a-z]+);|(?P<magic>__[A-Z]+__)", re.S)
#: Entities and what they become: fixed values.
_ENTITIES = {"ndash": "-", "mdash": " - ", "nbsp": " "}
_MEDIA = ("File:", "Image:", "Category:")
_OPENS = {"}}": "{{", "]]": "[["}


def _label(inside: str) -> str:
    return "" if inside.startswith(_MEDIA) else inside.split("|", 1)[-1]


class _Stack:
    """Open marks with the text inside each; the lowest is the text itself."""

    def __init__(self, deep: bool):
        self.deep = deep
        self.open: list[tuple[str, str, list[str]]] = [("", "", [])]

    def put(self, text: str) -> None:
        self.open[-1][2].append(text)

    def begin(self, kind: str, written: str) -> None:
        self.open.append((kind, written, []))

    def end(self, kind: str, written: str) -> None:
        depth = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == kind), 0)
        if not depth:
            self.put(written)
            return
        self.unfinished(depth + 1)
        _, first, parts = self.open.pop()
        inside = "".join(parts)
        if kind.startswith("<"):
            return
        if not self.deep:
            self.put(first + inside + written)
        elif kind == "[[":
            self.put(_label(inside))
        elif kind == "[":
            self.put(inside.strip())

    def unfinished(self, down_to: int) -> None:
        while len(self.open) > down_to:
            _, written, parts = self.open.pop()
            self.put(written + "".join(parts))


def _scan(text: str, deep: bool) -> str:
    stack, at = _Stack(deep), 0
    for m in _MARK.finditer(text):
        stack.put(text[at : m.start()])
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
            if tag == "br":
                stack.put("\n")
            elif m["end"]:
                stack.end(f"<{tag}", m[0])
            elif not m["void"]:
                stack.begin(f"<{tag}", m[0])
        elif m["two"]:
            (stack.end if m[0] in _OPENS else stack.begin)(_OPENS.get(m[0], m[0]), m[0])
        elif m["web"]:
            stack.begin("[", m[0])
        elif m["one"]:
            stack.end("[", m[0])
        elif m["name"]:
            stack.put(_ENTITIES.get(m["name"], m[0]))
    stack.put(text[at:])
    stack.unfinished(1)
    return "".join(stack.open[0][2])


def _idle(line: str) -> bool:
    """Indented lines, and those in italics from end to end."""
    inner = line[2:-2]
    return line.startswith(":") or (len(line) > 4 and line.startswith("''") and line.endswith("''") and "'" not in inner)


def _spaces(line: str) -> str:
    return re.sub(r"[ \t]{2,}", " ", line)


def drop_useless_text(text: str) -> str:
    """Without comments, tags and their content, indented and italic lines; dashes and spaces made plain. Links and templates stay."""
    return "\n".join("" if _idle(x) else _spaces(x) for x in _scan(text, False).split("\n"))


def clean_text(text: str) -> str:
    """Plain text: useless markup, templates, media and styling gone, links as their labels."""
    lines = []
    for x in _scan(text, True).split("\n"):
        x = "" if _idle(x) else re.sub(r"'{2,}", "", x)
        x = re.sub(r"\(\s*[,;]?\s*\)", "", x)
        lines.append(_spaces(re.sub(r"\s+(?=[,.;:!?])", "", x)))
    return "\n".join(lines).strip()


def _column(f):
    def one(c: Column) -> Column:
        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(f, na_action="ignore")

        return run(c)

    one.__doc__ = f.__doc__
    return one


drop_useless, clean_markup = _column(drop_useless_text), _column(clean_text)


def without_sections(text: Column, names: tuple[str, ...]) -> Column:
    """A text without the named sections, each up to the next heading: the text is split before headings, and parts are kept or not."""
    parts = F.split(text, r"(?m)(?=^=[^\n]*=[ \t]*$)")
    title = lambda part: F.lower(F.trim(F.regexp_extract(part, r"^=+([^=\n]*)=", 1)))
    return F.array_join(F.filter(parts, lambda p: ~title(p).isin([n.lower() for n in names])), "")


def plain_lines(text: Column) -> Column:
    """Cleaned text without headings, lines that lead to nothing (an empty line follows, no full stop ends them), marks of empty bullets
    and repeated empty lines. Lines are classed one by one, with the next and the last kept one in sight."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.rtrim(F.regexp_replace(x, " +", " ")))
    blank = lambda x: F.trim(x) == ""
    follows = lambda i: F.coalesce(F.get(lines, i + 1), F.lit("end"))
    useless = lambda x, i: x.startswith("=") | x.isin("*", "=") | (x.rlike(r"[\w:,;]$") & blank(follows(i)))
    kept = F.filter(lines, lambda x, i: ~useless(x, i))
    return F.trim(F.array_join(F.filter(kept, lambda x, i: ~blank(x) | ~blank(F.coalesce(F.get(kept, i - 1), F.lit("")))), "\n"))
