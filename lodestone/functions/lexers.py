"""Tokens and names in source code, by a state machine for each language.

The machine reads code until something opens: a comment, which may hold others, a quotation, whose text may hold code again
(templates, interpolated strings), a here-document, which begins on the next line, or a pattern, which a slash
opens only where no value stands before it. What is open lies on a stack. ``syntax.LANGUAGES`` has what the
machine needs to know of a language; languages that are not there have no tokens.

The function runs on Arrow batches in Python workers: states of this kind are beyond what regular expressions of the JVM can say.
What stays open is closed by the end of the text (or of the line, where a quotation may not pass it); texts
that are null give null, empty ones no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .syntax import BEFORE_PATTERN, LANGUAGES, Syntax

#: Languages by extension; of several the content decides.
EXTENSIONS = {
    "py": "Python", "rb": "Ruby", "sh": "Shell", "bash": "Shell", "c": "C", "h": "C, C++, Objective-C", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++", "m": "Objective-C, MATLAB", "mm": "Objective-C",
    "java": "Java", "scala": "Scala", "go": "Go", "js": "JavaScript", "mjs": "JavaScript", "ts": "TypeScript", "rs": "Rust", "cs": "C#", "kt": "Kotlin", "swift": "Swift", "php": "PHP", "lua": "Lua", "hs": "Haskell",
    "ml": "OCaml", "r": "R", "sql": "SQL", "md": "Markdown",
}
TOKEN = T.StructType().add("kind", "string").add("begin", "integer").add("end", "integer")


def lexed(text: str, syntax: Syntax) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) of everything but blanks and marks, in order."""
    at, stack, waiting, before = 0, [], [], ""  # stack: quotation, what ends it, where it began, open brackets
    match, n = syntax.code.match, len(text)
    while at < n:
        m = match(text, at)
        group, begin, at = m.lastgroup, at, m.end()
        if group in ("hq", "h1", "h2"):
            group = "heredoc"
        if group == "blank":
            continue
        if group == "newline":
            for mark in waiting:
                end = re.compile(rf"^[^\S\n]*{re.escape(mark)}[^\S\n]*$", re.MULTILINE).search(text, at)
                yield "string", at, (last := end.end() if end else n)
                at = last
            waiting.clear()
        elif group == "word":
            word = text[begin:at]
            kind = "keyword" if (word.lower() if syntax.folded else word) in syntax.keywords else syntax.kind
            yield kind, begin, at
            before = "(" if kind == "keyword" else "word"
        elif group == "mark":
            before = text[begin]
            if stack:
                quote, _, start, depth = stack[-1]
                if before in "([{":
                    stack[-1][3] += 1
                elif before in ")]}" and depth:
                    stack[-1][3] -= 1
                elif before == "}":
                    at = yield from _quoted(text, at, at - 1, stack.pop(), stack)
                    before = "word"
                elif quote.spec and not depth and (before == ":" or before == "!" and text[at : at + 2] in ("r}", "s}", "a}", "r:", "s:", "a:")):
                    at = end if (end := text.find("}", at)) >= 0 else n
        elif group == "comment":
            yield "comment", begin, at
        elif group == "block":
            at = _comment_end(text, at, syntax)
            yield "comment", begin, at
        elif group == "heredoc":
            waiting.append(m["h1"] or m["h2"])
            yield "string", begin, at
        elif group == "number":
            yield "number", begin, at
            before = "word"
        elif group == "pattern":
            value = before and before not in BEFORE_PATTERN
            # in a language with calls without brackets: a name, a blank and a slash without a blank
            if value and not (before == "word" and syntax.heredocs and text[begin - 1] in " \t" and text[begin + 1] not in " ="):
                at, before = begin + 1, "/"  # a division
                continue
            yield "regex", begin, at
            before = "word"
        elif group.startswith("quote"):
            i = int(group[5:])
            opened = syntax.openings[i].match(text, begin)
            at = yield from _quoted(text, at, begin, [syntax.quotes[i], syntax.quotes[i].inner(opened), begin, 0], stack)
            before = "word"
        else:
            kind = syntax.extra[int(group[5:])][0]
            if kind != "mark":
                yield kind, begin, at
                before = "word" if kind != "comment" else before


def _quoted(text: str, at: int, begin: int, opened: list, stack: list):
    """The text of a quotation from ``at``; gives where the code goes on, with what was interrupted on the stack."""
    _, inner, *_ = opened
    depth = 0
    while m := inner.search(text, at):
        at, group = m.end(), m.lastgroup
        if group == "more":
            depth += 1
        elif group == "end" and depth:
            depth -= 1
        elif group == "end":
            yield "string", begin, at
            return at
        elif group == "line":
            yield "string", begin, m.start()
            return m.start()
        elif group == "code":
            yield "string", begin, at
            opened[3] = 0
            stack.append(opened)
            return at
        elif group == "names":
            yield "string", begin, at
            name = re.compile(r"\w+").match(text, at)
            yield "name", at, name.end()
            begin = at = name.end()
    yield "string", begin, len(text)
    return len(text)


def _comment_end(text: str, at: int, syntax: Syntax) -> int:
    opening, closing = syntax.block
    depth = 1
    for m in re.compile(f"(?P<more>{opening})|{closing}" if syntax.nested else closing).finditer(text, at):
        depth += 1 if m.lastgroup else -1
        if not depth:
            return m.end()
    return len(text)


@F.pandas_udf(T.ArrayType(TOKEN))
def _tokens(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, langs in batches:
        yield pd.Series([None if t is None or lang not in LANGUAGES else [{"kind": k, "begin": a, "end": b} for k, a, b in lexed(t, LANGUAGES[lang])] for t, lang in zip(texts, langs)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _names(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, langs in batches:
        yield pd.Series([None if t is None or lang not in LANGUAGES else [t[a:b] for k, a, b in lexed(t, LANGUAGES[lang]) if k == "name"] for t, lang in zip(texts, langs)], dtype=object)


def tokens_in(content: Column, lang: Column) -> Column:
    """array<struct<kind, begin, end>>: name, keyword, number, string, comment, regex, preprocessor, with offsets in code points."""
    ship(SparkSession.active())
    return _tokens(content, lang)


def names_in(content: Column, lang: Column) -> Column:
    """array<string>: the names of a file as they follow each other, null for a language that is not listed."""
    ship(SparkSession.active())
    return _names(content, lang)


def extension_table(spark: SparkSession) -> DataFrame:
    """(extension, lang), a row for each language that an extension may mean."""
    return spark.createDataFrame([(e, lang) for e, langs in EXTENSIONS.items() for lang in langs.split(", ")], "extension string, lang string")
