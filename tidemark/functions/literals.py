"""Postgres array and composite literals.

A literal is cut into quoted and plain stretches by one regular expression; an element is
the stretches between two separators.  Quoting can't be told apart by Spark's string
functions, so these run as Arrow-batched UDFs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quoted stretch (with backslash escapes and doubled quotes), an escaped character, a separator, or a plain stretch.
_STRETCH = re.compile(r'"(?P<quoted>(?:[^"\\]|\\.|"")*)"|\\(?P<escaped>.)|(?P<comma>,)|(?P<plain>[^",\\]+)', re.S)
_INNER = re.compile(r'\\(.)|""', re.S)


def _elements(body: str) -> list[tuple[str, bool]]:
    """(text, was quoted) of the elements of a literal's body."""
    if not body:
        return []
    out, text, quoted, at = [], "", False, 0
    while at < len(body):
        m = _STRETCH.match(body, at)
        if m is None:
            raise ValueError(f"bad literal at {at}: {body!r}")
        at = m.end()
        if m["comma"] is not None:
            out.append((text, quoted))
            text, quoted = "", False
        elif m["quoted"] is not None:
            text, quoted = text + _INNER.sub(lambda x: x[1] or '"', m["quoted"]), True
        else:
            text += m["escaped"] or m["plain"]
    return [*out, (text, quoted)]


def parse_array(literal: str | None) -> list[str | None] | None:
    """'{a,"b,c",NULL}' as ['a', 'b,c', None]; a quoted "null" is text. Raises ValueError without braces."""
    if literal is None:
        return None
    if len(literal) < 2 or literal[0] != "{" or literal[-1] != "}":
        raise ValueError(f"not an array literal: {literal!r}")
    return [None if not quoted and text.lower() == "null" else text for text, quoted in _elements(literal[1:-1])]


def parse_composite(literal: str | None, fields: int | None = None) -> list[str | None] | None:
    """'(1,"a b",)' as ['1', 'a b', None]; an empty unquoted field is null."""
    if literal is None:
        return None
    if len(literal) < 2 or literal[0] != "(" or literal[-1] != ")":
        raise ValueError(f"not a composite literal: {literal!r}")
    found = [None if not quoted and not text else text for text, quoted in _elements(literal[1:-1])]
    if fields is not None and len(found) != fields:
        raise ValueError(f"{len(found)} fields, not {fields}: {literal!r}")
    return found


def _lenient(parse: Callable) -> Callable:
    def one(x):
        try:
            return parse(x)
        except ValueError:
            return None

    return one


def array_elements(text: Column) -> Column:
    """The literal's elements as strings; null for what isn't a literal."""
    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(_lenient(parse_array))

    return run(text)


def composite_fields(text: Column, fields: list[str]) -> Column:
    """The literal's fields as a struct of strings."""
    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(_lenient(lambda v: parse_composite(v, len(fields))))

    parsed = run(text)
    return F.when(parsed.isNotNull(), F.struct(*[F.get(parsed, i).alias(f) for i, f in enumerate(fields)]))


def composite_array(text: Column, fields: list[str]) -> Column:
    @F.pandas_udf("array<array<string>>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(_lenient(lambda v: None if v is None else [parse_composite(e, len(fields)) for e in parse_array(v)]))

    return F.transform(run(text), lambda e: F.when(e.isNotNull(), F.struct(*[F.get(e, i).alias(f) for i, f in enumerate(fields)])))
