"""Functions of text columns. Patterns are Java regular expressions; group references are written as in Python."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidymesh.expr import as_column, scalar


def _replacement(text: str) -> str:
    r"""\1 and \g<1> as $1; signs that Java would read stay plain."""
    text = text.replace("$", "\\$")
    return re.sub(r"\\g<(\d+)>|\\(\d+)", lambda m: f"${m[1] or m[2]}", text)


@scalar
def str_c(*args: Any, sep: str = "") -> Column:
    """All as text, one after the other; missing ones as "nan"."""
    return F.concat_ws(sep, *(F.coalesce(as_column(a).cast("string"), F.lit("nan")) for a in args))


@scalar
def str_detect(string: Column, pattern: str) -> Column:
    return string.rlike(pattern)


@scalar
def str_locate(string: Column, pattern: str) -> Column:
    """Places, from 0, at which matches start."""
    none = F.array().cast("array<int>")
    pieces = F.arrays_zip(F.split(string, pattern, -1).alias("a"), F.regexp_extract_all(string, F.lit(pattern), F.lit(0)).alias("m"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["a"])
        out = F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(at)))
        return F.struct((at + F.length(F.coalesce(x["m"], F.lit("")))).alias("at"), out.alias("out"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(string.rlike(pattern), found).when(string.isNotNull(), none)


@scalar
def str_which(string: Column, pattern: str) -> Column:
    """Place, from 0, of the first match; missing if there is none."""
    return F.nullif(F.regexp_instr(string, F.lit(pattern)), F.lit(0)) - 1


@scalar
def str_count(string: Column, pattern: str) -> Column:
    return F.regexp_count(string, F.lit(pattern))


@scalar
def str_sub(string: Column, start: int = 0, end: int | None = None) -> Column:
    """As Python's string[start:end]."""
    n = F.length(string)

    def place(i: int) -> Column:
        return F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)

    a, b = place(start), n if end is None else place(end)
    return F.substring(string, a + 1, F.greatest(b - a, F.lit(0)))


@scalar
def str_extract(string: Column, pattern: str) -> Column:
    """The first match, or empty text."""
    return F.regexp_extract(string, pattern, 0)


@scalar
def str_replace(string: Column, pattern: str, replacement: str) -> Column:
    """The first match replaced."""
    shifted = re.sub(r"\\g<(\d+)>|\\(\d+)", lambda m: f"\\g<{int(m[1] or m[2]) + 1}>", replacement)
    return F.regexp_replace(string, f"(?s)\\A(.*?)(?-s:{pattern})", "$1" + _replacement(shifted))


@scalar
def str_replace_all(string: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(string, pattern, _replacement(replacement))


@scalar
def str_split(string: Column, pattern: str, maxsplit: int = 0) -> Column:
    """Pieces between matches, after ``maxsplit`` cuts (0: all)."""
    return F.split(string, pattern, maxsplit + 1 if maxsplit else -1)


@scalar
def str_to_lower(string: Column) -> Column:
    return F.lower(string)


@scalar
def str_to_upper(string: Column) -> Column:
    return F.upper(string)


@scalar
def str_to_snake(string: Column) -> Column:
    """Runs of white space as one underscore."""
    return F.regexp_replace(string, r"\s+", "_")
