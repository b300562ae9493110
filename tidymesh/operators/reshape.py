"""Wide and long, split and joined columns."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidymesh.operators.select import quoted, resolve_selection
from tidymesh.table import Table, add_pipe, flatten, named, verb


def _common_type(df: DataFrame, names: list[str]) -> str:
    kinds = {df.schema[c].dataType.simpleString() for c in names}
    if len(kinds) == 1:
        return kinds.pop()
    return "double" if all(isinstance(df.schema[c].dataType, T.NumericType) for c in names) else "string"


def unpivoted(df: DataFrame, ids: list[str], values: list[str], key: str, value: str) -> DataFrame:
    """Long form: Spark's unpivot, with the values cast to a common type first."""
    kind = _common_type(df, values)
    cast = df.select(*quoted(ids), *(F.col(f"`{c}`").cast(kind).alias(c) for c in values))
    return cast.unpivot(quoted(ids), quoted(values), key, value)


#: Columns that a pivot may make of one key's levels.
LEVELS = 10_000


@verb
def tran_gather(df: Table, key: str, values: str, *args: Any, add_id: bool = False) -> Table:
    """Columns to (key, value) rows; all columns if none are given. ``add_id``: the row's number as _ID."""
    from tidymesh.plans.rowindex import with_row_index

    names = resolve_selection(df.columns, *args) if args else df.columns
    given = with_row_index(df.df, list(df.order), "_ID") if add_id else df.df
    ids = [c for c in given.columns if c not in names]
    return df.to(unpivoted(given, ids, names, key, values), order=())


def _pivoted(df: DataFrame, ids: list[str], key: str, values: list[str], fill: Any = None) -> DataFrame:
    """Wide form. Levels are found first, as they become columns: more than LEVELS raise. Repeated cells raise when run."""
    found = df.select(F.col(f"`{key}`")).where(F.col(f"`{key}`").isNotNull()).distinct().limit(LEVELS + 1).collect()
    if len(found) > LEVELS:
        raise ValueError(f"{key} has more than {LEVELS} levels, too many for columns")
    levels = sorted(r[0] for r in found)
    cells: list[Column] = []
    for v in values:
        c = F.col(f"`{v}`")
        one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one value for a cell: the ids don't tell rows apart")).cast(df.schema[v].dataType)).otherwise(F.first(c))
        cells.append(one.alias(v))
    out = df.groupBy(*quoted(ids)).pivot(key, levels).agg(*cells)
    if len(values) == 1:
        out = out.toDF(*ids, *(str(x) for x in levels))
    if fill is not None:
        out = out.na.fill(fill, subset=[c for c in out.columns if c not in ids])
    return out


@verb
def tran_spread(df: Table, key: Any, values: Any, convert: bool = False, fill: Any = None) -> Table:
    """(key, value) rows to columns, over all other columns; rows that these don't tell apart are an error."""
    key, values = named(key), named(values)
    ids = [c for c in df.columns if c not in (key, values)]
    out = _pivoted(df.df, ids, key, [values], fill)
    if convert:
        out = convert_type(out, [c for c in out.columns if c not in ids])
    return Table(out, order=tuple(k.asc_nulls_last() for k in quoted(ids)))


def convert_type(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns whose known values all read as truth values, numbers or times become such; one pass looks at all."""
    names = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not names:
        return df
    tests = []
    for c in names:
        x = F.col(f"`{c}`")
        fails = lambda ok: F.count(F.when(x.isNotNull() & ~F.coalesce(ok, F.lit(False)), 1))  # noqa: B023, E731
        tests += [fails(F.lower(x).isin("true", "false")), fails(x.try_cast("bigint").isNotNull()), fails(x.try_cast("double").isNotNull()), fails(x.try_cast("timestamp").isNotNull()), F.count(x)]
    row = df.agg(*(t.alias(str(i)) for i, t in enumerate(tests))).first()
    made = {}
    for i, c in enumerate(names):
        no_bool, no_int, no_float, no_time, known = row[5 * i : 5 * i + 5]
        if known:
            kind = "boolean" if not no_bool else "bigint" if not no_int else "double" if not no_float else "timestamp" if not no_time else None
            if kind:
                made[c] = F.col(f"`{c}`").cast(kind)
    return df.withColumns(made)


@verb
def tran_separate(df: Table, column: Any, into: list[str], sep: str | list[int] = r"[\W_]+", remove: bool = True, convert: bool = False, extra: str = "drop", fill: str = "right") -> Table:
    """A text column cut into columns: at matches of ``sep``, or at places.

    ``extra``: pieces too many are dropped or merged into the last. ``fill``: pieces that lack are missing at the
    right or left end. Empty pieces are missing.
    """
    name = named(column)
    c, n = F.col(f"`{name}`"), len(into)
    if isinstance(sep, str):
        pieces = F.split(c, sep, n if extra == "merge" else -1)
        short = F.greatest(F.lit(n) - F.size(pieces), F.lit(0))
        at = lambda i: F.get(pieces, F.lit(i) - (short if fill == "left" else 0))
        cells = [F.when(at(i) != "", at(i)) for i in range(n)]
    else:
        cuts = [0, *sep]
        cells = []
        for i in range(n):
            a = cuts[i] if i < len(cuts) else None
            b = cuts[i + 1] if i + 1 < len(cuts) else None
            piece = F.lit(None).cast("string") if a is None else F.substring(c, F.lit(a + 1), F.lit(b - a) if b is not None else F.length(c))
            cells.append(F.when(piece != "", piece))
    kept = [x for x in df.columns if x not in into and not (remove and x == name)]
    out = df.df.select(*quoted(kept), *(x.alias(k) for k, x in zip(into, cells)))
    return df.to(convert_type(out, into) if convert else out)


@verb
def tran_unite(df: Table, colname: str, *args: Any, sep: str = "_", remove: bool = True, na_action: str = "maintain") -> Table:
    """Columns joined to one text. Missing parts make it missing (``maintain``), are passed over (``ignore``), or are
    written "nan" (``as_string``)."""
    names = resolve_selection(df.columns, *args)
    parts = [F.col(f"`{c}`").cast("string") for c in names]
    if na_action == "ignore":
        made = F.concat_ws(sep, *parts)
    elif na_action == "as_string":
        made = F.concat_ws(sep, *(F.coalesce(p, F.lit("nan")) for p in parts))
    elif na_action == "maintain":
        known = F.lit(True)
        for p in parts:
            known = known & p.isNotNull()
        made = F.when(known, F.concat_ws(sep, *parts))
    else:
        raise ValueError("na_action: maintain, ignore or as_string")
    kept = [c for c in df.columns if not (remove and c in names) and c != colname]
    return df.to(df.df.select(*quoted(kept), made.alias(colname)))


@verb
def tran_explode(df: Table, col: Any, convert: bool = False) -> Table:
    """A row for each item of a list column; an empty or missing list gives one row without a value."""
    name = named(col)
    if not isinstance(df.df.schema[name].dataType, T.ArrayType):
        return df
    out = df.df.select(*(F.explode_outer(F.col(f"`{name}`")).alias(name) if c == name else F.col(f"`{c}`") for c in df.columns))
    return df.to(convert_type(out, [name]) if convert else out, order=())


def pivot_select(df: DataFrame, columns: Any) -> list[str]:
    if isinstance(columns, DataFrame):
        return columns.columns
    return resolve_selection(df.columns, *(columns if isinstance(columns, (list, tuple)) else [columns]))


def split_cleanup(name: str, n: int, names_sep: Any, names_pattern: str | None) -> list[str | None]:
    """The parts of a column's name."""
    if names_pattern is not None:
        m = re.search(names_pattern, name)
        parts = list(m.groups()) if m else []
    elif isinstance(names_sep, str):
        parts = re.split(names_sep, name)
    else:
        cuts = [0, *([names_sep] if isinstance(names_sep, int) else names_sep), len(name)]
        parts = [name[a:b] for a, b in zip(cuts, cuts[1:])]
    return [*parts, *[None] * n][:n]


@verb
def tran_pivot_longer(df: Table, columns: Any, index_to: str | None = None, names_to: Any = None, names_sep: Any = None, names_pattern: str | None = None, values_to: str | None = None) -> Table:
    """Columns to rows. Their names go to ``names_to``, one name or several for parts of them (cut by ``names_sep``, a
    pattern or places, or by the groups of ``names_pattern``); the part ".value" names the value columns."""
    from tidymesh.plans.rowindex import with_row_index

    names = pivot_select(df.df, columns)
    if not names:
        raise ValueError("no columns to pivot")
    targets = [names_to] if isinstance(names_to, str) else list(names_to or ["variable"])
    if len(targets) > 1 and names_sep is None and names_pattern is None:
        raise ValueError("several names_to need names_sep or names_pattern")
    if names_sep is not None and names_pattern is not None:
        raise ValueError("names_sep or names_pattern, not both")
    if ".value" not in targets and values_to is None:
        values_to = "value"
    if ".value" in targets and values_to is not None:
        raise ValueError('".value" names the values; values_to has no use')
    given = with_row_index(df.df, list(df.order), index_to) if index_to else df.df
    ids = [c for c in given.columns if c not in names]
    split = {c: [c] if names_sep is None and names_pattern is None else split_cleanup(c, len(targets), names_sep, names_pattern) for c in names}
    if ".value" not in targets:
        kind = _common_type(given, names)
        rows = F.array(*(F.struct(*(F.lit(p).cast("string").alias(t) for t, p in zip(targets, split[c])), F.col(f"`{c}`").cast(kind).alias(values_to)) for c in names))
    else:
        at = targets.index(".value")
        outs = list(dict.fromkeys(split[c][at] for c in names))
        rest = list(dict.fromkeys(tuple(p for i, p in enumerate(split[c]) if i != at) for c in names))
        kinds = {o: _common_type(given, [c for c in names if split[c][at] == o]) for o in outs}
        other = [t for t in targets if t != ".value"]
        structs = []
        for r in rest:
            cells = []
            for o in outs:
                c = next((c for c in names if split[c][at] == o and tuple(p for i, p in enumerate(split[c]) if i != at) == r), None)
                cells.append((F.col(f"`{c}`") if c else F.lit(None)).cast(kinds[o]).alias(o))
            structs.append(F.struct(*(F.lit(p).cast("string").alias(t) for t, p in zip(other, r)), *cells))
        rows = F.array(*structs)
    out = given.select(*quoted(ids), F.explode(rows).alias("__r"))
    fields = [f.name for f in out.schema["__r"].dataType.fields]
    return df.to(out.select(*quoted(ids), *(F.col("__r")[f].alias(f) for f in fields)), order=())


@verb
def tran_pivot_wider(df: Table, names_from: Any, indexes_from: Any = None, values_from: Any = None) -> Table:
    """Rows to columns; the ids are ``indexes_from`` or all other columns. Without any, each row stays a row."""
    key = named(names_from)
    values = [named(v) for v in flatten([values_from])] if values_from is not None else [next(c for c in reversed(df.columns) if c != key)]
    ids = [named(i) for i in flatten([indexes_from])] if indexes_from is not None else [c for c in df.columns if c != key and c not in values]
    given = df.df
    if not ids:
        given, ids = given.withColumn("__row", F.monotonically_increasing_id()), ["__row"]
    out = _pivoted(given.select(*quoted([*ids, key, *values])), ids, key, values)
    return Table(out.drop("__row"))


tf_gather, tf_spread, tf_separate, tf_unite, tf_explode = map(add_pipe, (tran_gather, tran_spread, tran_separate, tran_unite, tran_explode))
tf_pivot_longer, tf_pivot_wider = map(add_pipe, (tran_pivot_longer, tran_pivot_wider))
