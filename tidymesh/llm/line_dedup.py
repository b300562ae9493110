"""Lines that follow a template which recurs across documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymesh.llm.common import attach_groups, let, numbered, renamed, running, settle, text_or_empty

#: Leading tokens on the way from the root (the number of tokens) to a leaf of the tree.
LEADING = 2
#: Groups that are broadcast as they are; few, so that small and large inputs go the same way.
BROADCAST = 1000
#: Comparisons of lines with dropped ones that a document's lines are looked up by; beyond, both are sorted.
COMPARED = 4096


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda t: t != "")


def _leaf(tokens: Column) -> Column:
    """The path of a line in the tree: its number of tokens, then its leading tokens, those with a digit as "*"."""
    lead = F.transform(F.slice(tokens, 1, LEADING), lambda t: F.when(t.rlike("[0-9]"), F.lit("*")).otherwise(t))
    return F.concat_ws(" ", F.size(tokens).cast("string"), lead)


def _key(*parts: Column | str) -> Column:
    return F.hex(F.xxhash64(*parts))


def recurring_keys(rows: DataFrame, keys: DataFrame, of: dict[str, Column]) -> DataFrame:
    """``rows`` plus, for each name in ``of``, whether that hash may be among ``keys`` (settled; key long).

    The keys' lowest bits are put down in bitmaps, 64 bits for a key and at most 2**28 (32 MB), which are broadcast whatever the number of
    keys: so rows with their texts stay where they are. Some that aren't there pass, which costs time and no more.
    """
    bits = min(28, max(15, math.ceil(math.log2(64 * max(1, keys.count())))))
    at = lambda key: F.pmod(key, F.lit(1 << bits))
    maps = keys.select(at(F.col("key")).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("__bits"))
    out = rows
    for name, key in of.items():
        place = F.bitmap_bit_position(at(key))
        byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1
        own = F.broadcast(maps.select(F.col("__bucket").alias(f"__{name}"), "__bits"))
        out = out.join(own, (F.bitmap_bucket_number(at(key)) == F.col(f"__{name}")) & hit, "left").withColumn(name, F.col(f"__{name}").isNotNull()).drop("__bits", f"__{name}")
    return out


def without(lines: Column, gone: Column) -> Column:
    """The lines whose keys aren't among ``gone``: few are looked up one by one; of many, the keys of both are sorted, and a mark goes on from a
    dropped key to the lines after it that have the same, so the time is n log n."""

    def key_of(x: Column) -> Column:
        return _key(_leaf(_tokens(x)), x)

    def entry(key: Column, place: Column, line: Column, drop: bool) -> Column:
        return F.struct(key.alias("key"), place.alias("place"), line.alias("line"), F.lit(drop).alias("drop"))

    def onward(a: Column, b: Column) -> Column:
        drop = b["drop"] | (a["drop"] & F.coalesce(a["key"] == b["key"], F.lit(False)))
        return F.struct(b["key"].alias("key"), b["place"].alias("place"), b["line"].alias("line"), drop.alias("drop"))

    def kept(x: Column) -> Column:
        of_lines = F.filter(x, lambda e: (e["place"] >= 0) & ~e["drop"])
        ordered = F.array_sort(F.transform(of_lines, lambda e: F.struct(e["place"].alias("place"), e["line"].alias("line"))))
        return F.transform(ordered, lambda e: e["line"])

    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(-1).alias("place"), F.lit("").alias("line"), F.lit(False).alias("drop"))
    both = F.concat(F.transform(gone, lambda k: entry(k, F.lit(-1), F.lit(""), True)), F.transform(lines, lambda x, i: entry(key_of(x), i, x, False)))
    sorted_ = let(running(F.array_sort(both), onward, none), kept)
    few = F.size(lines).cast("long") * F.size(gone) <= COMPARED
    return F.when(few, F.filter(lines, lambda x: ~F.array_contains(gone, key_of(x)))).otherwise(sorted_)


def dedup_lines(docs: DataFrame, min_docs: int = 4, min_tokens: int = 3, constant: float = 0.6, id_col: str = "doc_id", text_col: str = "text", long_tokens: int = 50) -> DataFrame:
    """``docs`` with the text's recurring lines dropped, and n_lines, n_dropped (which replace columns so named).

    A line of ``min_tokens`` or more tokens (cut at spaces) goes down a tree of fixed depth: its number of tokens,
    then its first two tokens. In its leaf, a token is constant where ``min_docs`` or more (document, line) pairs
    have it at that place, and else a variable field; constant tokens and fields make the line's template. If at
    least the share ``constant`` of the tokens is constant, and ``min_docs`` documents have the template, its lines
    are dropped from all of them but the one with the smallest id. A line of ``long_tokens`` or more tokens is a template as it
    stands too, for which two documents are enough: a passage of that length doesn't recur by chance.

    Equal lines of a leaf are taken together before tokens are told apart, all counts add up before they are
    shuffled, and what is looked up by hot lines, tokens and templates goes by attach_groups, so no task gathers
    them. Leaves with too few lines fall away first, by broadcast bitmaps, so most of the text is never shuffled nor cut into token rows. Tokens are told apart per leaf, so a
    value that recurs in one template of a leaf counts as constant in the others of that leaf too.

    Null texts count as empty and stay null; rows with a null id keep all their lines and aren't counted; rows that
    repeat an id are one document. Empty lines are never dropped. Lines are told apart by 64-bit hashes.
    """
    plain, names = numbered(docs)
    row_id, text = F.col(names[id_col]), text_or_empty(names[text_col])
    found = plain.where(row_id.isNotNull()).select(row_id.alias("id"), F.explode(F.array_distinct(F.split(text, "\n"))).alias("line"))
    lines = found.withColumn("tokens", _tokens(F.col("line"))).where(F.size("tokens") >= min_tokens)
    lines = lines.select("id", "line", (F.size("tokens") >= long_tokens).alias("long"), _leaf(F.col("tokens")).alias("leaf"))
    # keys of leaves are even, those of long lines odd
    of_leaf, of_line = F.shiftleft(F.xxhash64("leaf"), 1), F.when(F.col("long"), F.shiftleft(F.xxhash64("leaf", "line"), 1) + 1)
    keys = lines.select(F.explode(F.array_compact(F.array(of_leaf, of_line))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    often = settle(keys.where(F.col("n") >= F.when(F.col("key") % 2 == 0, min_docs).otherwise(2)).select("key"), "often")
    kept = recurring_keys(lines, often, {"leaf_again": of_leaf, "line_again": of_line}).where("leaf_again OR line_again")
    kept = settle(kept.select("id", "leaf", "line", "long", "leaf_again", _key("leaf", "line").alias("lid")), "lines")
    n_kept = kept.count()

    unique = settle(kept.groupBy("lid", "leaf", "line").agg(F.count("*").alias("c"), F.first("long").alias("long"), F.first("leaf_again").alias("leaf_again")), "unique")
    cells = unique.where("leaf_again").withColumn("tokens", _tokens(F.col("line"))).select("lid", "c", "leaf", F.size("tokens").alias("n"), F.posexplode("tokens").alias("i", "token"))
    cells = cells.withColumn("cell", _key("leaf", "i", "token"))
    support = settle(cells.groupBy("cell").agg(F.sum("c").alias("support")).where(F.col("support") >= min_docs), "support")
    met = attach_groups(cells.select("lid", "c", "n", "i", "token", "cell"), support, "cell", "support", n_kept, F.col("lid"), few=BROADCAST)
    # only the constant tokens of a line go on, with their places: they and its number of tokens make the template
    known = F.col("support").isNotNull()
    parts = F.array_sort(F.collect_list(F.when(known, F.struct("i", "token"))))
    templates = (met.where(known) if constant > 0 else met).groupBy("lid", "c", "n").agg(parts.alias("parts")).where(F.size("parts") >= constant * F.col("n"))
    spelled = F.array_join(F.transform("parts", lambda p: F.concat_ws(" ", p["i"].cast("string"), p["token"])), "\n")
    templates = templates.select("lid", "c", F.md5(F.concat_ws("\n", F.col("n").cast("string"), spelled)).alias("template"), F.lit(min_docs).alias("least"))
    literal = unique.where("long AND c >= 2").select("lid", "c", F.concat(F.lit("line "), "lid").alias("template"), F.lit(2).alias("least"))
    # one or two for each line
    templates = templates.unionByName(literal).groupBy("lid", "c").agg(F.collect_list(F.struct("template", "least")).alias("of"))
    templates = settle(templates, "templates")

    of = attach_groups(kept.select("id", "lid"), templates, "lid", "c", n_kept, F.col("id"), few=BROADCAST).where("of IS NOT NULL").select("id", "lid", F.explode("of").alias("of"))
    of = settle(of.select("id", "lid", "of.template", "of.least"), "templated")
    docs_of = of.groupBy("template", "least", "id").agg(F.lit(1).alias("one")).groupBy("template", "least").agg(F.count("*").alias("docs"), F.min("id").alias("first"))
    recurring = settle(docs_of.where(F.col("docs") >= F.col("least")).drop("least"), "recurring")
    gone = attach_groups(of, recurring, "template", "docs", n_kept, F.col("id"), few=BROADCAST).where(F.col("first").isNotNull() & (F.col("id") != F.col("first")))
    # the lines of one document
    gone = gone.groupBy("id").agg(F.collect_set("lid").alias("gone"))

    split = F.split(F.col(names[text_col]), "\n")
    whole = plain.join(gone, row_id == F.col("id"), "left")
    left = let(split, lambda lines: without(lines, F.col("gone")))
    whole = whole.withColumn("left", F.when(F.col("gone").isNull(), split).otherwise(left))
    new = {
        text_col: F.when(F.col("gone").isNull(), F.col(names[text_col])).otherwise(F.array_join("left", "\n")),
        "n_lines": F.coalesce(F.size(split), F.lit(1)).cast("long"),
        "n_dropped": F.coalesce(F.size(split) - F.size("left"), F.lit(0)).cast("long"),
    }
    return renamed(whole, names, new)
