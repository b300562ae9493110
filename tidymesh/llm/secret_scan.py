"""Secrets by pattern, and by tests of randomness on strings that no pattern names."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidymesh.llm.common import let, numbered, renamed, running, settle, text_or_empty

#: The base patterns, in the order in which ties are listed.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
ASSIGN_LEAST = 6
KINDS = [*PATTERNS, "random"]

#: Tried only where a run of such characters starts (so the time is linear in its length); '=' pads at the end, or parts
#: a name from its value, which is then a candidate of its own.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?+"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encoding: the pattern that infers it, and its alphabet in order. The two url-safe signs stand for the two usual ones.
ENCODINGS = {
    "hex": (r"^(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef"),
    "HEX": (r"^(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF"),
    "base32": (r"^(?=.*[A-Z])[A-Z2-7]+=*$", UPPER + "234567"),
    "base36": (r"^(?=.*[A-Z])[A-Z0-9]+$", UPPER + DIGITS),
    "base32 lower": (r"^(?=.*[a-z])[a-z2-7]+=*$", LOWER + "234567"),
    "base36 lower": (r"^(?=.*[a-z])[a-z0-9]+$", LOWER + DIGITS),
    "letters": (r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z+/_-]+=*$", UPPER + LOWER + "+/"),
    "base64": (r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+=*$", UPPER + LOWER + DIGITS + "+/"),
}
#: Lengths at which a stratum starts.
STRATA = (20, 24, 28, 32, 40, 48, 64, 96)
STEP, MOST = 0.05, 20.0
#: A deviate from which the battery rejects randomness.
REJECTED = 3.3

#: Words that the names in programs and configurations are made of, and such of hexadecimal digits.
WORDS = """account action active add address admin all alpha amount api app archive array auth available back balance base batch before begin block
body book buffer build button by cache call cancel catalog category channel check child class clear client close cloud code color column command
comment common complete component config connect content context control copy count country create current customer data date day default delete
delivery description detail device dialog direct disable display document domain download driver edit element email enable end engine entity entry
error event example export field file filter final first flag folder for format from full function game get global grid group handler has header
height hello history home host image import in index info input insert instance invoice is item job key label language last layer layout length level
library limit line link list load local lock log login main manager map max member menu message method mode model module month my name network new next
node not number object of on open option order other output package page panel parent part path payment plan player point position post""".split()
HEX_WORDS = "dead beef cafe babe face feed fade bad add decade facade ace bed dad fed ffff 0000 1234 2024 00ff 1111 aaaa 1999".split()


def _located(text: Column, pattern: str) -> Column:
    """All matches with start and end in code points: what lies between them is split off, and lengths summed."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    pieces = F.struct(F.transform(F.split(text, pattern, -1), lambda a: F.length(a)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def spans(x: Column) -> Column:
        ends = running(F.zip_with(F.slice(x["a"], F.lit(1), F.size(x["m"])), x["m"], lambda a, m: a + F.length(m)), lambda a, b: a + b, F.lit(0))
        return F.zip_with(ends, x["m"], lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))

    return F.when(text.rlike(pattern), let(pieces, spans)).otherwise(none)


def _cell(c: str) -> str:
    """Vowels, other capitals, other small letters, digits and signs."""
    return "0" if c.lower() in "aeiou" else "1" if c in UPPER else "2" if c in LOWER else "3"


def _case(c: str) -> str:
    return "0" if c in UPPER else "1" if c in LOWER else "2"


def _deviate(token: Column, encoding: Column) -> Column:
    """How far a string is from uniform and independent draws out of its encoding's alphabet: the normal deviate of the
    battery.

    Chi-squared over all of the alphabet (an excess of repeats counts) and over its kinds of letters; runs above and below
    the alphabet's middle, of one case, and of vowels; the correlation of neighbours. The squares add up to about chi-squared, which
    its cube root takes to a normal deviate.
    """
    def indexes(text: Column, letters: Column) -> Column:
        return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.call_function("instr", letters, c) - 1)

    parts = []
    for _, letters in ENCODINGS.values():
        k = len(letters)

        def shares(of: Callable[[str], str], letters: str = letters, k: int = k) -> list[float]:
            return [sum(of(c) == d for c in letters) / k for d in "0123"]

        cells, cases = shares(_cell), shares(_case)
        text = F.translate(F.call_function("rtrim", F.lit("="), token), "-_", "+/")
        translated = [F.translate(text, letters, "".join(map(of, letters))) for of in (_cell, _case, lambda c: str(int(_cell(c) == "0")), lambda c, letters=letters, k=k: "1" if letters.index(c) * 2 >= k else "0")]
        parts.append((k, cells, cases, translated, indexes(text, F.lit(letters))))

    def runs(s: Column) -> Column:
        return F.length(F.regexp_replace(s, r"(.)\1+", "$1")).cast("double")

    def pair(acc: Column, x: Column) -> Column:
        run = F.when(x == acc["x"], acc["run"] + 1).otherwise(0.0)
        return F.struct(x.alias("x"), run.alias("run"), (acc["out"] + run).alias("out"))

    def battery(k: int, cells: list[float], cases: list[float], translated: list[Column], index: Column) -> Column:
        def tests(x: Column) -> Column:
            ix, n, mean = x["ix"], x["n"], x["mean"]
            equal = F.aggregate(F.sort_array(ix), F.struct(F.lit(-1).alias("x"), F.lit(0.0).alias("run"), F.lit(0.0).alias("out")), pair, lambda acc: acc["out"])
            over = F.greatest((k + 2 * k * equal / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n), F.lit(0.0))
            chi, kinds = F.lit(0.0), 0
            for d, share in zip("0123", cells):
                if share:
                    seen = n - F.length(F.replace(x["cells"], F.lit(d), F.lit("")))
                    chi, kinds = chi + (seen - n * share) * (seen - n * share) / (n * share), kinds + 1
            out, df = over * over + chi, 0.5 + kinds - 1
            # names change their case less often than draws do, and go from vowels to others more often, so one side counts there
            for s, changes, side in ((x["cases"], 1 - sum(p * p for p in cases), -1), (x["sounds"], 2 * cells[0] * (1 - cells[0]), 1), (x["half"], 0.5, 0)):
                if changes > 0:
                    z = (runs(s) - 1 - (n - 1) * changes) / F.sqrt((n - 1) * changes * (1 - changes))
                    z = F.greatest(z * side, F.lit(0.0)) if side else z
                    out, df = out + z * z, df + (0.5 if side else 1)
            spread = F.aggregate(ix, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
            near = F.zip_with(F.slice(ix, F.lit(1), F.size(ix) - 1), F.slice(ix, F.lit(2), F.size(ix) - 1), lambda y, z: (y - mean) * (z - mean))
            serial = (F.coalesce(F.try_divide(F.aggregate(near, F.lit(0.0), lambda a, y: a + y), spread), F.lit(1.0)) + 1 / n) * F.sqrt(n)
            out, df = out + serial * serial, df + 1
            return (F.pow(out / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))

        told = F.struct(index.alias("ix"), *(s.alias(name) for name, s in zip(("cells", "cases", "sounds", "half"), translated)))

        def measured(x: Column) -> Column:
            n = F.size(x["ix"]).cast("double")
            mean = F.aggregate(x["ix"], F.lit(0.0), lambda a, y: a + y) / n
            return F.struct(x["ix"].alias("ix"), n.alias("n"), mean.alias("mean"), x["cells"].alias("cells"), *(x[name].alias(name) for name in ("cases", "sounds", "half")))

        return let(let(told, measured), tests)

    value = F.lit(None).cast("double")
    for i, x in enumerate(parts):
        value = F.when(encoding == i, battery(*x)).otherwise(value)
    return F.least(value, F.lit(MOST))


def _inferred(token: Column) -> Column:
    """The place in ENCODINGS of the first that fits, or null."""
    out = F.lit(None).cast("int")
    for i, (pattern, _) in reversed(list(enumerate(ENCODINGS.values()))):
        out = F.when(token.rlike(pattern), F.lit(i)).otherwise(out)
    return out


def _stratum(length: Column) -> Column:
    return sum(((length >= n).cast("int") for n in STRATA), F.lit(-1))


def ordinary(n: int, seed: int = 1) -> list[str]:
    """Names such as people make: words put together in all usual ways, some with numbers, some of hexadecimal words; lengths are even over each
    stratum."""
    rng, out = random.Random(seed), []
    ends = [*STRATA[1:], 160]
    for lo, hi in zip(STRATA, ends):
        for style in ("lower", "UPPER", "camel", "Pascal", "path", "lower9", "UPPER9", "camel9", "hex", "HEX"):
            for _ in range(n):
                size, parts = rng.randrange(lo, hi), []
                bound = rng.choice("_-/") if style == "path" else ""
                while len(bound.join(parts)) < size:
                    word = rng.choice(HEX_WORDS if "hex" in style.lower() else WORDS)
                    if "9" in style and rng.random() < 0.3:
                        word += str(rng.randrange(10 ** rng.randint(1, 4)))
                    parts.append(word.upper() if style[0] in "UH" else word.capitalize() if style in ("Pascal", "path") or parts and style[0] == "c" else word)
                out.append(bound.join(parts)[:size])
    return out


_null: list[tuple[float, float]] = []


def null_model(spark: SparkSession, n: int = 80) -> list[tuple[float, float]]:
    """(middle, spread) of the deviates of ``ordinary`` names for each encoding and stratum, from their lower half, which is
    where names come near to random strings. They don't depend on the documents and are computed once in a session."""
    if not _null:
        names = spark.createDataFrame([(x,) for x in ordinary(n)], "m string").repartition(8)
        told = names.withColumn("k", _inferred(F.col("m"))).where("k IS NOT NULL").select("k", _stratum(F.length("m")).alias("s"), _deviate(F.col("m"), F.col("k")).alias("z"))
        groups = defaultdict(list)
        for r in told.collect():
            groups[r.k, r.s].append(r.z)
        for k in range(len(ENCODINGS)):
            for s in range(len(STRATA)):
                z = sorted(groups[k, s]) or [0.0]
                middle, low = z[len(z) // 2], z[int(len(z) * 0.05)]
                _null.append((middle, max(0.5, (middle - low) / 1.645)))
    return _null


def _outside(base: Column, found: Column) -> Column:
    """Of the strings found, those that lie in no base match: such a match starts no later and ends no sooner, so each is held against the furthest
    end of the base matches up to it."""

    def told(x: Column, k: int | Column, m: Column) -> Column:
        return F.struct(x["s"].alias("s"), (F.lit(k) if isinstance(k, int) else k).alias("k"), x["e"].alias("e"), m.alias("m"))

    def free(x: Column) -> Column:
        furthest = running(F.transform(x, lambda y: F.when(y["k"] < len(PATTERNS), y["e"]).otherwise(0)), lambda a, b: F.greatest(a, b), F.lit(0))
        met = F.zip_with(x, furthest, lambda y, f: F.struct(y.alias("x"), ((y["k"] == len(PATTERNS)) & (y["e"] > f)).alias("kept")))
        return F.transform(F.filter(met, lambda y: y["kept"]), lambda y: y["x"])

    both = F.concat(F.transform(base, lambda x: told(x, x["k"], F.lit(""))), F.transform(found, lambda x: told(x, len(PATTERNS), x["m"])))
    return F.when(F.size(found) == 0, F.slice(both, F.lit(1), F.lit(0))).otherwise(let(F.array_sort(both), free))


def _candidates(found: Column, null: list[tuple[float, float]]) -> Column:
    """array<struct<s, e, stratum, b>> of the strings found that have an inferred encoding; b: the step of the deviate among those of ordinary names,
    the last where the battery rejects randomness."""
    middle, spread = (F.array(*(F.lit(float(x[i])) for x in null)) for i in (0, 1))
    inferred = F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), _inferred(x["m"]).alias("k"), _stratum(x["e"] - x["s"]).alias("stratum")))
    told = F.transform(F.filter(inferred, lambda x: x["k"].isNotNull()), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["stratum"].alias("stratum"), x["k"].alias("k"), _deviate(x["m"], x["k"]).alias("z")))

    def placed(x: Column) -> Column:
        at = x["k"] * len(STRATA) + x["stratum"] + 1
        t = F.when(x["z"] < REJECTED, (x["z"] - F.element_at(middle, at)) / F.element_at(spread, at)).otherwise(MOST)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["stratum"].alias("stratum"), F.floor(F.greatest(t, F.lit(-MOST)) / STEP).cast("int").alias("b"))

    return F.transform(told, placed)


def limits(seen: dict[int, dict[int, int]], rate: float) -> list[int]:
    """For each stratum the greatest step that is told a secret, by Benjamini and Hochberg's step-up rule: the share of ordinary names among what is
    told a secret is at most ``rate``. ``seen``: number of candidates by stratum and step."""
    out = []
    for k in range(len(STRATA)):
        own, so_far, limit = seen.get(k, {}), 0, -int(MOST / STEP) - 1
        total = sum(own.values())
        for b in sorted(own):
            so_far += own[b]
            if b < MOST / STEP and NormalDist().cdf((b + 1) * STEP) <= rate * so_far / total:
                limit = b
        out.append(limit)
    return out


def _base(text: Column) -> Column:
    def of_kind(found: Column, k: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    base = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        found = _located(text, pattern)
        if kind == "assign":
            found = F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], PATTERNS["assign"], 1)) >= ASSIGN_LEAST)
        base.append(of_kind(found, k))
    return F.concat(*base)


def find_secrets(docs: DataFrame, text_col: str = "text", rate: float = 0.05, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (of it the columns ``keep``, if given) with secret_spans (replaced if there): array<struct<s int, k int, e int>> in
    order of start, place in KINDS, end (code points of the whole text, end exclusive): the base matches, and strings that pass as random.

    A candidate is a run of 20 or more characters of base64's alphabet and its padding, of an encoding that can be
    inferred (not digits alone, which number things), outside every base match; after NAME= the value is one by itself. It is a secret
    if the test battery doesn't reject randomness, and if it is further from ordinary names of its encoding and length (``null_model``) than
    ``limits`` asks, which hold the share of such names among the secrets of a stratum of lengths to ``rate``. So which candidates pass depends,
    as false-discovery control has it, on how many others there are in ``docs``.

    Texts are scanned once, and what was found is settled with the columns that stay; the driver gets a histogram (at most strata x 800
    rows). Null and empty texts have no spans; repeated rows are scanned each; an empty table gives an empty result.
    """
    null = null_model(docs.sparkSession)
    plain, names = numbered(docs)
    text = text_or_empty(names[text_col])
    kept = [names[c] for c in (docs.columns if keep is None else keep)]
    both = F.struct(_base(text).alias("base"), _located(text, CANDIDATE).alias("found"))
    told = let(both, lambda x: F.struct(x["base"].alias("base"), _candidates(_outside(x["base"], x["found"]), null).alias("drawn")))
    found = settle(plain.select(*kept, told.alias("told")), "secrets")
    seen: dict[int, dict[int, int]] = defaultdict(dict)
    for r in found.select(F.explode("told.drawn").alias("c")).groupBy("c.stratum", "c.b").count().collect():
        seen[r.stratum][r.b] = r["count"]
    limit = F.array(*(F.lit(x) for x in limits(seen, rate)))
    random = F.transform(F.filter("told.drawn", lambda x: x["b"] <= F.element_at(limit, x["stratum"] + 1)), lambda x: F.struct(x["s"].alias("s"), F.lit(len(PATTERNS)).alias("k"), x["e"].alias("e")))
    return renamed(found, {c: x for c, x in names.items() if x in kept}, {"secret_spans": F.array_sort(F.concat("told.base", random))})


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rate: float = 0.05) -> DataFrame:
    """``docs`` with each secret, or run of overlapping secrets, replaced by ``mark``; null texts stay null.

    A span is overlapped by those before it up to their furthest end. What is left is cut from the text in a code of
    equal widths, so the time is linear in the text and the spans.
    """
    plain, names = numbered(docs)  # so that a column of the documents may be named as ours is
    found = find_secrets(plain, names[text_col], rate)
    text = F.col(names[text_col])

    def cut(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b), F.lit(0))
        # from the furthest end before a span up to its start; the last piece has no end
        starts = F.concat(F.array(F.lit(0)), ends)
        stops = F.concat(F.transform(spans, lambda x: x["s"]), F.array(F.lit(None).cast("int")))
        pieces = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.filter(pieces, lambda x: x["b"].isNull() | (x["b"] >= x["a"]))

    def joined(x: Column) -> Column:
        def piece(p: Column) -> Column:
            return F.decode(F.substring(x["code"], 4 * p["a"] + 1, F.coalesce(4 * (p["b"] - p["a"]), F.octet_length(x["code"]))), "UTF-32")

        return F.array_join(F.transform(x["pieces"], piece), mark)

    done = let(F.struct(F.encode(text, "UTF-32").alias("code"), cut(F.col("secret_spans")).alias("pieces")), joined)
    return found.withColumn(names[text_col], F.when(F.size("secret_spans") > 0, done).otherwise(text)).drop("secret_spans").toDF(*docs.columns)
