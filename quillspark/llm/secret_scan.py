"""Secrets in text, found row by row with SQL functions only: no shuffle, no Python in the tasks.

Base kinds are patterns. The method adds strings that look random: candidates are runs of a character class; a window slides over each,
the counts of its characters are kept up by adding the entering and removing the leaving one, and so is the sum of
c log2 c, from which the window's Shannon entropy follows. A candidate whose best window reaches its class's threshold is a span,
unless the allow-list matches all of it or a base span or a candidate of an earlier class overlaps it. Where the allow-list matches a part
of it, windows that touch that part don't count, but the others do.

A text is searched for assignments and for long runs of the widest class; every other kind lies within such a run and is looked for there.
Patterns take what they repeat possessively, offsets are running sums and overlaps are found by halving, so that a text of
a megabyte, or of ten thousands of matches, costs no recursion and no square of its matches.

Defined results: a null or empty text has no spans. Offsets count code points; the end is exclusive. Repeated rows give repeated
results. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import count_below, let, running

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Character classes from narrow to wide: the run that is a candidate, and the bits a character that a window must reach.
CLASSES = {"hex": (r"[0-9A-Fa-f]{20,}+", 2.9), "alphanumeric": (r"[A-Za-z0-9]{20,}+", 3.55), "base64": (r"[A-Za-z0-9+/_-]{20,}+={0,2}+", 3.65)}
WIDEST = "base64"
#: What a candidate may match in full without being a secret, and what a window may not touch to count.
ALLOW_FULL = (r"[A-Za-z]++", r"[0-9]++", r"[A-Za-z]++(?:[-_/][A-Za-z]++)*+", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", r"[a-z]++(?:[-_/][a-z0-9]++)*+")
ALLOW_PART = (r"(?i)example|sample|dummy|placeholder|changeme", r"(.)\1{5}", r"(?i)abcdefgh|01234567")

KEYWORD = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
ASSIGN = rf"{KEYWORD}[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
#: Kinds that lie within a run of the widest class, as they are that long.
INSIDE = {"access": r"AKIA[A-Z0-9]{16,}+", "hex": r"[0-9a-f]{24,}+"}
LOW = 43  # '+', the least character of any class
SLOTS = 123 - LOW
#: Counts of a window's characters are packed into longs, so many of BITS bits each.
BITS, PACKED = 5, 12
FOUND = "array<struct<start:int,string:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, string>> of the leftmost non-overlapping matches.

    What lies between them and what they are, in turn, make up the text, so running sums of lengths give offsets."""

    def placed(x: Column) -> Column:
        sizes = F.transform(x["between"], lambda b, i: F.char_length(b) + F.coalesce(F.char_length(F.get(x["found"], i)), F.lit(0)))
        return let(running(sizes), lambda ends: F.transform(x["found"], lambda m, i: F.struct((F.get(ends, i) - F.char_length(m)).alias("start"), m.alias("string"))))

    both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(F.array()).cast(FOUND)


def within(runs: Column, pattern: str) -> Column:
    """The matches inside runs, placed in the text."""
    return F.flatten(F.transform(runs, lambda r: F.transform(matches(r["string"], pattern), lambda m: F.struct((r["start"] + m["start"]).alias("start"), m["string"].alias("string"))))).cast(FOUND)


def best_entropy(string: Column) -> Column:
    """The largest Shannon entropy, in bits a character, of any WINDOW characters in a row."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    word = lambda code: F.floor(code / PACKED).cast("int")
    shift = lambda code: code % PACKED * BITS

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, word(code)), shift(code)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def slide(codes: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            came, went, leaves = x["came"], x["went"], x["went"] >= 0
            one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), shift(code))
            have = count(acc["counts"], came)
            held = count(acc["counts"], went) + F.when(came == went, 1).otherwise(0)
            total = acc["total"] + F.get(table, have + 1) - F.get(table, have) + F.when(leaves, F.get(table, held - 1) - F.get(table, held)).otherwise(0.0)
            moved = lambda v, j: v + F.when(word(came) == j, one(came)).otherwise(0) - F.when(leaves & (word(went) == j), one(went)).otherwise(0)
            return F.struct(F.transform(acc["counts"], moved).alias("counts"), total.alias("total"), F.when(x["full"], F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

        steps = F.transform(codes, lambda c, i: F.struct(c.alias("came"), F.coalesce(F.get(codes, i - WINDOW), F.lit(-1)).alias("went"), (i >= WINDOW - 1).alias("full")))
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-SLOTS // PACKED)).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("least"))
        return F.aggregate(steps, start, step, lambda acc: F.lit(math.log2(WINDOW)) - acc["least"] / WINDOW)

    return let(F.transform(F.split(string, ""), lambda c: F.ascii(c) - LOW), slide)


def reach(spans: Column) -> Column:
    """struct<starts, ends> of spans sorted by start: where each begins, and how far those up to it reach."""
    return F.struct(F.transform(spans, lambda s: s["start"]).alias("starts"), running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("ends"))


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others; both are sorted by start."""
    free = lambda known: lambda x: ~F.coalesce(F.get(known["ends"], count_below(known["starts"], x["end"]) - 1) > x["start"], F.lit(False))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(reach(others), lambda known: F.filter(spans, free(known))))


def clear_of_column(other: str) -> Callable[[Column], Column]:
    return lambda spans: clear_of(spans, F.col(other))


def random_enough(bits: float) -> Callable[[Column], Column]:
    """Does a window between the allow-listed parts (leftmost, not overlapping) reach so many bits?"""
    parts = "|".join(f"(?:{p})" for p in ALLOW_PART)  # one has a group, which \1 refers to
    return lambda x: F.exists(F.split(x["string"], parts, -1), lambda piece: (F.char_length(piece) >= WINDOW) & (best_entropy(piece) >= bits))


def spanned(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (x["start"] + F.char_length(x["string"])).cast("int").alias("end"), x["string"].alias("string"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and added: array<struct<start, rank, end, string>>, sorted by start and kind; rank is the kind's place in KINDS."""
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    found = rows.select("__id", matches(F.col("__text"), ASSIGN).alias("assign"), matches(F.col("__text"), CLASSES[WIDEST][0]).alias("runs"))
    long_enough = F.filter("assign", lambda x: F.char_length(F.regexp_extract(x["string"], ASSIGN, 1)) >= 6)
    base = [F.transform(long_enough, spanned("assign")), *[F.transform(within(F.col("runs"), p), spanned(kind)) for kind, p in INSIDE.items()]]
    found = found.select("__id", "runs", F.array_sort(F.concat(*base)).alias("base"))

    def allowed(x: Column) -> Column:
        return x["string"].rlike("^(?:" + "|".join(f"(?:{p})$" for p in ALLOW_FULL) + ")")

    none = F.array().cast("array<struct<start:int,rank:int,end:int,string:string>>")
    narrower: list[str] = ["base"]
    for name, (pattern, bits) in CLASSES.items():
        runs = F.col("runs") if name == WIDEST else within(F.col("runs"), pattern)
        spans = F.transform(F.filter(runs, lambda x: ~allowed(x)), spanned("entropy"))
        for other in narrower:
            spans = let(spans, clear_of_column(other))
        found = found.withColumn(f"__{name}", F.when(F.size("runs") > 0, F.filter(spans, random_enough(bits))).otherwise(none))
        narrower.append(f"__{name}")
    return found.select(F.col("__id").alias(id_col), "base", F.array_sort(F.concat(*narrower[1:])).alias("added"))


def rendered(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["rank"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
