"""Where a described formula stands on a page: words to segments, segments to lines, lines to clusters, clusters to a box.

words: item, line, x0, y0, x1, y1, text. described: item, description, and box (struct x0, y0, x1, y1) of what is known so far. All steps are windows and
groups over items and lines; an item's few clusters are then covered greedily, by a fold that streams through the items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.columns import let
from quillspark.functions.text import collapse
from quillspark.operators.folds import each_document
from quillspark.session import cut, tasks_for

#: What number words stand for, words that say nothing about a formula's signs, words that end a formula, words of prose, and functions.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13",
    "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20", "half": "2", "halves": "2", "third": "3", "thirds": "3", "quarter": "4",
    "quarters": "4", "fourth": "4", "fourths": "4",
}
SAYING = (
    "open", "close", "parenthesis", "fraction", "over", "equals", "equal", "times", "plus", "minus", "sub", "subscript", "bar", "and", "bracket", "ellipsis", "divided", "by", "where", "showing",
    "cross", "cancellation", "the", "is", "replaced", "with", "to", "of", "or", "raised", "power", "formula", "definition", "definitions", "form", "negative",
)
BREAKS = (
    "and", "or", "but", "given", "where", "then", "therefore", "because", "determine", "solution", "equation", "formula", "definition", "definitions", "chapter", "section", "contents", "form",
    "point",
)
PROSE = (
    "and", "as", "by", "for", "from", "if", "in", "is", "of", "on", "or", "the", "then", "to", "with", "form", "formula", "definition", "definitions",
)
FUNCTIONS = (
    "sin", "cos", "tan", "sec", "csc", "cot", "log", "ln", "exp", "lim", "gcd", "lcm", "max", "min",
)
SIGNS = r"[=+*/⁄_(){}\[\]|∣·×÷−-]"
PLAIN_SIGNS = r"[=+\-*/_(){}\[\]|:]"
#: Up to so many different texts of words, some 300 bytes each, go to all tasks; more are shuffled.
BROADCAST_TEXTS = 50_000
#: Limits: gaps between lines of a cluster and between clusters, their overlap, and how far a box may grow.
LINE_GAP, CLUSTER_GAP, CLUSTER_OVERLAP, GROWTH, GROWTH_COVERED = 0.75, 6.5, 0.12, 1.12, 1.75
#: Of a search over the whole page: a cluster's gap and overlap, and how far across and down a word may be away.
SEARCH_CLUSTERS, SEARCH_GAP = (4.0, 0.2), (18.0, 6.0)


def extracted(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words_of(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def description_tokens(s: Column) -> Column:
    """Words and numbers of a description, with the digits of number words and subscripted letters, without what only names signs."""

    def tokens(text: Column) -> Column:
        found = extracted(text, r"[0-9]+(?:\.[0-9]+)?|[a-z]+")
        spoken = F.create_map(*[F.lit(x) for word, n in NUMBER_WORDS.items() for x in (word, n)])
        digits = F.filter(F.transform(found, lambda t: F.try_element_at(spoken, t)), lambda t: t.isNotNull())
        subscripts = F.transform(extracted(text, r"\b[a-z]\s+sub(?:script)?\s+[0-9]+(?:\.[0-9]+)?\b"), lambda x: F.concat(F.left(x, F.lit(1)), F.regexp_extract(x, r"[0-9.]+$", 0)))
        return F.array_sort(F.array_except(F.concat(found, digits, subscripts), words_of(SAYING)))

    return let(F.lower(collapse(s)), tokens)


def visual_tokens(s: Column) -> Column:
    """Tokens of what stands on the page: words, numbers, the parts of a letter with a number, and names of wrappers and roots."""

    def tokens(text: Column) -> Column:
        found = extracted(text, r"[0-9]+(?:\.[0-9]+)?|[a-z]+[0-9]*")
        mixed = F.filter(found, lambda t: t.rlike("^[a-z]+[0-9]+$"))
        named = {"brace": text.rlike(r"[{}]|brace"), "bracket": text.rlike(r"[\[\]]|bracket"), "parenthesis": text.rlike(r"[()]|paren"), "root": text.rlike("√|sqrt|root"), "square": text.rlike("√|sqrt") | (text.contains("root") & text.contains("square"))}
        parts = [F.transform(mixed, lambda t: F.regexp_extract(t, "^[a-z]+", 0)), F.transform(mixed, lambda t: F.regexp_extract(t, "[0-9]+$", 0))]
        return F.array_distinct(F.concat(found, *parts, F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in named.items()]))))

    return let(F.lower(collapse(s)), tokens)


def may_run_together(s: Column) -> Column:
    return F.filter(extracted(F.lower(collapse(s)), "[a-z]{2,4}"), lambda r: ~r.isin(*BREAKS, *PROSE))


def met_together(runs: Column, wanted: Column) -> Column:
    met = F.transform(runs, lambda r: F.array_intersect(r, wanted))
    return F.array_distinct(F.flatten(F.filter(met, lambda m: F.size(m) >= 2)))


def run_together(s: Column, wanted: Column) -> Column:
    """Letters of runs of two to four, if at least two of a run are wanted: xy for x times y."""
    return met_together(F.transform(may_run_together(s), lambda r: F.split(r, "")), wanted)


def overlap_tokens(s: Column, wanted: Column) -> Column:
    return F.array_union(F.array_intersect(visual_tokens(s), wanted), run_together(s, wanted))


def is_strong(token: Column) -> Column:
    """Decimals, letters with a number, numbers of two digits or more."""
    return token.rlike(r"[0-9]+\.[0-9]+|^[a-z]+[0-9]+$|^[0-9]{2,}$")


def is_math_word(s: Column) -> Column:
    text = collapse(s)
    shape = text.rlike(SIGNS) | (text.rlike("[0-9]") & (F.length(text) <= 12)) | text.rlike(r"^[A-Za-z]{1,3}[0-9]*$")
    return (text != "") & ~F.lower(text).isin(*PROSE) & shape


def is_long_word(s: Column) -> Column:
    letters = F.regexp_replace(F.coalesce(s, F.lit("")), "[^A-Za-z]", "")
    return (F.length(letters) >= 3) & ~letters.rlike("^[Pp]")


def judged_texts(texts: DataFrame) -> DataFrame:
    """What a word says by itself, whatever is looked for: texts (text) with tokens, runs (letters of those that may run together), plain_signs and signs, and what it is where no token asks for it."""
    low = F.lower(collapse("text"))
    letters = F.regexp_replace(low, "[^a-z]", "")
    short = F.length(letters).between(1, 3) & ~letters.isin(*FUNCTIONS)
    rows = texts.withColumns({"tokens": visual_tokens(F.col("text")), "runs": F.transform(may_run_together(F.col("text")), lambda r: F.split(r, "")), "math": is_math_word(F.col("text")), "as_long": is_long_word(F.col("text"))})
    return rows.withColumns({
        "as_break": F.coalesce(F.arrays_overlap(extracted(low, "[a-z]+"), words_of(BREAKS)), F.lit(False)), "as_weak": (low != "") & ~low.rlike(r"^[=+\-*/_(){}\[\]|:.]+$") & (short | F.col("as_long")),
        "plain_signs": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(PLAIN_SIGNS)), "signs": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SIGNS)), "root": low.contains("root"), "square": low.contains("square"),
    })


def judged_words(words: DataFrame, described: DataFrame) -> DataFrame:
    """words with met (the item's tokens that a word has), formulaish, breaks, weak (not fit for a segment's edge), n (its place in the line), and what its text says. Each text is looked at once, however many words
    say it; items are dealt to tasks of about the same number of words, however many there are."""
    known = cut(judged_texts(words.select("text").distinct()))
    wanted = described.select("item", description_tokens(F.col("description")).alias("wanted"))
    tasks, told = tasks_for(words), lambda rows, texts: rows.join(texts.withColumnRenamed("text", "__text"), F.col("text").eqNullSafe(F.col("__text"))).drop("__text")
    small = known.count() <= BROADCAST_TEXTS
    rows = told(words.repartition(tasks, "item"), F.broadcast(known)) if small else told(words, known).repartition(tasks, "item")
    rows = rows.join(wanted, "item").withColumn("met", F.array_union(F.array_intersect("tokens", "wanted"), F.when(F.size("runs") > 0, met_together(F.col("runs"), F.col("wanted"))).otherwise(F.array().cast("array<string>"))))
    bare = F.size("met") == 0
    rows = rows.withColumns({"breaks": bare & F.col("as_break"), "formulaish": F.col("math") | ~bare, "weak": bare & F.col("as_weak"), "long": bare & F.col("as_long")})
    rows = rows.withColumn("square", F.col("square") & F.array_contains("wanted", "square")).drop("tokens", "runs", "wanted", "as_break", "as_weak", "as_long")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("item", "line").orderBy("x0", "y0", "text")))


def joined(parts: Column) -> dict[str, Column]:
    """What words or segments (an array of structs) have together: tokens met, counts and box. A root in one and a square in another are a square root."""
    each = lambda c: F.transform(parts, lambda x: x[c])
    any_of = lambda c: F.exists(parts, lambda x: x[c])
    total = lambda c: F.aggregate(each(c), F.lit(0).cast("long"), lambda a, x: a + x)
    both = F.when(any_of("root") & any_of("square"), F.array(F.lit("square"))).otherwise(F.array().cast("array<string>"))
    found = {"met": F.array_union(F.flatten(each("met")), both), "root": any_of("root"), "square": any_of("square")}
    return found | {c: total(c) for c in ("words", "math_words", "long_words", "plain_signs", "signs")} | {"x0": F.array_min(each("x0")), "y0": F.array_min(each("y0")), "x1": F.array_max(each("x1")), "y1": F.array_max(each("y1"))}


def line_parts(judged: DataFrame) -> DataFrame:
    """item, line, segment, and its words (array of structs, in order): runs of formula words that no other word breaks, less the weak words at the edges of those that have a wanted token. At least one word of a run
    stays. Under the segment -1 all words of a line that are in no run."""
    rows = judged.withColumn("inside", F.col("formulaish") & ~F.col("breaks"))
    line = Window.partitionBy("item", "line").orderBy("x0", "y0", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("segment", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(line))
    rows = rows.withColumn("segment", F.when(F.col("inside"), F.col("segment")).otherwise(-1).cast("long"))
    count = lambda c: F.col(c).cast("long").alias(c)
    word = F.struct("n", "text", "met", "weak", F.lit(1).cast("long").alias("words"), F.col("math").cast("long").alias("math_words"), F.col("long").cast("long").alias("long_words"), count("plain_signs"), count("signs"), "root", "square", "x0", "y0", "x1", "y1")
    grouped = rows.groupBy("item", "line", "segment").agg(F.array_sort(F.collect_list(word)).alias("parts"))

    def trimmed(run: Column) -> Column:
        firm = F.transform(F.filter(run, lambda w: ~w["weak"]), lambda w: w["n"])
        within = F.when(F.size(firm) == 0, F.slice(run, -1, 1)).otherwise(F.filter(run, lambda w: w["n"].between(F.array_min(firm), F.array_max(firm))))
        return F.when((F.col("segment") < 0) | ~F.exists(run, lambda w: F.size(w["met"]) > 0), run).otherwise(within)

    return grouped.withColumn("parts", trimmed(F.col("parts")))


def scored(parts: DataFrame) -> DataFrame:
    found = parts.withColumns(joined(F.col("parts")))
    found = found.withColumns({"overlap": F.size("met"), "strong": F.size(F.filter("met", is_strong))})
    return found.withColumn("score", F.col("overlap") * 6.0 + F.col("strong") * 4.0 + F.col("plain_signs") * 1.5 + F.col("math_words") - F.col("long_words") * 4.0)


def segment_stats(judged: DataFrame) -> DataFrame:
    """item, line, segment, first, words, text, met, overlap, strong, signs, math_words, long_words, box and score."""
    rows = scored(line_parts(judged).where("segment >= 0")).withColumns({"signs": F.col("plain_signs"), "first": F.get("parts", F.lit(0))["n"], "text": F.array_join(F.transform("parts", lambda w: w["text"]), " ")})
    return rows.drop("parts", "plain_signs", "root", "square")


def line_candidates(judged: DataFrame) -> DataFrame:
    """The lines that may hold the formula, with their stats and score, of the words that may be the formula's: those of the best segment where it is clearly best, else of all segments, else all words.
    Lines of prose without a wanted token are none."""
    stats = ("met", "root", "square", "words", "math_words", "long_words", "plain_signs", "signs", "x0", "y0", "x1", "y1")
    ranked = F.struct((-F.col("score")).alias("less"), (-F.col("strong")).alias("fewer"), (-F.col("overlap")).alias("least"), "segment", *stats)
    segments = F.col("segments")
    lines = scored(line_parts(judged)).groupBy("item", "line").agg(F.array_sort(F.collect_list(F.when(F.col("segment") >= 0, ranked))).alias("segments"), F.collect_list(F.when(F.col("segment") < 0, ranked)).alias("rest"))
    first, second = F.get(segments, F.lit(0)), F.get(segments, F.lit(1))
    clear = (first["least"] < 0) & (second.isNull() | (first["fewer"] < second["fewer"]) | (first["less"] <= second["less"] - 3) | (first["least"] <= second["least"] - 2))
    rows = lines.withColumn("parts", F.when(F.size(segments) == 0, F.col("rest")).when(clear, F.slice(segments, 1, 1)).otherwise(segments)).drop("segments", "rest")
    rows = rows.withColumns(joined(F.col("parts"))).drop("parts")
    rows = rows.withColumns({"overlap": F.size("met"), "strong": F.size(F.filter("met", is_strong))})
    rows = rows.withColumn("score", F.col("math_words") * 2.0 + F.col("signs") + F.col("overlap") * 3.0 - F.col("long_words") * 2.5)
    long, strong, signs, maths = F.col("long_words"), F.col("strong"), F.col("signs"), F.col("math_words")
    prose = ((long >= 3) & (strong == 0) & (signs < 3)) | ((long >= 2) & (maths <= 2) & (strong == 0) & (signs < 2)) | ((long >= 3) & (F.col("overlap") == 0) & (signs < 2))
    faint = (F.col("score") < 1.5) & (maths / F.col("words") < 0.45) & (F.col("overlap") == 0)
    return rows.where(~prose & ~faint)


def clusters(candidates: DataFrame) -> DataFrame:
    """Lines that follow each other within LINE_GAP, from the top down, with their stats summed up and the tokens they meet together."""
    above = Window.partitionBy("item").orderBy("y0", "x0", "line").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("item").orderBy("y0", "x0", "line")
    opens = F.coalesce(F.col("y0") - F.max("y1").over(above) > LINE_GAP, F.lit(False))
    rows = candidates.withColumn("opens", opens.cast("int")).withColumn("cluster", F.sum("opens").over(down))
    total = lambda c: F.sum(c).alias(c)
    grouped = rows.groupBy("item", "cluster").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("met")))).alias("met"), *map(total, ("signs", "math_words", "long_words", "score")),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    return grouped.withColumns({"overlap": F.size("met"), "strong": F.size(F.filter("met", is_strong))})


def may_join(cluster: dict, chosen: list[dict], covered: set[str], wanted_strong: set[str], strong: set[str], most_gap: float, least_overlap: float) -> bool:
    """A cluster is taken in if it brings a new token (a strong one, once all strong ones are there) and stands near a chosen one, above or below."""
    fresh = set(cluster["met"]) - covered
    if not fresh or (wanted_strong and wanted_strong <= covered and not fresh & strong):
        return False

    def near(other: dict) -> bool:
        gap = max(0.0, cluster["y0"] - other["y1"], other["y0"] - cluster["y1"])
        width = max(0.01, min(cluster["x1"] - cluster["x0"], other["x1"] - other["x0"]))
        return gap <= most_gap and max(0.0, min(cluster["x1"], other["x1"]) - max(cluster["x0"], other["x0"])) / width >= least_overlap

    return any(map(near, chosen))


def covering(found: DataFrame, described: DataFrame, most_gap: float = CLUSTER_GAP, least_overlap: float = CLUSTER_OVERLAP) -> DataFrame:
    """item, chosen (clusters that make up the formula) and the box around them. The best cluster comes first; others join while they may."""
    rows = found.join(described.select("item", description_tokens(F.col("description")).alias("wanted")), "item")
    rows = rows.withColumns({"strong_met": F.filter("met", is_strong), "strong_wanted": F.filter("wanted", is_strong)})
    rows = rows.select("item", "cluster", "met", "strong_met", "strong_wanted", "strong", "overlap", "signs", (F.col("math_words") - 2 * F.col("long_words")).alias("plain"), "score", "x0", "y0", "x1", "y1")

    def cover(item: object, mine: list) -> Iterator[tuple]:
        ranked = sorted((r._asdict() for r in mine), key=lambda r: (*(-r[c] for c in ("strong", "overlap", "signs", "plain", "score")), r["cluster"]))
        wanted = {x for r in ranked for x in r["strong_wanted"]}
        strong = {x for r in ranked for x in r["strong_met"]}
        chosen, rest, covered = ranked[:1], ranked[1:], set(ranked[0]["met"])
        grown = True
        while grown:
            grown = False
            for r in list(rest):
                if may_join(r, chosen, covered, wanted, strong, most_gap, least_overlap):
                    chosen.append(r)
                    rest.remove(r)
                    covered |= set(r["met"])
                    grown = True
        box = [f(r[c] for r in chosen) for f, c in ((min, "x0"), (min, "y0"), (max, "x1"), (max, "y1"))]
        yield ",".join(str(r["cluster"]) for r in sorted(chosen, key=lambda r: r["cluster"])), len(covered), *box

    told = each_document(rows, "item", ["cluster"], cover, "item long, chosen string, covered long, x0 double, y0 double, x1 double, y1 double")
    return told.withColumn("chosen", F.split("chosen", ",").cast("array<bigint>"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def refined(words: DataFrame, described: DataFrame) -> DataFrame:
    """described with its box drawn in to the formula's clusters; it stays as it was where there is none, or where the new one is too much larger."""
    found = cut(covering(clusters(line_candidates(judged_words(words, described))), described))
    new = F.struct("f.x0", "f.y0", "f.x1", "f.y1")
    grown = area(new) / area(F.col("d.box"))
    fits = (area(F.col("d.box")) <= 0) | (grown <= GROWTH) | ((F.col("f.covered") > 0) & (grown <= GROWTH_COVERED))
    out = described.alias("d").join(found.alias("f"), F.col("d.item") == F.col("f.item"), "left")
    return out.select("d.item", "d.description", F.when(F.col("f.item").isNotNull() & fits, new).otherwise(F.col("d.box")).alias("box"), F.col("f.chosen").alias("chosen"))


def search_words(judged: DataFrame) -> DataFrame:
    """The words of judged_words() from which a formula may be put together: without breaks, prose and short words that no token asks for; with signs and anchor (a sign, a digit, two letters)."""
    low = F.lower(collapse("text"))
    letters = F.regexp_replace(low, "[^a-z]", "")
    digit = low.rlike(r"\p{Nd}")
    other = low.isin(*PROSE, *BREAKS) | is_long_word(F.col("text")) | (F.length(letters).between(1, 3) & ~letters.isin(*FUNCTIONS) & ~digit)
    signs = F.col("plain_signs")
    rows = judged.where(F.col("formulaish") & (low != "") & ((F.size("met") > 0) | ~other))
    return rows.select("item", "line", "n", "met", signs.alias("signs"), ((signs > 0) | digit | (F.length(letters) >= 2)).alias("anchor"), F.filter("met", is_strong).alias("strong_met"), "x0", "y0", "x1", "y1")


def grown_from_words(found: DataFrame) -> DataFrame:
    """item, words and box of the best cluster of search_words(): from each word that has a token (from all, if none has), whatever is within SEARCH_GAP of the growing box joins. A box that grows never lets go of
    what it reached, so all in reach join at once, round by round. Best: most anchors, signs, tokens, strong ones, then the least area a word; the first word's on a tie."""

    def grow(_: object, mine: list) -> Iterator[tuple]:
        sides = np.array([[r.x0, r.y0, r.x1, r.y1] for r in mine])
        best = None
        for seed in [k for k, r in enumerate(mine) if r.met] or range(len(mine)):
            inside = np.zeros(len(mine), dtype=bool)
            inside[seed] = True
            while True:
                box = [*sides[inside, :2].min(axis=0), *sides[inside, 2:].max(axis=0)]
                across = np.maximum(0.0, np.maximum(sides[:, 0] - box[2], box[0] - sides[:, 2]))
                down = np.maximum(0.0, np.maximum(sides[:, 1] - box[3], box[1] - sides[:, 3]))
                more = inside | ((across <= SEARCH_GAP[0]) & (down <= SEARCH_GAP[1]))
                if (more == inside).all():
                    break
                inside = more
            words = [r for r, x in zip(mine, inside, strict=True) if x]
            area = max(0.0, box[2] - box[0]) * max(0.0, box[3] - box[1])
            score = sum(r.anchor for r in words), sum(r.signs for r in words), len({t for r in words for t in r.met}), len({t for r in words for t in r.strong_met}), -area / len(words)
            if best is None or score > best[0]:
                best = score, len(words), *map(float, box)
        yield best[1:]

    return each_document(found, "item", ["line", "n"], grow, "item long, words long, x0 double, y0 double, x1 double, y1 double")


def located(words: DataFrame, described: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """item, way and box of formulas of which nothing but the description is known: where the page's clusters cover it (closer together than in refined()), else where words grow together to it; null where
    the page has nothing. A box without width or height is none. judged: the judged_words(), where they are known."""
    judged = cut(judged_words(words, described)) if judged is None else judged
    valid = lambda df: df.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    covered = cut(valid(covering(clusters(line_candidates(judged)), described, *SEARCH_CLUSTERS)).select("item", F.lit("clusters").alias("way"), "x0", "y0", "x1", "y1"))
    left = judged.join(covered.select("item"), "item", "left_anti")
    grown = valid(grown_from_words(search_words(left))).select("item", F.lit("words").alias("way"), "x0", "y0", "x1", "y1")
    both = covered.unionByName(grown).select("item", "way", F.struct("x0", "y0", "x1", "y1").alias("box"))
    return described.select("item").join(both, "item", "left")


def box_signals(judged: DataFrame, boxes: DataFrame, *names: str) -> DataFrame:
    """item, and for each box named (a struct or null) the overlap, strong, signs and math_words of the words in it (with a little room), under the box's name. judged: judged_words(); all boxes are looked at in one go."""
    rows = judged.select("item", "met", "signs", "math", "root", "square", "x0", "y0", "x1", "y1").join(boxes.select("item", *names), "item")
    inside = lambda b: F.coalesce((F.col("x1") >= b["x0"] - 1.5) & (F.col("x0") <= b["x1"] + 1.5) & (F.col("y1") >= b["y0"] - 1.0) & (F.col("y0") <= b["y1"] + 1.0), F.lit(False))
    told = {}
    for name in names:
        here = inside(F.col(name))
        told[f"{name}_met"] = F.collect_list(F.when(here & (F.size("met") > 0), F.col("met")))
        told |= {f"{name}_signs": F.sum(F.when(here, F.col("signs"))), f"{name}_math": F.count_if(here & F.col("math")), f"{name}_root": F.max(here & F.col("root")) & F.max(here & F.col("square"))}
    found = rows.groupBy("item").agg(*[c.alias(name) for name, c in told.items()])

    def signals(name: str) -> Column:
        met = F.array_union(F.flatten(f"{name}_met"), F.when(F.col(f"{name}_root"), F.array(F.lit("square"))).otherwise(F.array().cast("array<string>")))
        return F.struct(met.alias("met"), F.coalesce(f"{name}_signs", F.lit(0)).cast("long").alias("signs"), F.col(f"{name}_math").cast("long").alias("math_words"))

    found = found.select("item", *[signals(name).alias(name) for name in names])
    values = lambda b: F.struct(F.size(b["met"]).cast("long").alias("overlap"), F.size(F.filter(b["met"], is_strong)).cast("long").alias("strong"), b["signs"].alias("signs"), b["math_words"].alias("math_words"))
    return found.select("item", *[values(F.col(name)).alias(name) for name in names])


def better_places(words: DataFrame, described: DataFrame, searched: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """described with its box replaced by the one that was searched for (item, box) where that says no less and is smaller: no fewer strong tokens or tokens, about as many signs, mostly within the old box or close to it,
    and at most 0.92 of its area. A missing box is always replaced. judged: the judged_words(), where they are known."""
    both = described.select("item", "description", "box").alias("d").join(searched.select("item", F.col("box").alias("found")).alias("s"), "item", "left")
    rows = both.join(box_signals(judged_words(words, described) if judged is None else judged, both, "box", "found").alias("a"), "item", "left")
    d, s, A, B = F.col("d.box"), F.col("s.found"), (lambda c: F.coalesce(F.col("a.box")[c], F.lit(0))), (lambda c: F.coalesce(F.col("a.found")[c], F.lit(0)))
    shared = F.greatest(F.lit(0.0), F.least(d["x1"], s["x1"]) - F.greatest(d["x0"], s["x0"])) * F.greatest(F.lit(0.0), F.least(d["y1"], s["y1"]) - F.greatest(d["y0"], s["y0"]))
    away = (F.greatest(F.lit(0.0), d["x0"] - s["x1"], s["x0"] - d["x1"]) > 12) | (F.greatest(F.lit(0.0), d["y0"] - s["y1"], s["y0"] - d["y1"]) > 8)
    says = (B("strong") >= A("strong")) & (B("overlap") >= A("overlap")) & ~((B("signs") + 1 < A("signs")) & (B("overlap") <= A("overlap")))
    fits = (area(s) > 0) & (area(d) > 0) & says & ~((shared / area(s) < 0.5) & away) & (area(s) <= area(d) * 0.92)
    take = s.isNotNull() & (d.isNull() | (area(d) <= 0) | F.coalesce(fits, F.lit(False)))
    return rows.select("item", "d.description", F.when(take, s).otherwise(d).alias("box"), take.alias("replaced"))


def drawn_in_to_wrappers(words: DataFrame, described: DataFrame) -> DataFrame:
    """described with its box drawn in to what stands between the first opening and the last closing sign of a kind that the description names,
    braces before parentheses before brackets, unless that is larger."""
    low = F.lower(collapse("description"))
    named = F.array_compact(F.array(F.when(low.contains("brace"), F.lit("{}")), F.when(low.contains("paren"), F.lit("()")), F.when(low.contains("bracket"), F.lit("[]"))))
    wanted = described.select("item", "box", F.posexplode(named).alias("rank", "pair"))
    placed = words.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy("y0", "x0", "x1", "text")))
    rows = wanted.join(placed, "item").withColumns({"o": F.col("text").contains(F.left("pair", F.lit(1))), "c": F.col("text").contains(F.right("pair", F.lit(1)))})
    ends = rows.groupBy("item", "rank").agg(F.min(F.when(F.col("o"), F.col("n"))).alias("start"), F.max(F.when(F.col("c"), F.col("n"))).alias("stop"))
    inside = rows.join(ends, ["item", "rank"]).where(F.col("n").between(F.col("start"), F.col("stop")))
    span = inside.groupBy("item", "rank").agg(F.first("box").alias("old"), F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).alias("span"))
    best = span.where(area(F.col("span")) <= area(F.col("old")) * 1.02).groupBy("item").agg(F.min_by("span", "rank").alias("span"))
    return described.join(best, "item", "left").select("item", "description", F.coalesce("span", "box").alias("box"))


def padded(box: Column, description: Column) -> Column:
    """The box with room for fine signs: more for scripts, roots and fractions, and at the sides for wrappers; never beyond the page (0 to 1000)."""
    low = F.lower(collapse(description))
    raised = low.rlike("superscript|subscript|squared|cubed|root|fraction|over|power")
    side = F.greatest(F.when(raised, 1.35).otherwise(1.1), F.when(low.rlike(r"\b(?:open|close|left|right)\s+(?:parenthesis|paren|bracket|brace)\b"), 1.5).otherwise(0.0))
    top, bottom = F.when(raised, 2.3).otherwise(1.8), F.when(raised, 1.35).otherwise(1.1)
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), c))
    return F.struct(inside(box["x0"] - side).alias("x0"), inside(box["y0"] - top).alias("y0"), inside(box["x1"] + side).alias("x1"), inside(box["y1"] + bottom).alias("y1"))
