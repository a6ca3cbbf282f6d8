"""Strict transcription of equations: what a text read off a page holds of an equation, with its signs repaired and spaced, or nothing. Columns only; every step works on the one before, bound once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import equations
from quillspark.functions.columns import let
from quillspark.functions.responses import unwrapped
from quillspark.functions.text import Text, collapse

#: Signs as they stand where UTF-8 was read as Windows-1252, and what they are.
MISREAD = {
    "â‰¤": "≤", "â‰¥": "≥", "Ã—": "×", "Â·": "·", "Ã·": "÷",
    "âˆ’": "-", "â€“": "-", "â€”": "-",
}
#: References to pages, and words from which on a text is no equation.
PAGE_NOTES = (r"\(page\s+[0-9]+\)", r"\bpage\s+[0-9]+\b")
ENDING_WORDS = (r"answers?\b", r"chapter\b", r"spss\b", r"cont\.?\b", r"(?:document|image)\b")
#: Arrows and bullets that hold no part of an equation, signs of equations, and what stands for a blank to fill in.
ARROW, BULLET = r"(?:->|=>|→|←|↔)", r"[•·▪◦]+"
SIGN_CLASS = r"A-Za-z0-9_+\-=/^().,<>≤≥×÷·\s"
BLANKS = (r"(?<![A-Za-z0-9])(?:_\s*){2,}(?![A-Za-z0-9])", r"(?<![A-Za-z0-9])(?:[-–—]\s*){3,}(?![A-Za-z0-9])")
BLANK = " ___ "
EDGES = " \t\r\n,;:"
#: Without any of these in it, or what they were misread as, a text comes to nothing, so most lines of prose are done with one look.
HOPEFUL = r"(?i)[0-9=^_\\≤≥×÷·−–—âÂÃ]|-\s*-|fraction|squared|numerator|denominator|plus|minus"


def replaced(text: Column, *steps: tuple[str, str]) -> Column:
    """Patterns replaced one after the other, then white space collapsed."""
    return collapse(reduce(lambda now, step: F.regexp_replace(now, *step), steps, text))


def with_blanks(text: Column) -> Column:
    """Rows of underscores or dashes as one mark of a blank."""
    return replaced(text, *[(p, BLANK) for p in BLANKS])


def repaired(text: Column) -> Column:
    """Without wrappers, misread signs, notes of pages, what follows an ending word, arrows, bullets and an item's number."""
    signs = reduce(lambda now, x: F.replace(now, F.lit(x[0]), F.lit(x[1])), MISREAD.items(), unwrapped(text))
    ended = replaced(signs, *[(f"(?i){p}", "") for p in PAGE_NOTES], *[(rf"(?i)\b{p}.*$", "") for p in ENDING_WORDS])
    ends = replaced(ended, (r"^\s*[0-9]+\.\s*", ""), (rf"^\s*{ARROW}\s*", ""), (rf"\s*{ARROW}\s*$", ""), (rf"^\s*{BULLET}\s*", ""), (rf"\s*{BULLET}\s*$", ""))
    return replaced(ends, (rf"\s*{ARROW}\s*", " "))


def is_equation(text: Column) -> Column:
    return equations.has_raw_signal(text) | equations.has_equation_words(text)


def core(text: Column) -> Column:
    """Of the stretches of an equation's characters that have its signs or words the best one, by quality, then length, the first of equals; the whole text if none has."""
    spans = F.regexp_extract_all(text, F.lit(f"[{SIGN_CLASS}]+"), F.lit(0))
    tidy = F.filter(F.transform(spans, lambda x: F.btrim(collapse(x), F.lit(EDGES))), lambda x: x != "")
    judged = F.transform(F.filter(tidy, is_equation), lambda x, i: F.struct(equations.quality(x).alias("quality"), F.length(x).alias("length"), (-i).alias("place"), x.alias("text")))
    return F.coalesce(F.array_max(judged)["text"], text)


def spaced(text: Column) -> Column:
    """Only an equation's characters; repeated pluses and equals signs between operands once; signs with a space on either side."""
    plain = replaced(text, (f"[^{SIGN_CLASS}]", " "))
    once = (r"(?<=[A-Za-z0-9_)\]])\s*([+=])\s*(?:\1\s*)+(?=[A-Za-z0-9_(\[]|___)", r" $1 ")
    single = reduce(lambda now, _: replaced(now, once), range(4), plain)
    return replaced(single, (r"(?<=[0-9])-(?=[0-9])", " - "), (r"(?<=[A-Za-z0-9_)])-(?=[A-Za-z_(])", " - "), (r"\s*([=+/^<>])\s*", r" $1 "), (r"\s*([×÷·])\s*", r" $1 "))


def strict_transcription(s: Text) -> Column:
    """The equation that a text holds, or nothing. Null is empty."""

    def finished(text: Column) -> Column:
        done = F.btrim(with_blanks(text), F.lit(EDGES))
        return let(done, lambda x: F.when((x != "") & is_equation(x), x).otherwise(""))

    def transcribed(text: Column) -> Column:
        found = let(with_blanks(repaired(text)), lambda t: let(core(t), lambda best: let(spaced(best), finished)))
        return F.when(text.rlike(HOPEFUL), found).otherwise("")

    return let(collapse(s), transcribed)
