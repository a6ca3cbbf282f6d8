"""Generated answers as rows: numbered texts out of JSON that may be wrapped, cut short, or no JSON at all; and their cleaning."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.columns import let
from quillspark.functions.text import collapse

#: Keys under which an answer may hold its map, and what stands between a line's number and its text.
MAP_KEYS = ("alts", "results", "data", "ocr")
AFTER_NUMBER = ("=>", ".", ")", "-", ":", "|")
LABELS = ("description", "alt", "alttext")
#: Openings that a text need not have. One of each list goes, in this order; a blank must follow those of the first, second and last.
SENTENCE_OPENINGS = (
    "this equation show", "this equation shows", "this equation showing", "this equation contain", "this equation contains", "this image show", "this image shows", "this image showing",
    "this image contain", "this image contains", "the equation show", "the equation shows", "the equation showing", "the equation contain", "the equation contains", "the image show",
    "the image shows", "the image showing", "the image contain", "the image contains",
)
NOUN_OPENINGS = (
    "equation show", "equation shows", "equation showing", "equation of", "equations show", "equations shows", "equations showing", "equations of", "image show", "image shows", "image showing",
    "image of", "images show", "images shows", "images showing", "images of", "picture show", "picture shows", "picture showing", "picture of", "photo show", "photo shows", "photo showing",
    "photo of",
)
LABEL_OPENINGS = ("equation:", "equation-", "equation :", "equation -", "image:", "image-", "image :", "image -")
THERE_OPENINGS = ("there is", "there are")
#: Labels in front of a whole answer, and the form of those that name what they describe.
WRAPPERS = ("alt text:", "alt text-", "alt:", "alt-", "answer:", "answer-", "response:", "response-")
DESCRIBED = r"(?i)^(?:here(?: is|'s) )?(?:a |the )?(?:screen[ -]?reader(?:[ -]?friendly)? )?(?:alt text|description)(?: (?:for|of))?(?: the)?(?: (?:image|figure|chart|graph|table|diagram))? ?[:-] ?"
#: Signs of a text about data, which may be longer; of an answer that talks about itself; of a page's running text.
DATA_WORDS = ("table", "spreadsheet", "graph", "chart", "plot", "diagram", "axis", "axes", "legend", "column", "row", "header", "frequency", "tally")
TALK = ("please provide", "i will create", "i can create", "accessibility alt text", "final alt text", "educational image description", "placeholder", "answer:", "hint:", "chapter", "exercise", "question")
SENTENCES, DATA_SENTENCES, LEAST_WORDS, MOST_CHARACTERS = 2, 20, 3, 320


def unfenced(text: str) -> str:
    """The text without the fence that wraps it."""
    lines = text.strip().split("\n")
    if lines[0].strip().lower() in ("```", "```json"):
        lines = lines[1:]
    elif lines[0].lstrip().startswith("```"):
        lines[0] = lines[0].lstrip()[3:].removeprefix("json")
    return "\n".join(lines).strip().removesuffix("```").strip()


def json_in(text: str) -> object:
    """The widest of the whole text, what stands in braces and what stands in brackets that is JSON; null if none is."""
    spans = [(0, len(text)), *((text.find(a), text.rfind(b) + 1) for a, b in ("{}", "[]"))]
    for start, end in spans:
        if 0 <= start < end:
            try:
                return json.loads(text[start:end])
            except ValueError:
                pass
    return None


def pairs(value: object, field: str) -> Iterator[tuple[object, object]]:
    """Numbers and texts of a list of records, of a record that wraps one, or of a map from numbers."""
    match value:
        case list():
            yield from ((x.get("number"), x.get(field)) for x in value if isinstance(x, dict))
        case {"items": list(rows)}:
            yield from pairs(rows, field)
        case dict() if value and all(str(k).strip().isdigit() for k in value):
            yield from value.items()
        case dict():
            inner = [value[k] for k in MAP_KEYS if value.get(k)]
            if inner and isinstance(inner[0], dict):
                yield from inner[0].items()


def opening_number(line: str) -> tuple[int, str] | None:
    """The number that a line begins with, of three digits at most, and what follows it and its mark."""
    rest = line.strip()
    if rest[:6].lower() == "number":
        rest = rest[6:].lstrip()
    digits = rest[: len(rest) - len(rest.lstrip("0123456789"))]
    rest = rest[len(digits) :].lstrip()
    mark = next((m for m in AFTER_NUMBER if rest.startswith(m)), None)
    return (int(digits), rest[len(mark) :].strip()) if mark and 1 <= len(digits) <= 3 else None


def unlabelled(text: str, field: str) -> str:
    """A text without a label such as 'Alt text:' in front."""
    at = min((k for k in map(text.find, ":=-") if k >= 0), default=-1)
    label = text[: max(0, at)].strip().lower()
    squeezed = "".join(c for c in label if c not in " _")
    return text[at + 1 :].strip() if label and (label == field.lower() or squeezed in LABELS) else text


def numbered_lines(text: str, field: str) -> dict[int, str]:
    """'1. text' and the lines that follow it."""
    parts: list[tuple[int, list[str]]] = []
    for line in text.splitlines():
        found = opening_number(line)
        if found:
            parts.append((found[0], [found[1]]))
        elif parts:
            parts[-1][1].append(line)
    texts = {n: unlabelled(" ".join(" ".join(lines).split()), field) for n, lines in parts}
    return {n: t for n, t in texts.items() if n > 0 and t}


def numbered_texts(text: str | None, field: str = "alt_text") -> dict[int, str]:
    """Number to text; the last of a number wins; numbers below 1 don't count."""
    plain = unfenced(text or "")
    out = {}
    for number, value in pairs(json_in(plain), field):
        try:
            out[int(number)] = " ".join(str(value or "").split())
        except (TypeError, ValueError):
            continue
    return {n: t for n, t in out.items() if n > 0} or numbered_lines(plain, field)


def parse(column: Column, field: str = "alt_text") -> Column:
    """array<struct<number, text>> of an answer."""
    return F.pandas_udf(lambda s: s.map(lambda x: list(numbered_texts(x, field).items())), "array<struct<number:int,text:string>>")(column)


def after(text: Column, leads: list[str]) -> Column:
    """text without the longest of these leads, in any case, that it begins with."""

    def rest(t: Column) -> Column:
        low = F.lower(t)
        found = F.greatest(F.lit(0), *[F.when(low.startswith(lead), len(lead)).otherwise(0) for lead in leads])
        return F.ltrim(F.substring(t, found + 1, F.length(t)))

    return let(text, rest)


def without_openings(column: Column) -> Column:
    """On one line, without 'this image shows', 'picture of', 'equation:', 'there is' or 'description of the image:' in front."""
    text = collapse(column)
    for openings in (SENTENCE_OPENINGS, NOUN_OPENINGS):
        text = after(text, [x + " " for x in openings])
    text = after(text, list(LABEL_OPENINGS))
    return F.regexp_replace(after(text, [x + " " for x in THERE_OPENINGS]), DESCRIBED, "")


def unquoted(text: Column) -> Column:
    return F.btrim(text, F.lit("\"'` "))


def unwrapped(column: Column) -> Column:
    """On one line, without quotes around it or a label such as 'Alt text:' in front."""
    return after(unquoted(collapse(column)), list(WRAPPERS))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Does the lower-cased text contain any of them?"""
    low = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | low.contains(word)
    return found


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def is_data_dense(text: Column) -> Column:
    return any_of(text, DATA_WORDS)


def cleaned(column: Column, most: int = MOST_CHARACTERS) -> Column:
    """A generated text fit to stand: unwrapped, without openings, of LEAST_WORDS words or more, two sentences of it or DATA_SENTENCES if it is about
    data, cut at a limit. Empty if it talks about itself or is a page's running text."""

    def judged(text: Column) -> Column:
        limit = F.when(is_data_dense(text), DATA_SENTENCES).otherwise(SENTENCES)
        kept = F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), F.lit(1), limit), " ")
        return let(kept, lambda k: F.when((word_count(text) < LEAST_WORDS) | any_of(k, TALK), "").otherwise(F.trim(F.substring(k, F.lit(1), F.lit(most)))))

    return let(unquoted(without_openings(unwrapped(column))), judged)
