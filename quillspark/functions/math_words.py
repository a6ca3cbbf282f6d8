"""Numbers and signs as spoken words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
ONES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SCALES = ("million", "thousand", "")
SIGNS = {
    ">=": "greater than or equal to", "<=": "less than or equal to", "!=": "not equal to", "<>": "not equal to", "==": "equals", "->": "maps to", "≤": "less than or equal to", "≥": "greater than or equal to",
    "×": "times", "*": "times", "·": "times", "÷": "divided by", "−": "minus", "–": "minus", "—": "minus", ">": "greater than", "<": "less than", "=": "equals", "+": "plus", "/": "over",
}
POWERS = {"2": "squared", "3": "cubed"}


def integer_words(n: Column) -> Column:
    """In words up to 999,999,999, without 'and' or hyphens; beyond that as digits."""
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))

    def below_thousand(v: Column) -> Column:
        rest = v % 100
        low = F.when(rest == 0, None).when(rest < 20, ones[rest]).otherwise(F.concat_ws(" ", tens[F.floor(rest / 10).cast("int")], F.when(rest % 10 > 0, ones[rest % 10])))
        return F.concat_ws(" ", F.when(v >= 100, F.concat(ones[F.floor(v / 100).cast("int")], F.lit(" hundred"))), low)

    size = F.abs(n)
    parts = []
    for k, scale in enumerate(SCALES):
        v = (F.floor(size / 1000 ** (2 - k)) % 1000).cast("int")
        parts.append(F.when(v > 0, F.concat_ws(" ", below_thousand(v), F.lit(scale) if scale else F.lit(None).cast("string"))))
    words = F.when(size == 0, ONES[0]).otherwise(F.concat_ws(" ", *parts))
    return F.when(size > 999_999_999, n.cast("string")).otherwise(F.concat_ws(" ", F.when(n < 0, "minus"), words))


def spoken_digits(digits: str) -> str:
    """A number of any length: words up to nine digits, beyond that the digits, without zeros in front."""
    short = digits.lstrip("0")
    return short if len(short) > 9 else spoken_integer(int(short or "0"))


def spoken_integer(n: int) -> str:
    if abs(n) > 999_999_999:
        return str(n)
    out = ["minus"] if n < 0 else []
    n = abs(n)
    for scale, name in ((1_000_000, "million"), (1000, "thousand"), (1, "")):
        part = n // scale % 1000
        if part:
            if part >= 100:
                out += [ONES[part // 100], "hundred"]
            if part % 100:
                out += [ONES[part % 100]] if part % 100 < 20 else [TENS[part % 100 // 10], *([ONES[part % 10]] if part % 10 else [])]
            out += [name] if name else []
    return " ".join(out or [ONES[0]])


NUMBER = re.compile(r"(?<![\w.])([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.([0-9]+))?(%?)(?![\w])")
SIGN = re.compile("|".join(re.escape(x) for x in sorted(SIGNS, key=len, reverse=True)))


def spoken_numbers(text: str) -> str:
    """Whole numbers in words, decimals digit by digit, % as percent; numbers that are part of a word stay."""

    def say(m: re.Match) -> str:
        words = [spoken_digits(m[1].replace(",", ""))]
        if m[2]:
            words += ["point", *(ONES[int(c)] for c in m[2])]
        return " ".join(words + (["percent"] if m[3] else []))

    return NUMBER.sub(say, text)


FRACTION, ROOT = re.compile(r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}"), re.compile(r"\\sqrt\s*\{([^{}]+)\}")
POWER = re.compile(r"\b([A-Za-z])\s*\^\s*(?:\{\s*([0-9]+)\s*\}|([0-9]+)\b)")
HYPHEN = re.compile(r"(?<=\d)-(?=\d)|(?<=[\w)])-(?=[A-Za-z_(])|(?<=\s)-(?=\s)")


def spoken_signs(text: str) -> str:
    """A formula as words: fractions, roots and powers, then signs (longer ones first), then numbers."""

    def power(m: re.Match) -> str:
        digits = (m[2] or m[3]).lstrip("0")
        return f"{m[1]} {POWERS.get(digits) or 'to the ' + spoken_digits(digits)}"

    while (inner := ROOT.sub(r" square root of \1 ", FRACTION.sub(r" \1 over \2 ", text))) != text:
        text = inner
    spaced = SIGN.sub(lambda m: f" {SIGNS[m[0]]} ", HYPHEN.sub(" minus ", POWER.sub(power, text)))
    return " ".join(spoken_numbers(" ".join(spaced.split())).split())


def _each(f) -> object:
    return F.pandas_udf(lambda text: text.map(lambda x: None if x is None else f(x)), "string")


def numbers_as_words(text: Column) -> Column:
    return _each(spoken_numbers)(text)


def signs_as_words(text: Column) -> Column:
    return _each(spoken_signs)(text)
