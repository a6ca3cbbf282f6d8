"""Text scalars, all of them built-in column expressions.

The three normal forms are different on purpose: alignment keeps operators and punctuation, comparison also turns four marks into
spaces after collapsing, style matching keeps letters and digits only (so collapsing happens before marks go, and runs of spaces can stay).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.columns import column, replace_all

Text = Column | str

NUMBER_FORMATS = ("decimal", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman")
#: Fixed values.
ROMAN = {1000: "M", 900: "CM", 500: "D", 400: "CD", 100: "C", 90: "XC", 50: "L", 40: "XL", 10: "X", 9: "IX", 5: "V", 4: "IV", 1: "I"}
EQUATION_SIGNS = ("=", "+", "-", "^", "/", "(", ")", "x", "y", "a2", "b2", "c2")
#: Marks that comparison takes for spaces; what alignment keeps besides letters and digits; what is dropped. Letters are named one by one: that makes a class one look-up, where ranges are a test each.
MARKS, OPERATING = "_`~|", r"=+\-*/^().,:;"
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
NOT_ALIGNED, NOT_STYLED = f"[^{LETTERS}{OPERATING}]", f"[^{LETTERS}]+"
SECTION_WORDS = ("answer", "answers", "chapter", "cont", "exercise", "problem", "review", "section", "solution", "solutions")
ROMAN_PATTERN = r"^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"
#: What a typed list number may stand between, and signs that open a bulleted line; symbol fonts have theirs in a private range.
OPENERS, CLOSERS = ("(", "["), (".", ")", "]")
BULLETS = ("*", "-", "\u2013", "\u2014", "\u2022", "\u2043", "\u2219", "\u25aa", "\u25b6", "\u25cb", "\u25cf", "\u25fe")
SYMBOL_FONT = ("\uf000", "\uf0ff")


def text_or_empty(s: Text) -> Column:
    return F.coalesce(column(s), F.lit(""))


def collapse(s: Text) -> Column:
    """Runs of white space to one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(text_or_empty(s), r"(?U)\s+", " "))


def spaced(s: Text) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(s)), r"(?U)\s+", " ")


def normal_for_alignment(s: Text) -> Column:
    return F.trim(F.regexp_replace(spaced(s), NOT_ALIGNED, ""))


def normal_for_comparison(s: Text) -> Column:
    """As normal_for_alignment(), which it is unless one of the marks is there."""
    t = spaced(s)
    marked = F.contains(t, F.lit(MARKS[0]))
    for mark in MARKS[1:]:
        marked = marked | F.contains(t, F.lit(mark))
    return F.when(marked, F.trim(F.regexp_replace(F.regexp_replace(t, f"[{MARKS}]", " "), NOT_ALIGNED, ""))).otherwise(normal_for_alignment(s))


def normal_for_style(s: Text) -> Column:
    return F.trim(F.regexp_replace(spaced(s), NOT_STYLED, ""))


def style_of_aligned(aligned: Column) -> Column:
    """normal_for_style() of a text by its normal_for_alignment(), which has all of it and marks between."""
    return F.trim(F.regexp_replace(aligned, f"[{OPERATING}]+", ""))


def fingerprint(s: Text) -> Column:
    """SHA-1 of the lower-cased text with white space collapsed."""
    return F.sha1(collapse(F.lower(text_or_empty(s))))


def is_effectively_empty(s: Text) -> Column:
    """Nothing but quotes and blanks."""
    return F.trim(F.regexp_replace(collapse(s), "[\"']", "")) == ""


def same_or_contained(a: Text, b: Text) -> Column:
    """Equal in style form, or the shorter, of at least 10 characters, is in the longer."""
    return same_normal(normal_for_style(a), normal_for_style(b))


def same_normal(left: Column, right: Column) -> Column:
    """The same, for columns that are in style form already."""
    within = lambda short, long: (F.length(short) >= 10) & long.contains(short)
    return (left != "") & (right != "") & ((left == right) | F.when(F.length(left) <= F.length(right), within(left, right)).otherwise(within(right, left)))


def is_valid_paragraph(s: Text, y: Column) -> Column:
    """Five characters or more, and not within 5 % of the page's top or bottom."""
    return (F.length(F.trim(text_or_empty(s))) >= 5) & (y.isNull() | y.between(0.05, 0.95))


def is_equation_like(s: Text) -> Column:
    return normal_is_equation_like(normal_for_comparison(s))


def normal_is_equation_like(normal: Column) -> Column:
    """The same, for a column that is in comparison form already."""
    signs = sum((normal.contains(x).cast("int") for x in EQUATION_SIGNS), F.lit(0))
    return (signs >= 3) | ((signs >= 2) & (F.length(F.regexp_replace(normal, "[^0-9]", "")) >= 2))


def first_word(s: Text) -> Column:
    """What stands before the first blank, blanks in front aside."""
    return F.regexp_extract(text_or_empty(s), r"^\s*(\S*)", 1)


def opening(s: Text) -> Column:
    """The first word with the blanks around it."""
    return F.regexp_extract(text_or_empty(s), r"^\s*\S*\s*", 0)


def is_list_item(s: Text) -> Column:
    """The first word is a number or letter with a full stop or closing parenthesis, or Roman digits with a full stop."""
    word = first_word(F.trim(text_or_empty(s)))
    mark, value = F.right(word, F.lit(1)), F.substring(word, F.lit(1), F.length(word) - 1)
    counted = value.rlike("^[0-9]+$") | value.rlike("^[A-Za-z]$")
    return (counted & mark.isin(".", ")")) | ((F.translate(F.upper(value), "IVXLCDM", "") == "") & (value != "") & (mark == "."))


def has_section_word(s: Text) -> Column:
    words = F.regexp_extract_all(F.lower(text_or_empty(s)), F.lit(r"\w+"), F.lit(0))
    return F.arrays_overlap(words, F.array(*map(F.lit, SECTION_WORDS)))


def is_section_heading(s: Text) -> Column:
    """A number and a word such as section or exercise. Marks go first, so 3.2 counts as 32."""
    normal = normal_for_style(s)
    return has_section_word(normal) & normal.rlike(r"^[0-9]+\b")


def opens_like_prose(s: Text, count: int = 5) -> Column:
    words = F.regexp_extract_all(text_or_empty(s), F.lit("[A-Za-z]+"), F.lit(0))
    return (F.size(words) >= count) & F.forall(F.slice(words, 1, count), lambda w: F.length(w) >= 2)


def starts_with_capital(s: Text) -> Column:
    first = F.regexp_extract(text_or_empty(s), "[A-Za-z]", 0)
    return (first == "") | (first == F.upper(first))


def is_sentence_case(s: Text) -> Column:
    words = F.regexp_extract_all(text_or_empty(s), F.lit("[A-Za-z][A-Za-z']*"), F.lit(0))
    shouted = lambda w: (w == F.upper(w)) & (F.length(w) > 1)
    return F.when(F.size(words) == 0, True).when(~starts_with_capital(s), False).when(F.size(words) == 1, ~shouted(words[0])).otherwise(~F.exists(F.slice(words, 2, F.size(words)), shouted))


#: What a footer is set in.
FOOTER_FONT, FOOTER_POINTS = "times new roman", 10.0


def footer_issues(text: Text, fonts: Column, sizes: Column) -> Column:
    """array<string>: codes of what is wrong with a footer, with what was found instead: font, size, capital, case."""
    lettered = text_or_empty(text).rlike("[A-Za-z]")
    other_fonts = F.filter(fonts, lambda f: F.lower(f) != FOOTER_FONT)
    other_sizes = F.filter(sizes, lambda x: F.abs(x - FOOTER_POINTS) > 0.05)
    shown = lambda code, found: F.concat(F.lit(f"{code}:"), F.array_join(found.cast("array<string>"), ","))
    told = [
        F.when(F.coalesce(F.size(fonts), F.lit(0)) < 1, "font:unknown").when(F.size(other_fonts) > 0, shown("font", other_fonts)),
        F.when(F.coalesce(F.size(sizes), F.lit(0)) < 1, "size:unknown").when(F.size(other_sizes) > 0, shown("size", other_sizes)),
        F.when(lettered & ~starts_with_capital(text), "capital"),
        F.when(lettered & ~is_sentence_case(text), "case"),
    ]
    return F.array_compact(F.array(*told))


def paragraph_role(text: Text, style: Text, num_id: Text, has_math: Column, equation_only: Column, outline: Column) -> Column:
    """The first rule that holds: section heading text, heading, title, list, equation, caption, quote, empty."""
    name = F.lower(text_or_empty(style))
    formula_style = name.rlike("equation|formula|math|vector|professional")
    empty = F.when(text_or_empty(text) == "", "empty").otherwise("normal_text")
    return (
        F.when(is_section_heading(text), "normal_text")
        .when(outline.isNotNull() | name.contains("heading") | name.rlike("^h[1-6]$"), "heading")
        .when(name.contains("title"), "title")
        .when(column(num_id).isNotNull() | is_list_item(text), "list")
        .when(has_math, F.when(equation_only, "equation").otherwise(empty))
        .when(formula_style, F.when(equation_only, "equation").otherwise("normal_text"))
        .when(name.contains("caption"), "caption")
        .when(name.contains("quote"), "quote")
        .otherwise(empty)
    )


def tokens(s: Text) -> Column:
    """The distinct words of lower-case letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(collapse(s)), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def letters(n: Column) -> Column:
    """1 a, 26 z, 27 aa; numbers below 1 as digits."""
    step = lambda acc, _: F.when(acc["left"] > 0, F.struct(F.floor((acc["left"] - 1) / 26).cast("long").alias("left"), F.concat(F.char((F.pmod(acc["left"] - 1, F.lit(26)) + 97).cast("int")), acc["text"]).alias("text"))).otherwise(acc)
    made = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(n.cast("long").alias("left"), F.lit("").alias("text")), step, lambda acc: acc["text"])
    return F.when(n > 0, made).otherwise(n.cast("string"))


def column_letters(n: Column) -> Column:
    return F.upper(letters(n))


def letters_to_number(s: Text) -> Column:
    return F.aggregate(F.split(F.lower(column(s)), ""), F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.ascii(c) - 96)


def roman(n: Column) -> Column:
    """Roman numeral; numbers below 1 count as 1."""
    signs = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN.items()])
    start = F.struct(F.greatest(n, F.lit(1)).cast("long").alias("left"), F.lit("").alias("text"))
    step = lambda acc, x: F.struct(F.pmod(acc["left"], x["v"]).cast("long").alias("left"), F.concat(acc["text"], F.repeat(x["s"], F.floor(acc["left"] / x["v"]).cast("int"))).alias("text"))
    return F.aggregate(signs, start, step, lambda acc: acc["text"])


def roman_to_number(s: Text) -> Column:
    values = F.transform(F.split(F.upper(column(s)), ""), lambda c: F.element_at(F.create_map(*[x for k, v in ROMAN.items() if len(v) == 1 for x in (F.lit(v), F.lit(k))]), c))
    return F.aggregate(values, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda acc, v: F.struct((acc["sum"] + v - F.when(v > acc["last"], 2 * acc["last"]).otherwise(0)).alias("sum"), v.alias("last")), lambda acc: acc["sum"])


def is_roman(s: Text) -> Column:
    up = F.upper(column(s))
    return (up != "") & ((F.length(up) > 1) | up.isin("I", "V", "X")) & up.rlike(ROMAN_PATTERN)


def list_number(n: Column, number_format: Column) -> Column:
    return F.when(number_format == "lowerLetter", letters(n)).when(number_format == "upperLetter", F.upper(letters(n))).when(number_format == "lowerRoman", F.lower(roman(n))).when(number_format == "upperRoman", roman(n)).otherwise(n.cast("string"))


def leading_blanks(s: Text) -> Column:
    return F.regexp_extract(text_or_empty(s), r"^\s*", 0)


def after_first_word(s: Text) -> Column:
    """Where the second word begins: blanks in front, the first word and the blanks after it, in characters."""
    return F.length(F.regexp_extract(text_or_empty(s), r"^\s*\S+\s+", 0))


def list_prefix(s: Text) -> Column:
    """struct<kind, value, length, leading, template> of a typed list marker, a first word such as (a) or iv.; null if there is none."""
    word = first_word(s)
    opener = F.when(F.left(word, F.lit(1)).isin(*OPENERS), F.left(word, F.lit(1))).otherwise("")
    closer = F.right(word, F.lit(1))
    value = F.substring(word, F.length(opener) + 1, F.length(word) - F.length(opener) - 1)
    lower = value == F.lower(value)
    kind = F.when(value.rlike("^[0-9]+$"), "decimal").when(~value.rlike("^[A-Za-z]+$"), None)
    kind = kind.when(is_roman(value), F.when(lower, "lowerRoman").otherwise("upperRoman")).when(F.length(value) <= 2, F.when(lower, "lowerLetter").otherwise("upperLetter"))
    found = F.struct(kind.alias("kind"), value.alias("value"), after_first_word(s).alias("length"), leading_blanks(s).alias("leading"), F.concat(opener, F.lit("%1"), closer).alias("template"))
    return F.when(closer.isin(*CLOSERS) & (after_first_word(s) > 0) & kind.isNotNull(), found)


def opens_with_bullet(s: Text) -> Column:
    """Whether the first word is a bullet, and a second one may follow."""
    word = first_word(s)
    return (F.length(word) == 1) & (word.isin(*BULLETS) | word.between(*SYMBOL_FONT)) & (after_first_word(s) > 0)


def prefix_number(prefix: Column) -> Column:
    """The number that a list_prefix() stands for."""
    value = prefix["value"]
    return F.when(prefix["kind"] == "decimal", value.try_cast("long")).when(prefix["kind"].endswith("Roman"), roman_to_number(value)).otherwise(letters_to_number(value)).cast("long")


def indent_level(leading: Text) -> Column:
    """A level for each tab or four spaces, 8 at most."""
    size = F.length(column(leading))
    tabs = size - F.length(F.replace(column(leading), F.lit("\t"), F.lit("")))
    return F.least(F.lit(8), F.floor((size + 3 * tabs) / 4)).cast("int")


def occurrences(s: Text, find: Text) -> Column:
    """How often `find` occurs, without overlaps."""
    text, part = text_or_empty(s), column(find)
    return F.when(F.length(part) > 0, (F.length(text) - F.length(replace_all(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("long")


def seconds(s: Text) -> Column:
    """'2.5', '1m30s': a duration as seconds; 0 if it is none."""
    text = F.lower(F.trim(text_or_empty(s)))
    unit = lambda u: F.coalesce(F.regexp_extract(text, rf"([0-9]+(?:\.[0-9]+)?){u}(?![a-z])", 1).try_cast("double"), F.lit(0.0))
    return F.when(text.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), text.try_cast("double")).otherwise(unit("h") * 3600 + unit("m") * 60 + unit("s") + unit("ms") / 1000)


def file_stem(s: Text) -> Column:
    """A file name's stem with anything but letters, digits, dot, underscore and hyphen as underscores."""
    stem = F.regexp_replace(F.regexp_replace(text_or_empty(s), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_")


def segments(s: Text) -> Column:
    """The pieces between tabs and line ends that have a letter or digit or open with a bullet."""
    return F.filter(F.split(text_or_empty(s), r"[\t\r\n]+"), lambda x: x.rlike(r"[\p{L}\p{N}]") | opens_with_bullet(x))


def list_level(leading: Text, style: Text, twips: Column) -> Column:
    """The deepest of what blanks in front, a style such as List Number 2, and an indent in twips say; 0 to 8."""
    named = F.regexp_extract(F.trim(column(style)), r"(?i)^List (?:Bullet|Number)\s+([0-9]+)$", 1).try_cast("int") - 1
    of_style = F.coalesce(F.when(column(style).isNotNull(), named), F.lit(0))
    of_indent = F.when(twips >= 720, F.bround((twips - 720) / 720)).otherwise(0)
    return F.greatest(indent_level(leading), *[F.greatest(F.lit(0), F.least(F.lit(8), x.cast("int"))) for x in (of_style, of_indent)])


def references(s: Text) -> Column:
    """array<long> of the objects that a page file's literal refers to: 12 in '12 0 R'."""
    return F.transform(F.regexp_extract_all(text_or_empty(s), F.lit(r"([0-9]+)\s+[0-9]+\s+R"), F.lit(1)), lambda x: x.try_cast("long"))


def four_numbers(s: Text) -> Column:
    """The first four numbers of a literal, such as a box; null if there are fewer."""
    numbers = F.transform(F.regexp_extract_all(text_or_empty(s), F.lit(r"[-+]?(?:[0-9]+\.[0-9]+|[0-9]+|\.[0-9]+)"), F.lit(0)), lambda x: x.cast("double"))
    return F.when(F.size(numbers) >= 4, F.slice(numbers, 1, 4))


def name_key(s: Text) -> Column:
    """A name without slashes in front, lower-cased."""
    return F.lower(F.ltrim(F.trim(text_or_empty(s)), F.lit("/")))


def variant(s: Text, n: int) -> Column:
    """Which of n wordings a text gets, by the sum of its code points."""
    return F.pmod(F.aggregate(F.split(text_or_empty(s), ""), F.lit(0).cast("long"), lambda acc, c: acc + F.ascii(c)), F.lit(n)).cast("long")
