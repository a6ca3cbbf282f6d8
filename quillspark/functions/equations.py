"""Is a text an equation, read out or written, and how good is it; is a label of use. Built-in column expressions all through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.functions.columns import column, let
from quillspark.functions.responses import any_of, word_count
from quillspark.functions.text import Text, collapse, is_section_heading, normal_for_style, text_or_empty

#: Signs and words that speak for an equation or against one.
RAW_SIGNS = ("=", "^", "_", "\\frac", "\\sqrt", "≤", "≥", "×", "÷", "·", "−", "–", "—")
OPERATORS = ("=", "+", "/", "^", "×", "÷", "·", "≤", "≥")
RELATIONS = (" equals ", " equal to ", " greater than ", " less than ")
OPERATIONS = (" over ", " squared", " cubed", " times ", " divided by ", " square root", " to the ")
SPOKEN = ("equals", "plus", "minus", "over", "squared", "cubed", "times", "divided by", "square root", "to the")
EQUATION_WORDS = ("fraction", "squared", "numerator", "denominator", "plus", "minus")
PAGE_WORDS = ("answers", "chapter", "spss", "document", "image", "page", "transverse axis")
NOT_SPOKEN = ("showing", "centered", "graph", "page", "context", "transverse axis")
NOT_EQUATION = (*NOT_SPOKEN, "answers", "chapter", "spss", "provide", "feedback", "document", "image")
UNSAFE_SIGNS = ("\\", "{", "}", "^", "=", "(", ")", "[", "]", "$")
UNSAFE_WORDS = ("showing", "centered", "graph", "page", "transverse axis")
DATA_CUES = ("table", "spreadsheet", "frequency", "tally", "class limits", "column", "row", "gdp", "epi", "score", "quantity extracted", "tc", "ec", "uc", "dollars")
NOISE = ("answer", "explain", "hint", "question", "chapter", "would", "should", "future profits", "in each case", "does this")
LABEL_WORDS = ("chart", "graph", "plot", "diagram", "figure", "photo", "image")
STYLE_NOT = ("bizchat", "feedback", "page", "equation showing", "expression showing", "start fraction", "end fraction", "numerator", "denominator")
STYLE_SPOKEN = ("equals", "over", "plus", "minus", "open parenthesis", "close parenthesis", "squared", "cubed")
STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that", "are", "was", "were", "into", "onto", "over", "under", "chart", "graph", "plot", "image", "figure")
SPOKEN_MARKS = {"comma": ",", "ellipsis": "...", "open brace": "{", "close brace": "}", "open bracket": "[", "close bracket": "]", "open parenthesis": "(", "close parenthesis": ")"}
#: Words of a picture's text that tell it from a formula, phrases of which some make a formula, and words of names that say one.
PICTURE_WORDS = (
    "graph", "axis", "axes", "grid", "curve", "curves", "rectangle", "picture", "figure", "plot", "diagram", "plane", "hyperbola", "ellipse", "parabola", "triangle", "line", "notes", "handwritten", "steps", "coordinate",
)
READ_OUT = ("equals", "plus", "minus", "over", "squared", "cubed", "open parenthesis", "close parenthesis", "fraction")
MATH_WORDS, EDITOR_WORDS = ("equation", "formula", "math", "vector"), ("professional", "officemath")
FIELD_WORDS = ("eq", "equation", "mathtype", "math", "professional", "officemath")
PROGRAM_WORDS, OBJECT_WORDS, MEDIA_WORDS = ("equation", "mathtype", "math"), ("equation", "mathtype", "oleobject"), ("equation", "mathtype", "formula", "math")
#: A picture's text that names or reads a formula has so many words at most, and reads out so many signs at least.
MOST_WORDS, LEAST_READ_OUT = 12, 4
NUMERIC = r"^[0-9\s.,]+$"


def has_raw_signal(s: Text) -> Column:
    """An operator or sign, two numbers with an operation between, or a letter with a number."""
    text = collapse(s)
    return any_of(text, RAW_SIGNS) | text.rlike(r"[0-9]\s*[/=+\-]\s*[0-9]") | text.rlike(r"\b[A-Za-z][0-9]+\b")


def reads_as_equation(s: Text) -> Column:
    """Words that relate two sides, of three words at least, and nothing that speaks of a page or picture."""
    text = F.lower(collapse(s))
    return ~any_of(text, NOT_EQUATION) & any_of(F.concat(F.lit(" "), text, F.lit(" ")), RELATIONS) & (any_of(F.concat(F.lit(" "), text, F.lit(" ")), OPERATIONS) | (word_count(text) >= 3))


def speaks_of_maths(s: Text) -> Column:
    text = collapse(s)
    return ~any_of(text, NOT_SPOKEN) & any_of(text, SPOKEN)


def has_equation_words(s: Text) -> Column:
    text = text_or_empty(s)
    return text.contains("=") | any_of(text, EQUATION_WORDS) | (text.rlike(r"[A-Za-z].*[A-Za-z]") & text.rlike("[0-9]"))


def _signal(text: Column) -> Column:
    return any_of(text, OPERATORS) | text.rlike(r"\b[0-9]+\s*-\s*[0-9]+\b") | text.rlike(r"\b[A-Za-z]\s*-\s*[A-Za-z0-9]+\b")


def is_low_quality(s: Text) -> Column:
    """Empty, too short without number or operator, a page's words, single characters mostly, or nothing meaningful."""

    def judged(text: Column) -> Column:
        words = F.split(text, r"\s+")
        single = F.size(F.filter(words, lambda w: w.rlike(r"^[\p{L}\p{N}]$"))) / F.size(words)
        meaning = F.exists(words, lambda w: (F.length(w) >= 3) & w.rlike(r"\p{L}"))
        numeric, digit, signal = text.rlike(NUMERIC), text.rlike("[0-9]"), _signal(text)
        return (
            F.when(text == "", True).when(numeric, False).when(F.size(words) < 3, ~(signal | digit))
            .when(any_of(text, (*PAGE_WORDS, "provide", "feedback")) & ~signal, True).when(single > 0.7, True).when(digit & signal, False).otherwise(~meaning & ~signal)
        )

    return let(F.trim(text_or_empty(s)), judged)


def quality(s: Text) -> Column:
    """A score of how much a text is an equation; the parts add up."""

    def scored(text: Column) -> Column:
        operators = any_of(text, (*OPERATORS, "-"))
        parts = {
            1.4: text.rlike(NUMERIC), 1.0: operators, 1.2: text.contains("="), 0.9: any_of(text, (" x", "y", "squared", "fraction", "numerator", "denominator")),
            0.4: word_count(text) >= 5, -1.2: any_of(text, PAGE_WORDS) & ~operators, -1.3: is_low_quality(text),
        }
        points = sum((F.when(holds, F.lit(p)).otherwise(0.0) for p, holds in parts.items()), F.lit(0.0))
        return points - F.greatest(F.lit(0), F.length(text) - 220) * 0.002

    return let(text_or_empty(s), scored)


def is_high_confidence(s: Text) -> Column:
    return (quality(s) >= 1.4) & (word_count(text_or_empty(s)) >= 4)


def is_safe_text(s: Text) -> Column:
    """Plain words only, six at least."""
    text = collapse(s)
    marked = F.lit(False)
    for sign in UNSAFE_SIGNS:
        marked = marked | text.contains(sign)
    return (word_count(text) >= 6) & ~text.rlike(r"[^\x00-\x7E]") & ~marked & ~any_of(text, UNSAFE_WORDS)


def is_running_text(s: Text) -> Column:
    """Long, a question, or with a page's words, unless it is about data."""
    text = text_or_empty(s)
    n = word_count(text)
    return ~any_of(text, DATA_CUES) & ((n > 28) | (text.contains("?") & (n > 12)) | any_of(text, NOISE))


def is_useful_label(s: Text) -> Column:
    """14 words at most, that name a picture or are all short capitals."""
    text = collapse(s)
    words = F.filter(F.split(F.translate(text, "=+", "  "), r"\s+"), lambda w: w.rlike(r"^\p{L}+$"))
    return (text != "") & ~is_running_text(text) & (word_count(text) <= 14) & (any_of(text, LABEL_WORDS) | F.forall(words, lambda w: (w == F.upper(w)) & (F.length(w) <= 4)))


def is_style_example(s: Text) -> Column:
    """2 to 18 words that read an expression out, without editors' terms."""
    text = collapse(s)
    return word_count(text).between(2, 18) & ~any_of(text, STYLE_NOT) & any_of(text, STYLE_SPOKEN)


def marks_for_words(s: Text) -> Column:
    """Spoken punctuation as marks."""
    text = collapse(s)
    for words, mark in SPOKEN_MARKS.items():
        text = F.regexp_replace(text, rf"(?i)\b{words}\b", F.lit(mark))
    return collapse(text)


def label_words(s: Text, most: int = 5) -> Column:
    """The first distinct words, in any case, of three letters or more that say something; each as it is written first."""
    words = F.filter(F.regexp_extract_all(text_or_empty(s), F.lit(r"[A-Za-z][A-Za-z\-]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*STOP_WORDS))

    def first_ones(w: Column) -> Column:
        low = F.transform(w, F.lower)
        return F.slice(F.transform(F.array_distinct(low), lambda x: F.get(w, F.array_position(low, x).cast("int") - 1)), 1, most)

    return let(words, first_ones)


def finished(s: Text, role: Text, page: Text) -> Column:
    """A text with a full stop; equations of low quality are empty; other things than images and equations name their page."""

    def ended(text: Column) -> Column:
        stopped = F.when(text.rlike(r"[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))
        paged = F.concat(F.substring(stopped, F.lit(1), F.length(stopped) - 1), F.lit(" (page "), column(page).cast("string"), F.lit(")."))
        names = ~column(role).isin("equation", "image") & column(page).isNotNull() & ~F.lower(stopped).contains("page") & (F.length(stopped) < 250)
        return F.when(text == "", "").when((column(role) == "equation") & is_low_quality(text), "").when(names, paged).otherwise(stopped)

    return let(collapse(s), ended)


def picture_reads_as_equation(s: Text) -> Column:
    """Whether a picture's text is that of a formula: no word of pictures in it, and an editor's name, a word for formulas in few words, or signs read out."""

    def judged(normal: Column) -> Column:
        words = F.split(normal, " +")
        has = lambda values: F.arrays_overlap(words, F.array(*map(F.lit, values)))
        few = F.size(words) <= MOST_WORDS
        read_out = sum((normal.contains(x).cast("int") for x in READ_OUT), F.lit(0))
        other = (normal == "") | is_section_heading(normal) | has(PICTURE_WORDS)
        return F.when(other, False).when(has(EDITOR_WORDS), True).when(has(MATH_WORDS), few).otherwise(few & (read_out >= LEAST_READ_OUT))

    return let(normal_for_style(s), judged)


def target_is_equation(target: Text, relation: Text, known: Column) -> Column:
    """Whether a part of a package holds a formula: known as one, an embedded object, or named like one. target: its path; relation: its relation's type."""
    path, kind = F.lower(text_or_empty(target)), text_or_empty(relation)
    embedded = path.startswith("word/embeddings/") & (any_of(kind, ("oleobject", "package")) | any_of(path, OBJECT_WORDS))
    return F.coalesce(known, F.lit(False)) | embedded | (path.startswith("word/media/") & any_of(path, MEDIA_WORDS))


def drawing_is_equation(s: Text, target: Text, relation: Text, known: Column, width: Column, height: Column) -> Column:
    """Whether a drawing is a formula, by its part or else by its text, unless it is large."""
    large = F.coalesce(G.size_class_of_points(width, height) == "large", F.lit(False))
    return target_is_equation(target, relation, known) | (picture_reads_as_equation(s) & ~large)


def paragraph_holds_equation(has_math: Column, instructions: Text, programs: Column, targets: Column, has_object: Column, style: Text) -> Column:
    """Whether a paragraph holds a formula. has_math: an equation object or markup; instructions: its fields' text; programs: array<string> of its objects' program names;
    targets: array<boolean>, target_is_equation() of its relations; has_object: an object or legacy picture, which counts in a style for formulas."""
    words = F.regexp_extract_all(F.lower(text_or_empty(instructions)), F.lit(r"\w+"), F.lit(0))
    truly = lambda c: F.coalesce(c, F.lit(False))
    return (
        truly(has_math) | F.arrays_overlap(words, F.array(*map(F.lit, FIELD_WORDS))) | truly(F.exists(programs, lambda p: any_of(p, PROGRAM_WORDS)))
        | truly(F.exists(targets, truly)) | (truly(has_object) & any_of(text_or_empty(style), MATH_WORDS))
    )


def is_visual_equation(role: Text, text: Text, program: Text, object_target: Text, image_target: Text) -> Column:
    """An equation element with an object or picture, or without any text."""
    given = lambda c: text_or_empty(c) != ""
    return F.coalesce(column(role) == "equation", F.lit(False)) & (given(program) | given(object_target) | given(image_target) | (normal_for_style(text) == ""))


#: Signs that typeset formulas have, signs that group, words of headings, and what else reads as mathematics beside a digit.
TYPESET_SIGNS = ("=", "+", "/", "^", "\u00d7", "\u00f7", "\u00b7", "\u2264", "\u2265")
GROUPING_SIGNS = ("(", ")", "[", "]")
HEADING_WORDS = ("answer", "answers", "chapter", "section", "exercise", "problem", "review", "solution", "solutions")
MATH_MARKS = "[=+\\-/*^()\u00b2\u00b3\u00bc\u00bd\u00be\u2264\u2265]"
DIGIT = r"[\p{Nd}\x{00B2}\x{00B3}\x{00B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"


def is_typeset_equation(s: Text) -> Column:
    """A short text of three characters or more with a sign of mathematics and something to go with it, or an assignment; no heading of a section, no sentence."""
    text = F.trim(text_or_empty(s))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    signs = lambda values: sum((text.contains(x).cast("int") for x in values), F.lit(0))
    sentence = (count(r"(?U)\b[\w']+\b") >= 8) & (count("[A-Za-z]{2,}") >= 5)
    heading = text.rlike(rf"(?iU)\b({'|'.join(HEADING_WORDS)})\b")
    low = F.lower(text)
    typeset = (signs(TYPESET_SIGNS) >= 1) & ((count(DIGIT) >= 1) | (count(r"\p{L}") >= 2))
    grouped = (signs(GROUPING_SIGNS) >= 2) & ((count(DIGIT) >= 1) | low.rlike(r"(?U)\b[a-z]\b"))
    return (F.length(text) >= 3) & ~sentence & ~heading & (typeset | grouped | low.rlike(r"(?U)\b[a-z]\s*=\s*."))


def is_math_text(s: Text) -> Column:
    """A typeset equation, or a digit with any mark of mathematics."""
    text = F.trim(text_or_empty(s))
    return is_typeset_equation(text) | (text.rlike(DIGIT) & text.rlike(MATH_MARKS))


def is_equation_fragment(s: Text) -> Column:
    """A line that may be a part of an equation: mathematics, or, with fewer than three words, a letter, sign or number by itself, a sign of typeset formulas, or a digit in eight characters at most."""
    text = F.trim(text_or_empty(s))
    alone = text.rlike(r"^(?:[A-Za-z]|[=+\-/*^()\[\]]|[A-Za-z]?[0-9]+(?:\.[0-9]+)?)$")
    signs = text.rlike("[\uf0b4\u00d7\u00b7\u2264\u2265]")
    words = F.regexp_count(text, F.lit("[A-Za-z]{2,}"))
    return (text != "") & (is_math_text(text) | ((words < 3) & (alone | signs | ((F.length(text) <= 8) & text.rlike(DIGIT)))))
