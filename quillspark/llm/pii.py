"""Personal data by weak supervision.

Patterns find the base spans, which always stay. Wider patterns find candidates; labelers (patterns, gazetteers, context) each vote on a
candidate: personal (1), not (0), or abstain (2). Votes and features are small codes, so the whole table is summed up as counts of
(votes, features), at most 3^6 * FEATURE_CODES rows however many documents there are. On these counts expectation-maximisation
estimates each labeler's reliability and the probability of each voting pattern, and a logistic regression learns from these
probabilities to tell from the features alone. Candidates it accepts are added where no base span overlaps them.

One pass over the texts; what it finds, without the texts, is checkpointed and used twice.

Defined results: null and empty texts have no spans. Offsets count code points, ends are exclusive. Without candidates nothing is
learned and nothing added. Of added spans one that begins within an earlier one, or a shorter one with the same beginning, goes. A candidate has any
length; numbers stand in one with up to two blanks, dots, hyphens or parentheses between digits. The CONTEXT characters before a candidate are its context. Rows are handled one by one, repeated or not; only
the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import cut, let, running, text_slices

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<rank:int,start:int,end:int>>"
CANDIDATES = "array<struct<rank:int,start:int,end:int,votes:int,features:int>>"
FEATURE_CODES = 4 * 4 * 3 * 3 * 2 * 2 * 2
LABELERS = 6

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Candidates. What is repeated is taken possessively and neither side crosses another sign, so that a text costs time in proportion to its length.
AT_SIGN = re.compile(r"@|\[at\]|\(at\)| at ")
RIGHT_OF_AT = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\[dot\]|\(dot\)| dot )[A-Za-z0-9-]++)++")
NUMBER = re.compile(r"(?<![0-9])[+(]?[0-9](?:[ ().-]{0,2}[0-9])*+")
PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Characters before a candidate that its context is taken from.
CONTEXT = 40

#: Gazetteers and contexts: fixed values. Two letters are a country's ending.
ENDINGS = frozenset("academy aero agency app art asia biz blog cat cloud club co com community company coop design dev digital edu email engineering example finance foundation fun global gov group health help host info int io jobs law life link live media mil mobi money museum name net news ngo online org page photo post press pro pub research school science services shop site social software solutions space store studio support systems team tech tel today tools top travel university video website wiki work world xyz".split())
#: Telephone codes of countries: the first two digits of two-digit codes, and of those codes that have three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
THREE_DIGIT_CODES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 80 85 87 88 96 97 99".split())
#: Numbers of card issuers: what they begin with, from and to, and how long they are.
ISSUERS = ((4, 4, (13, 16, 19)), (51, 55, (16,)), (2221, 2720, (16,)), (34, 34, (15,)), (37, 37, (15,)), (300, 305, (14,)), (36, 36, (14, 16)), (38, 39, (14, 16)), (6011, 6011, (16, 19)), (644, 649, (16, 19)), (65, 65, (16, 19)), (3528, 3589, (16, 19)), (50, 50, (16, 19)), (56, 58, (16, 19)), (62, 62, (16, 19)))
FOR_IT = re.compile(r"(?i)\b(?:e-?mail|mail|contact|contacto|kontakt|write|reach|call|ring|phone|telephone|tel|mobile|cell|fax|whatsapp|card|visa|mastercard|amex|credit|debit|payment|ip|address|adresse|host|server|from|correo|tarjeta|llamar|teléfono|carte|courriel|appeler|téléphone|karte|telefon|anrufen|handy)\b")
AGAINST_IT = re.compile(r"(?i)\b(?:version|isbn|issn|doi|order|invoice|ref|section|figure|table|page|serial|total|build|release|chapter|id|sku|part|item|pedido|factura|commande|facture|bestellung|rechnung|seite|page)\b")
PLACEHOLDER = re.compile(r"(?i)^(?:no-?reply|user|name|foo|bar|test)@|(\d)\1{6}|0123456789|123456789(?!\d{4})")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def octets(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of the kind, start, end), by kind and start."""
    out: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if octets(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    done = 0
    for m in AT_SIGN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        right = RIGHT_OF_AT.match(text, m.end())
        if start < m.start() and right:
            done = right.end()
            yield 0, start, done
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            n = len(NOT_DIGIT.sub("", m[0]))
            dotted = m[0].count(".") == 3 and not set(m[0]) & set("()+ -")
            if dotted or n >= 7:
                yield 1 if dotted else 2 if n >= 13 and m[0][0] != "+" else 3, m.start(), m.end()


def plain_email(found: str) -> str:
    """An address as it is meant: signs for words in brackets or between blanks."""
    for said, sign in (("[at]", "@"), ("(at)", "@"), (" at ", "@"), ("[dot]", "."), ("(dot)", "."), (" dot ", ".")):
        found = found.replace(said, sign)
    return found


def in_gazetteer(rank: int, found: str, digits: str) -> bool:
    """Does the ending, the network, the issuer or the country exist? Numbers without a country's code are national: with a zero or an area in front."""
    if rank == 0:
        ending = plain_email(found).rpartition(".")[2].lower()
        return ending in ENDINGS or len(ending) == 2 and ending.isalpha()
    if rank == 1:
        first, _, rest = found.partition(".")
        return first.lstrip("0") not in ("", "10", "127", "1", "2") and int(first[:4]) < 224 and not found.startswith(("192.168.", "169.254."))
    if rank == 2:
        return any(len(digits) in sizes and low <= int(digits[: len(str(low))]) <= high for low, high, sizes in ISSUERS)
    if found[0] == "+":
        return digits[0] in "17" or digits[:2] in TWO_DIGIT_CODES or digits[:2] in THREE_DIGIT_CODES
    return digits[0] == "0" and 9 <= len(digits) <= 12 or digits[0] in "23456789" and len(digits) == 10


def judged(text: str, rank: int, start: int, end: int, base: set[tuple[int, int, int]]) -> tuple[int, int]:
    """The labelers' votes and the features of a candidate, as codes."""
    found, digits = text[start:end], NOT_DIGIT.sub("", text[start:end])
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 1]
    sound = rank == 0 and bool(PLAIN_EMAIL.fullmatch(plain_email(found))) or rank == 1 and octets(found) or rank == 2 and len(digits) <= 19 and luhn(digits) or rank == 3 and 8 <= len(digits) <= 15
    glued = bool(before[-1:].isalnum() or after.isalnum() or before[-1:] in "-_/" and before or after in "-_/" and after)
    context = 1 if FOR_IT.search(before) else 0 if AGAINST_IT.search(before) else 2
    known = in_gazetteer(rank, found, digits)
    dull = bool(PLACEHOLDER.search(found)) or len(set(digits)) == 1 and len(digits) > 3 or " at " in found and " dot " not in found
    separators = {c for c in found if c in " .-()"}
    tidy = len(separators - set("()")) <= 2
    votes = (1 if (rank, start, end) in base else 2, 1 if sound else 0, 1 if known else 0, context, 0 if glued else 2, 0 if dull else 1 if tidy else 2)
    features = (rank, min(3, len(found) // 8), context, 0 if not separators else 1 if tidy else 2, int(sound), int(glued), int(known and not dull))
    code = 0
    for value, size in zip(features, (4, 4, 3, 3, 2, 2, 2), strict=True):
        code = code * size + value
    return sum(v * 3**i for i, v in enumerate(votes)), code


def features_of(code: int) -> list[float]:
    """The inputs of the classifier, one-hot."""
    out: list[float] = []
    for size in (2, 2, 2, 3, 3, 4, 4):
        code, value = divmod(code, size)
        out += [float(value == k) for k in range(size)]
    return out


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and candidates of each row."""
    span = pa.list_(pa.struct([(c, pa.int32()) for c in ("rank", "start", "end")]))
    full = pa.list_(pa.struct([(c, pa.int32()) for c in ("rank", "start", "end", "votes", "features")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            bases, wide = [], []
            for text in piece.column(1).to_pylist():
                base = base_spans(text)
                known = set(base)
                bases.append([dict(zip(("rank", "start", "end"), x, strict=True)) for x in base])
                rows = []
                for x in candidates(text):
                    votes, features = judged(text, *x, known)
                    rows.append({"rank": x[0], "start": x[1], "end": x[2], "votes": votes, "features": features})
                wide.append(rows)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(bases, span), pa.array(wide, full)], ["id", "base", "candidates"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("base", T._parse_datatype_string(SPANS)), T.StructField("candidates", T._parse_datatype_string(CANDIDATES))])
    return rows.mapInArrow(run, schema)


def vote_table(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**i % 3 for i in range(LABELERS)], axis=1)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over voting patterns: the probability that each is personal, P(vote | class) as [labeler, class, vote], and the prior."""
    ones, zeros = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    personal = np.clip((ones + 0.5) / (ones + zeros + 1), 0.05, 0.95)
    for _ in range(rounds):
        prior = float((counts @ personal + 1) / (counts.sum() + 2))
        given = np.empty((LABELERS, 2, 3))
        for k in range(LABELERS):
            for v in range(3):
                at = votes[:, k] == v
                given[k, 1, v] = (counts * personal)[at].sum() + 0.1
                given[k, 0, v] = (counts * (1 - personal))[at].sum() + 0.1
        given /= given.sum(axis=2, keepdims=True)
        log = np.log([1 - prior, prior])[None, :] + sum(np.log(given[k, :, votes[:, k]]) for k in range(LABELERS))
        personal = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return personal, given, prior


def regression(inputs: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps."""
    x = np.hstack([inputs, np.ones((len(inputs), 1))])
    w, weights = np.zeros(x.shape[1]), weights / weights.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weights * (p - labels)) + ridge * w
        step = np.linalg.solve((x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(found: DataFrame) -> list[int]:
    """The feature codes that the trained classifier accepts."""
    counted = found.select(F.explode("candidates").alias("c")).groupBy("c.votes", "c.features").count().orderBy("votes", "features").toPandas()
    if counted.empty:
        return []
    patterns, at = np.unique(counted["votes"].to_numpy(), return_inverse=True)
    counts = np.bincount(at, weights=counted["count"])
    personal, _, _ = estimate(vote_table(patterns), counts)
    inputs = np.array([features_of(c) for c in counted["features"]])
    w = regression(inputs, personal[at], counted["count"].to_numpy(dtype=float))
    codes = sorted(set(counted["features"].tolist()))
    score = np.hstack([np.array([features_of(c) for c in codes]), np.ones((len(codes), 1))]) @ w
    return [c for c, s in zip(codes, score, strict=True) if s >= 0]


def overlap(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and added for each row: array<struct<rank, start, end>> sorted by kind and start; rank is the kind's place in KINDS."""
    found = cut(extract(docs, id_col, text_col))
    accepted = train(found)
    good = F.array(*map(F.lit, accepted)).cast("array<int>")
    fresh = F.filter("candidates", lambda c: F.array_contains(good, c["features"]) & ~F.exists("base", lambda b: overlap(b, c)))
    # earliest, then longest; one that overlaps an earlier one goes
    ordered = F.array_sort(F.transform(fresh, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("less"), c["rank"].alias("rank"))))
    # a span is taken if it begins behind all that were taken before it: the furthest end of the earlier ones is carried along
    ends = lambda spans: F.transform(spans, lambda c: -c["less"])

    def taken(spans: Column) -> Column:
        far = running(ends(spans), F.greatest)
        apart = F.filter(spans, lambda c, i: (i == 0) | (c["start"] >= F.get(far, i - 1)))
        return F.transform(apart, lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), (-c["less"]).alias("end")))

    added = F.when(F.size("candidates") > 0, F.array_sort(let(ordered, taken))).otherwise(F.array().cast(SPANS))
    return found.select(F.col("id").alias(id_col), F.array_sort("base").alias("base"), added.cast(SPANS).alias("added"))


def rendered(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["rank"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
