"""Benchmark decontamination by winnowing, with SQL functions only.

A window is `span` consecutive words of an item (a shorter item is one window of all its words). Its fingerprint is the least
hash of the k-grams in it, k + (k-grams - 1) = span words: any passage of `span` words that a document shares with an item gives
the same fingerprint on both sides, so nothing long enough is missed, and neighbouring windows mostly share one, so few are joined.

1. The items' distinct fingerprints are joined with the documents' distinct fingerprints.
2. In documents that a hit names, every window with such a fingerprint is extended to its words and joined, as text, with the
   items' windows. What is equal is contamination; hits are never decided by hashes. All other documents are read for their number of words alone.

The items' sides, and the documents that a hit names, are broadcast when they have at most BROADCAST_BYTES, which is checked first; beyond that the same
joins shuffle. Documents are joined back by identifier and text hash, so that a repeated identifier never mixes texts.

Defined results: a null or empty text, or one of separators only, has no words and no hits; items without words count for nothing. Items
repeated under one identifier count once; equal items under several identifiers all count. Items whose identifier is null are one item, named by the empty
string. Each row of the input gives one row, also for null or repeated identifiers. An empty benchmark contaminates nothing. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, count_below, cut, let

SPAN, GRAM = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20
#: Fingerprints of a document that are looked through one by one.
FEW = 32


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def positions(n: Column, size: int) -> Column:
    """0-based starts of the runs of `size` among n."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def gram_hashes(tokens: str, k: int) -> Column:
    w = F.col(tokens)
    return F.transform(positions(F.size(w), k), lambda i: F.xxhash64(F.lit(k), *[w[i + j] for j in range(k)]))


def minima(hashes: str, n_words: Column, span: int, k: int) -> Column:
    """The fingerprint of each window of `span` words, by its start."""
    h, many = F.col(hashes), span - k + 1
    return F.transform(positions(n_words, span), lambda i: F.least(*[h[i + j] for j in range(many)]) if many > 1 else h[i])


def with_fingerprints(df: DataFrame, spans: list[int], gram: int) -> tuple[DataFrame, dict[int, str]]:
    """df, which has `words`, with the fingerprints by start for each span."""
    ks = sorted({min(gram, s) for s in spans})
    df = df.select("*", *[gram_hashes("words", k).alias(f"h{k}") for k in ks])
    df = df.select("*", *[minima(f"h{min(gram, s)}", F.size("words"), s, min(gram, s)).alias(f"m{s}") for s in spans])
    return df.drop(*[f"h{k}" for k in ks]), {s: f"m{s}" for s in spans}


def window_text(start: Column, size: int) -> Column:
    return F.array_join(F.slice("words", start + 1, size), " ")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """For each row of docs: id, th (the text's hash), n_words, hits array<int> (0-based word positions), items array<string> (sorted)."""
    if not 0 < gram <= span:
        raise ValueError("0 < gram <= span is needed")
    item_rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    size = item_rows.agg(F.sum(F.octet_length(F.array_join("words", " ")) + 16 * F.size("words")).alias("bytes"), F.collect_set(F.least(F.size("words"), F.lit(span))).alias("spans")).first()
    spans = sorted(size["spans"])
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))
    no_hits = [F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items")]
    if not spans:
        return rows.select(F.col("id").alias(id_col), "th", F.size(words(F.col("text"))).alias("n_words"), *no_hits)
    # a span's windows come to about span times the words
    small = F.broadcast if size["bytes"] * span <= BROADCAST_BYTES else lambda df: df

    prints, by_span = with_fingerprints(item_rows, spans, gram)
    of_span = lambda s: F.least(F.size("words"), F.lit(span)) == s
    item_prints = prints.select(F.explode(F.array_distinct(F.concat(*[F.when(of_span(s), F.col(m)).otherwise(F.array().cast("array<bigint>")) for s, m in by_span.items()]))).alias("print")).distinct()
    windows = cut(_windows(item_rows, spans, of_span))

    doc_prints, by_span = with_fingerprints(rows.select("id", "th", words(F.col("text")).alias("words")), spans, gram)
    met = doc_prints.select("id", "th", F.explode(F.array_distinct(F.concat(*by_span.values()))).alias("print")).join(small(item_prints), "print", "left_semi")
    met = cut(met.groupBy("id", "th").agg(F.array_sort(F.collect_set("print")).alias("prints")))
    bytes_met = met.agg(F.sum(8 * F.size("prints") + 40)).first()[0] or 0
    named = F.broadcast(met) if bytes_met <= BROADCAST_BYTES else met

    both = rows.alias("r").join(named.alias("m"), F.col("r.id").eqNullSafe(F.col("m.id")) & F.col("r.th").eqNullSafe(F.col("m.th"))).select("r.id", "r.th", words(F.col("text")).alias("words"), "prints")
    both, by_span = with_fingerprints(both, spans, gram)
    scanned = cut(both.select("id", "th", F.concat(*[_candidates(s, m) for s, m in by_span.items()]).alias("candidates")))

    seen = scanned.select("id", "th", F.explode("candidates").alias("c")).select("id", "th", "c.start", "c.size", "c.window")
    hits = seen.join(small(windows.select("window").distinct()), "window", "left_semi").groupBy("id", "th").agg(F.collect_set(F.struct("start", "size")).alias("runs"))
    hits = hits.select("id", "th", F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1))))).alias("hits"))
    found = seen.select("id", "th", "window").distinct().join(small(windows), "window").groupBy("id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    counted = rows.select("id", "th", F.size(words(F.col("text"))).alias("n_words"))
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & F.col(f"{a}.th").eqNullSafe(F.col(f"{b}.th"))
    out = counted.alias("s").join(hits.alias("h"), same("s", "h"), "left").join(found.alias("f"), same("s", "f"), "left")
    return out.select(F.col("s.id").alias(id_col), "s.th", "s.n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs without a hit, all columns as they were."""
    hit = decontaminate(docs, items, id_col, text_col, **how).where(F.size("hits") > 0).select(F.col(id_col).alias("__id"), F.col("th").alias("__th"))
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col("__id")) & F.xxhash64(F.col(text_col)).eqNullSafe(F.col("__th")), "left_anti")


def _windows(item_rows: DataFrame, spans: list[int], of_span) -> DataFrame:
    def texts(s: int) -> Column:
        return F.when(of_span(s), F.transform(positions(F.size("words"), s), lambda i: window_text(i, s))).otherwise(F.array().cast("array<string>"))

    return item_rows.select("item", F.explode(F.concat(*map(texts, spans))).alias("window")).distinct()


def _candidates(span: int, column: str) -> Column:
    def has(value: Column) -> Column:  # few are looked through, many searched by halving
        return F.when(F.size("prints") <= FEW, F.array_contains("prints", value)).otherwise(F.coalesce(F.get(F.col("prints"), count_below(F.col("prints"), value)) == value, F.lit(False)))

    starts = let(F.col(column), lambda prints: F.filter(positions(F.size("words"), span), lambda i: let(prints[i], has)))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(span).alias("size"), window_text(i, span).alias("window")))
