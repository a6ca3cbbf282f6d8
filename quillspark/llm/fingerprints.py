"""Document fingerprints from closed syncmers, with SQL functions only.

Tokens are runs of non-blank characters, up to PIECE of them; in longer runs, and in scripts that are written without blanks, each character is a token, so that
none depends on where its run begins. A k-mer of tokens is an anchor if the least hash of its
inner s-mers lies at its first or last place. Whether it does depends on nothing but the k-mer itself, so an edit moves only the anchors
that touch it and equal passages have equal anchors wherever they stand. A text with fewer than k tokens has one anchor: all
of them. A fingerprint is the sorted list of all anchors of a text, whatever its length: each hash, numbered by its places in the text, the first, the second and so
on. Likeness is the Dice coefficient of two fingerprints; what they have in common are the anchors that positional matching pairs, a hash's first place with its first, and so
on. So equal fingerprints are alike (1), and what a fingerprint says is all that its likeness depends on.

Defined results: null is the empty text; a text without tokens has no anchors, and two such texts are alike (1), one and any other text
are not (0). Equal texts have equal fingerprints. Repeated rows are documents of their own, in order of identifier and
text; a null identifier comes first. A table's only document is its own next one. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import let, power

K, S, PIECE = 5, 2, 12
#: Rows that share a bucket when the table is dealt out in order, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 100, 32_768
FIRST = -(1 << 63)
#: Thai, Lao, Myanmar, Khmer, kana and ideographs: scripts without blanks between words.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
#: In a placed anchor: the bit that tells the second text from the first.
SECOND = 1 << 31


def tokens(text: Column) -> Column:
    spaced = rf"[^\s{UNSPACED}]"
    return F.regexp_extract_all(text, F.lit(rf"(?<!{spaced}){spaced}{{1,{PIECE}}}+(?!{spaced})|\S"), F.lit(0))


def with_anchors(df: DataFrame, text: str, name: str, k: int = K, s: int = S) -> DataFrame:
    """df with the anchors of its column `text`, array<struct<at int, hash int>>: the k-mer's place among the tokens, and its hash."""
    w, h = F.col("__tokens"), F.col("__inner")
    starts = lambda size: F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    columns = [c for c in df.columns if c != name]
    df = df.select(*columns, tokens(F.col(text)).alias("__tokens"))
    df = df.select(*columns, "__tokens", F.transform(starts(s), lambda i: F.xxhash64(*[w[i + j] for j in range(s)])).alias("__inner"))
    last = k - s

    def closed(i: Column) -> Column:
        inner = [h[i + j] for j in range(1, last)]
        return F.least(h[i], h[i + last]) <= (F.least(*inner) if len(inner) > 1 else inner[0])

    whole = F.when(F.size(w) > 0, F.array(F.struct(F.lit(0).alias("at"), F.hash(w).alias("hash")))).otherwise(F.array().cast("array<struct<at:int,hash:int>>"))
    found = F.transform(F.filter(starts(k), closed), lambda i: F.struct(i.alias("at"), F.hash(*[w[i + j] for j in range(k)]).alias("hash")))
    return df.select(*columns, F.when(F.size(w) < k, whole).otherwise(found).alias(name))


def placed(anchors: str) -> Column:
    """array<bigint>, sorted: a hash in the upper half, its place in the lower."""
    return F.sort_array(F.transform(anchors, lambda x: F.shiftleft(x["hash"].cast("long"), 32).bitwiseOR(x["at"].cast("long"))))


def numbered(places: str) -> Column:
    """array<bigint>: a hash in the upper half, and in the lower how many of its places come before this one. Two texts' numbered anchors that
    are equal are the matches of place_matches(): a hash's first place with its first, and so on."""
    hash_of = lambda x: F.shiftright(x, 32)

    def counted(hashes: Column) -> Column:
        # by doubling: after round k, how many of up to 2^k - 1 hashes before are the same
        def doubled(now: Column, k: Column) -> Column:
            again = lambda i: F.get(hashes, i - power(k)) == F.get(hashes, i)
            return F.transform(now, lambda v, i: F.when((i >= power(k)) & again(i), power(k) + F.get(now, i - power(k))).otherwise(v))

        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(hashes) + 1)).cast("int"))
        before = F.aggregate(rounds, F.transform(hashes, lambda _: F.lit(0)), doubled)
        several = let(before, lambda n: F.transform(hashes, lambda h, i: F.shiftleft(h, 32).bitwiseOR(F.get(n, i).cast("long"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.transform(hashes, lambda h: F.shiftleft(h, 32))).otherwise(several)

    return let(F.transform(places, hash_of), counted)


def likeness(a: str, b: str) -> Column:
    """Dice coefficient of two sets, such as numbered anchors, or placed ones if only what stands in its place shall count."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * common / (F.size(a) + F.size(b)))


def rendered(anchors: str) -> Column:
    """The text of a fingerprint (numbered anchors): eight digits for each hash, and for its later places their number between two `~` as well."""
    digits = lambda x: F.lpad(F.hex(F.shiftright(x, 32).bitwiseAND(0xFFFFFFFF)), 8, "0")
    number = lambda x: x.bitwiseAND(0xFFFFFFFF)
    return F.array_join(F.transform(anchors, lambda x: F.when(number(x) == 0, digits(x)).otherwise(F.concat(digits(x), F.lit("~"), number(x).cast("string"), F.lit("~")))), "")


def in_order(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """df with a column that deals its rows, in order of key, to buckets of BUCKET_ROWS or so, and the rows that open a bucket a second
    time, as guests at the end of the bucket before. Bounds are quantiles of the whole key column: one small aggregate, no sort."""
    n = df.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    marks = [i / buckets for i in range(buckets)]
    bounds = df.agg(F.percentile_approx(key, marks, 20 * buckets).alias("b"), F.min(key).alias("least")).first() if n else None
    ends = sorted({bounds["least"], *bounds["b"]}) if n else [0]
    wide = max(1, int(len(ends) ** 0.5))
    literal = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    df = df.withColumns({"__ends": literal(ends), "__outer": literal(ends[::wide])})
    outer = F.size(F.filter("__outer", lambda b: b <= F.col(key)))
    df = df.withColumn("__at", (outer - 1) * wide)
    inner = F.size(F.filter(F.slice("__ends", F.col("__at") + 1, wide), lambda b: b <= F.col(key)))
    df = df.withColumn("__bucket", F.col("__at") + inner - 1)
    opens = F.element_at("__ends", F.col("__bucket") + 1) == F.col(key)
    own = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("guest"))
    before = F.struct(F.pmod(F.col("__bucket") - 1, F.lit(len(ends))).alias("bucket"), F.lit(1).alias("guest"))
    df = df.withColumn("__place", F.explode(F.when(opens, F.array(own, before)).otherwise(F.array(own))))
    return df.withColumns({"__bucket": F.col("__place.bucket"), "__guest": F.col("__place.guest")}).drop("__ends", "__outer", "__at", "__place"), "__bucket"


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, places and numbered (its anchors), and next_text and next_numbered of the following document (of the first, for the last)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt, bucket = in_order(rows, "key")
    dealt = with_anchors(dealt.repartition(bucket), "text", "anchors").withColumn("places", placed("anchors")).drop("anchors").withColumn("numbered", numbered("places"))  # the texts alone are shuffled
    order = Window.partitionBy(bucket).orderBy("__guest", "key", "text")
    follows = lambda c: F.lead(c).over(order).alias(f"next_{c}")
    return dealt.select("id", "text", "places", "numbered", "__guest", follows("text"), follows("numbered")).where("__guest = 0").drop("__guest")


def edited(rows: DataFrame) -> DataFrame:
    """rows of with_next() with the edited text: its last quarter replaced by as much of the next text's beginning."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    return rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)))


def place_matches(a: Column, b: Column) -> Column:
    """array<struct<a_at, b_at, hash>> of two columns of placed anchors: the n-th place of a hash in one with its n-th place in the other.

    Both are sorted together, so that a hash's places in a stand in a row and those in b after them."""
    hash_of = lambda x: F.shiftright(x, 32)
    is_second = lambda x: x.bitwiseAND(SECOND) != 0

    def paired(both: Column) -> Column:
        def first_from(least: Column) -> Column:
            step = lambda acc, middle: F.when(F.get(both, middle) < least, F.struct((middle + 1).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), middle.alias("high")))
            halves = F.sequence(F.lit(0), F.ceil(F.log2(F.size(both) + 1)).cast("int"))
            start = F.struct(F.lit(0).alias("low"), F.size(both).alias("high"))
            return F.aggregate(halves, start, lambda acc, _: step(acc, F.shiftright(acc["low"] + acc["high"], 1)), lambda acc: acc["low"])

        def match(x: Column, i: Column) -> Column:
            before, after = F.get(both, i - 1), F.get(both, i + 1)
            again = F.coalesce(hash_of(before) == hash_of(x), F.lit(False)) | F.coalesce((hash_of(after) == hash_of(x)) & ~is_second(after), F.lit(False))
            start = F.shiftleft(hash_of(x), 32)
            partner = F.when(again, first_from(start.bitwiseOR(F.lit(SECOND))) + i - first_from(start)).otherwise(i + 1)
            at = lambda y: y.bitwiseAND(SECOND - 1).cast("int")
            pair = lambda y: F.when((hash_of(y) == hash_of(x)) & is_second(y), F.struct(at(x).alias("a_at"), at(y).alias("b_at"), hash_of(x).cast("int").alias("hash")))
            return F.when(~is_second(x), let(F.get(both, partner), pair))

        return F.filter(F.transform(both, match), lambda m: m.isNotNull())

    return let(F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(SECOND))))), paired)


def positional_matches(a: str, b: str) -> Column:
    """place_matches() of two anchor columns, for aligning the texts."""
    return place_matches(placed(a), placed(b))
