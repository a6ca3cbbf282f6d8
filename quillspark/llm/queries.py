"""The dealt queries: thin digests over the operators' own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import collocations, decontamination, fingerprints, knn_join, language_id, line_dedup, merkle, ngram_jaccard, pii, secret_scan, sentencepiece_codec, token_counts, warc
from quillspark.llm.common import cut, delete_path, staging_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.components(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedupe(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def encoded_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    out = sentencepiece_codec.encode_decode(docs, model_path or tokenizer_path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"), model_path)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["rank"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(pii.rendered(F.col("base")), 256).alias("base_sha256"),
        pii.rendered(F.array_sort(F.concat("base", "added"))).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """Tokens of every whole document, by line; a token that reaches over a line's end counts for the line of its first character."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    out = token_counts.attribute(docs, vocabulary_path or tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, token_counts.lines(F.col("text")), "first")
    counts = F.transform("counts", lambda x: x.cast("long"))
    return out.select("doc_id", "n_tokens", F.size("counts").cast("long").alias("n_sections"), "n_crossing", F.array_join(counts.cast("array<string>"), ",").alias("section_tokens"), F.array_max(counts).alias("most_in_section"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language_id.learn(docs.where(language_id.fold() != 1))
    out = language_id.predict(docs, learned)
    return out.select("doc_id", F.coalesce(language_id.fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edited(fingerprints.with_next(table(spark, sf_dir, "documents")))
    rows = fingerprints.with_anchors(rows, "edited", "edited_anchors").withColumn("edited_places", fingerprints.placed("edited_anchors"))
    rows = rows.withColumn("edited_numbered", fingerprints.numbered("edited_places"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.rendered("numbered").alias("fingerprint"),
        fingerprints.rendered("edited_numbered").alias("edited_fingerprint"),
        fingerprints.likeness("numbered", "edited_numbered").alias("near_edited"),
        fingerprints.likeness("numbered", "next_numbered").alias("near_next"),
        fingerprints.likeness("places", "edited_places").alias("in_place_edited"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    read = warc.read_archive(spark, path, payloads=False)
    out = cut(read.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "complete"))
    delete_path(spark, path)
    return out


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["rank"] == secret_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(secret_scan.rendered(F.col("base")), 256).alias("base_sha256"),
        secret_scan.rendered(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents")).withColumnRenamed("grp", "lang")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = merkle.manifest(docs, also={"tampered": merkle.tampered_leaf()})
    folded = out.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("lefts"), F.col("rights")))
    proof = merkle.proof_digest(F.col("lefts"), F.col("rights"))
    return folded.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii": op5_pii,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_fingerprints": op8_fingerprints,
    "op9_warc": op9_warc,
    "op10_secrets": op10_secrets,
    "op11_topk_search": op11_topk_search,
    "op12_collocations": op12_collocations,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (select distinct doc_id, array_to_string(words[i:i + 4], ' ') as shingle from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
r(node, comp) as (select doc_id, doc_id from documents union select l.b, r.comp from r join l on r.node = l.a),
k as (select a, count(*) as links from l group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.comp) as component_id, coalesce(k.links, 0)::bigint as n_links
from documents d left join n on n.doc_id = d.doc_id join r on r.node = d.doc_id left join k on k.a = d.doc_id group by d.doc_id, n.n, k.links
""",
    "op2_decontamination": r"""
with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from benchmark),
iw as (select distinct item_id, len(words[i:i + 9]) as span, array_to_string(words[i:i + 9], ' ') as win from (select item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from b where len(words) > 0)),
spans as (select distinct span from iw),
dw as (select doc_id, i, span, array_to_string(words[i:i + span - 1], ' ') as win from (select doc_id, words, span, unnest(range(1, len(words) - span + 2)) as i from w, spans where len(words) >= span)),
h as (select dw.doc_id, dw.i, dw.span, iw.item_id from dw join iw on dw.win = iw.win and dw.span = iw.span),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + span)) as p from (select distinct doc_id, i, span from h)) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join n on n.doc_id = w.doc_id left join t on t.doc_id = w.doc_id
""",
    "op3_line_dedup": r"""
with l as (select doc_id, i, lines[i] as line, trim(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key
    from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))),
k as (select key, min(doc_id) as first from l where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select l.doc_id, l.i, l.line, k.first is null or k.first = l.doc_id as stays from l left join k on l.key = k.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where not stays)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where stays), '')) as kept_sha256
from m group by doc_id
""",
    "op9_warc": r"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as n, sha1(payload) as digest from p),
r as (select digest, max(page_id) as response from d where n >= 1000 group by digest)
select d.page_id, n::bigint as payload_bytes, d.digest as payload_digest, case when response is null or response = page_id then 'response' else 'revisit' end as record_type,
    case when response <> page_id then response end as refers_to, true as complete
from d left join r on r.digest = d.digest
""",
    "op11_topk_search": r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i]))::bigint as score from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s qualify rank <= 5
""",
    "op12_collocations": r"""
with p as (select doc_id, coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as words from p),
g as (select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase from (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from w, (select unnest([1, 2, 3, 4]) as k) where len(words) >= k)),
f as materialized (select lang, k, phrase, count(*) as f, string_split(phrase, ' ') as words from g group by all having count(*) >= 30),
n as (select lang, sum(len(words)) as n from w group by lang),
cuts as (select lang, k, phrase, words, f as a, unnest(range(1, k)) as j from f where k >= 2),
s as (select c.*, x.f as l, y.f as r, (2000000::hugeint * a) // (x.f + y.f) as score from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(c.words[1:j], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.words[j + 1:], ' ')),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
part as (select lang, k, f, array_to_string(words[i:i + m - 1], ' ') as phrase from (select lang, k, f, words, m, unnest(range(1, k - m + 2)) as i from f, (select unnest([2, 3]) as m) where k > m)),
longer as (select lang, phrase, max(f) as most from part group by all),
kept as (select b.* from best b left join longer o on o.lang = b.lang and o.phrase = b.phrase where most is null or 100 * most < 80 * a)
select kept.lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n.n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) kept join n on n.lang = kept.lang where rank <= 2000
""",
    "op13_merkle": r"""
with recursive d as (select doc_id, lang, case when lang is null then '' else '.' || lang end as grp,
    [case when doc_id is null then '-' else length(doc_id::varchar) || ':' || doc_id end, case when source is null then '-' else strlen(source) || ':' || source end, case when lang is null then '-' else strlen(lang) || ':' || lang end] as before,
    case when text is null then '-' else strlen(text) || ':' || text end as after, n_chars, n_chars + 1 as more,
    [4294967295] || flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(doc_id::varchar, '')]) as steps from documents),
h as (select *, sha256(array_to_string(before, '') || case when n_chars is null then '-' else length(n_chars::varchar) || ':' || n_chars end || after) as leaf,
    sha256(array_to_string(before, '') || case when more is null then '-' else length(more::varchar) || ':' || more end || after) as raised,
    xor(list_reduce(steps, lambda c, x: case when x >= 0 then xor(c, x::bigint) else xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end) end), 4294967295) as crc from d),
l as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as idx from h),
t(grp, lvl, idx, hash) as (select grp, 0, idx, leaf from l union all
    select grp, lvl + 1, idx // 2, sha256(string_agg(hash, '' order by idx)) from (select *, count(*) over (partition by grp) as n from t) where n > 1 group by grp, lvl, idx // 2),
top as (select grp, max(lvl) as height from t group by grp),
sub as (select t.grp, t.hash as subroot, row_number() over (order by t.grp) - 1 as idx from t join top on t.grp = top.grp and t.lvl = top.height),
u(lvl, idx, hash) as (select 0, idx, subroot from sub union all
    select lvl + 1, idx // 2, sha256(string_agg(hash, '' order by idx)) from (select *, count(*) over () as n from u) where n > 1 group by lvl, idx // 2),
r as (select hash as root from u order by lvl desc limit 1),
sib as (select l.grp, l.idx, t.lvl, case when t.idx < l.idx >> t.lvl then 'L' else 'R' end as side, t.hash from l join t on t.grp = l.grp and t.idx = xor(l.idx >> t.lvl, 1) join top on top.grp = l.grp where t.lvl < top.height),
alone as (select l.grp, l.idx, s.lvl from l join top on top.grp = l.grp, lateral (select unnest(range(0, top.height)) as lvl) s),
low as (select a.grp, a.idx, a.lvl, coalesce(side, 'N') as side, coalesce(hash, '') as hash from alone a left join sib on sib.grp = a.grp and sib.idx = a.idx and sib.lvl = a.lvl),
high as (select sub.grp, w.lvl, case when v.idx is null then 'N' when v.idx < sub.idx >> w.lvl then 'L' else 'R' end as side, coalesce(v.hash, '') as hash
    from sub, lateral (select unnest(range(0, (select max(lvl) from u))) as lvl) w left join u v on v.lvl = w.lvl and v.idx = xor(sub.idx >> w.lvl, 1)),
p as (select grp, idx, 0 as part, lvl, side, hash from low union all select l.grp, l.idx, 1, high.lvl, side, hash from l join high on high.grp = l.grp),
q as (select grp, idx, list(side || hash order by part, lvl) as proof from p group by grp, idx),
z as (select l.*, subroot, root, coalesce(q.proof, []) as proof from l join sub on sub.grp = l.grp cross join r left join q on q.grp = l.grp and q.idx = l.idx),
f as (select *, list_reduce([case when crc % 7 = 0 then raised else leaf end] || proof, lambda a, x: sha256(case x[1] when 'L' then x[2:] || a when 'R' then a || x[2:] else a end)) as folded_root from z)
select doc_id, leaf, subroot, root, sha256(array_to_string([x[2:] for x in proof], '')) as proof_sha256, folded_root, folded_root = root as verified from f
""",
}
