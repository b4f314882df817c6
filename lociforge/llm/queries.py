"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.llm.automata import without_repeats
from lociforge.llm.decontam import contamination_table
from lociforge.llm.divergence import divergences
from lociforge.llm.html import main_text
from lociforge.llm.negatives import hard_negatives
from lociforge.llm.packing import packed
from lociforge.llm.pii import pii_table
from lociforge.llm.planes import read_documents, write_planes
from lociforge.llm.quality import quality_table
from lociforge.llm.sentencepiece import encoded
from lociforge.llm.shared import new_folder, table
from lociforge.llm.simhash import as_hex, near_duplicates
from lociforge.llm.suffixes import deduplicated
from lociforge.llm.tokencount import document_counts, with_streams


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), ids=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_table(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("quality", 6).alias("quality"),
    )


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_streams(table(spark, sf_dir, "documents"))
    return document_counts(docs, new_folder(spark, "stream"), tokenizer_file("word_bpe_49k.json"), 49_407).select("doc_id", "n_tokens")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "planes")
    write_planes(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return read_documents(spark, path)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = main_text(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_table(table(spark, sf_dir, "documents"))


def op7_automata_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept", "n_spans")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=1).drop("cost")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", own)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_token_files, op4_html_text, op5_simhash, op6_pii, op7_automata_dedup, op8_decontamination, op9_sentencepiece, op10_quality_rules, op11_source_divergence, op12_packing, op13_hard_negatives)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_REMOVED = """
least as (select w, min(doc_id) as first from windows group by w),
again as (select doc_id, p from windows join least using (w) where doc_id > first),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as p from again)"""

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": rf"""
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
parts as (select doc_id, n, s, substr(h, 2 * s + 1, 1122) as g from (select *, unnest(range(0, n, 512)) as s from docs)),
windows as (select doc_id, s + o as p, substr(g, 2 * o + 1, 100) as w from (select *, unnest(range(0, least(512, n - 49 - s))) as o from parts)),
{_REMOVED},
bytes as (select doc_id, s + o as p, substr(g, 2 * o + 1, 2) as b from (select *, unnest(range(0, least(512, n - s))) as o from parts)),
kept as (select doc_id, string_agg(b, '' order by p) as k from bytes anti join gone using (doc_id, p) group by doc_id),
runs as (select g.doc_id, count(*) as n_removed, count(*) filter (where q.p is null) as n_spans from gone g left join gone q on q.doc_id = g.doc_id and q.p = g.p - 1 group by g.doc_id)
select d.doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, ''))) as kept_sha256
from docs d left join runs r on d.doc_id = r.doc_id left join kept k on d.doc_id = k.doc_id""",
    "op7_automata_dedup": rf"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as t from documents),
windows as (select doc_id, p, array_to_string(t[p + 1 : p + 50], ' ') as w from (select *, unnest(range(0, len(t) - 49)) as p from docs)),
{_REMOVED},
words as (select doc_id, p, t[p + 1] as b from (select *, unnest(range(0, len(t))) as p from docs)),
kept as (select doc_id, string_agg(b, ' ' order by p) as k from words anti join gone using (doc_id, p) group by doc_id),
runs as (select doc_id, count(*) as n_removed from gone group by doc_id)
select d.doc_id, len(t) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from docs d left join runs r on d.doc_id = r.doc_id left join kept k on d.doc_id = k.doc_id""",
    "op8_decontamination": rf"""
with docs as (select doc_id, {_FOLDED} as t from documents),
items as (select item_id::varchar as item, {_FOLDED} as t from benchmark where item_id is not null),
windows as (select distinct item, len(w) as n, array_to_string(w, ' ') as w from (select item, t[p + 1 : p + 10] as w from (select *, unnest(range(0, greatest(len(t) - 9, 1))) as p from items where len(t) > 0))),
sizes as (select distinct n from windows),
places as (select doc_id, p, n, array_to_string(t[p + 1 : p + n], ' ') as w from (select *, unnest(range(0, len(t) - n + 1)) as p from docs, sizes)),
hits as (select distinct doc_id, p, n, item from places join windows using (n, w)),
words as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(p, p + n)) from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(t) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join words w on d.doc_id = w.doc_id left join found f on d.doc_id = f.doc_id""",
    "op11_source_divergence": rf"""
with docs as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
words as (select d, lang, source, unnest(t) as term from docs),
vocabulary as (select lang, term, count(*)::hugeint as n from words group by lang, term having count(distinct d) >= 3),
langs as (select lang, coalesce(sum(n), 0)::hugeint as total, count(term)::hugeint as v from (select distinct lang from docs) left join vocabulary using (lang) group by lang),
owns as (select lang, source, term, count(*)::hugeint as n from words semi join vocabulary using (lang, term) group by lang, source, term),
groups as (select lang, source, coalesce(sum(n), 0)::hugeint as total from (select distinct lang, source from docs) left join owns using (lang, source) group by lang, source),
shares as (select g.lang, g.source, t.term, coalesce(o.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(o.n, 0) + 1)) // (g.total + l.v) as p, 1 + (1000000000::hugeint * (t.n + 1)) // (l.total + l.v) as q
    from groups g join langs l using (lang) join vocabulary t using (lang) left join owns o on o.lang = g.lang and o.source = g.source and o.term = t.term),
sums as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, term as item, ((p - q) * (p - q)) // q as value from shares where n > 0 and p > q)
select lang, source, 'pair' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 200""",
    "op13_hard_negatives": """
with own as (select row_number() over (order by vec_id) as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select a.r as a, a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
    from own a join own b on a.r <> b.r where a.vec_id % 100 = 0),
positives as (select * from (select *, row_number() over (partition by a order by score desc, other_id) as k from scores where same) where k <= 5),
negatives as (select p.anchor_id, p.other_id as positive_id, n.other_id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.a, p.k order by n.score desc, n.other_id)::int as rank
    from positives p join scores n on n.a = p.a where not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negatives where rank <= 10""",
}
