"""The corpus operators applied to their whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, langid, minmax, mixing, quality, repair, sharding, suffix, training_order, urls, warc
from .common import table
from .sql import OP11


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).select("doc.doc_id", "lang_pred", "score", "n_words").withColumn("held_out", held_out)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(table(spark, sf_dir, "documents"))


def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = minmax.near_duplicates(docs, shingle=3, percent=85)
    return found.select("doc.doc_id", "n_shingles", "component_id", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.documents.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = training_order.materialise(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern(), end=50256)
    rows = training_order.read_shards(spark, shards)
    return rows.select("slot", "shard", "doc_id", "seq_no", "n_tokens", F.crc32("tokens").alias("tokens_crc32"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = warc.archived(table(spark, sf_dir, "pages"))
    number = lambda column: F.regexp_extract(column, "<urn:x-page:(-?[0-9]+)>", 1).try_cast("bigint")
    return rows.where("last").select(
        number("record_id").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
        "record_type", F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"),
    )


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.byte_shards(table(spark, sf_dir, "documents"), 16)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(rows, repair.damaged(rows))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_pattern(), tokenizer_path("piece_bpe_32k.model"))


# The rules of the URL query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.fit(urls.labelled_by(pages, RULES))
    return urls.judge(pages, model, RULES).select("row.page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_quality, op3_minmax_dedup, op4_mixing, op5_training_order, op6_suffix_dedup, op7_warc,
        op8_ann, op9_bpe, op10_sharding, op11_conversation_repair, op12_alignment, op13_url_filter,
    )
}

_N = ", ".join(f"({n})" for n in quality.REPEATED)
_DUP = ", ".join(f"coalesce(sum(len) filter (where n = {n}), 0)::bigint dup_chars_{n}" for n in quality.REPEATED)
_OVER = " or ".join(f"100 * coalesce(dup_chars_{n}, 0) > {most} * word_chars" for n, most in quality.REPEATED.items())
_OUT = ", ".join(f"coalesce(dup_chars_{n}, 0) dup_chars_{n}" for n in quality.REPEATED)

OP2 = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from d),
g as (
  select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as gram
  from (select doc_id, ws, generate_subscripts(ws, 1) as i from d), (values {_N}) as t(n) where i + n - 1 <= len(ws)),
r as (
  select doc_id, n, i, count(*) over (partition by doc_id, n, gram) as times, row_number() over (partition by doc_id, n, gram order by i) as nth from g),
c as (
  select distinct r.doc_id, n, r.i + k.k as i, false as first_too from r, generate_series(0, 9) as k(k) where nth > 1 and k.k < n
  union all
  select distinct r.doc_id, n, r.i + k.k as i, true from r, generate_series(0, 4) as k(k) where times > 1 and n = 5),
l as (select c.*, length(word) as len from c join w on c.doc_id = w.doc_id and c.i = w.i),
s as (select doc_id, {_DUP} from l where not first_too group by doc_id),
q as (select doc_id, count(*) as n_repeat_words from l where first_too group by doc_id),
lines as (
  select doc_id, line, row_number() over (partition by doc_id, line order by no) as nth
  from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as no from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
n as (
  select doc_id, count(*) as n_lines, count(*) filter (where nth > 1) as n_dup_lines, sum(length(line)) as line_chars,
    coalesce(sum(length(line)) filter (where nth > 1), 0) as dup_line_chars
  from lines group by doc_id),
b as (
  select doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(n_lines, 0)::bigint as n_lines, coalesce(line_chars, 0)::bigint as line_chars, coalesce(dup_line_chars, 0)::bigint as dup_line_chars, {_OUT}
  from d left join s using (doc_id) left join q using (doc_id) left join n using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b)
select *, not (base_failed or {_OVER} or 100 * n_dup_lines > {quality.LINES} * n_lines or 100 * dup_line_chars > {quality.LINE_CHARS} * line_chars) as kept
from f
"""

OP7 = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
g as (select *, max(page_id) over (partition by html) as response from p)
select page_id, n::bigint as payload_bytes, sha1(html) as payload_digest,
  case when n >= 1000 and page_id < response then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < response then response end as refers_to
from g
"""

ORACLES: dict[str, str] = {"op2_quality": OP2, "op7_warc": OP7, "op11_conversation_repair": OP11}
