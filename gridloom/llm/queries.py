"""The registered queries of the training-data operators, and the SQL that some equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, exact, html, quality, shards, simhash, substrings, urls, warc
from .common import Workspace, table

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, RULES, urls.fit_on(pages, rules=RULES))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.Quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).decisions()


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "token-shards").path
    return shards.write_shards(table(spark, sf_dir, "documents"), path, RANKS, public_tokenizers.PATTERN).drop("file")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "warc").path
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, payload="verify").select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_exact_dedup, op3_url_filter, op4_quality, op5_decontamination, op6_html_text, op7_token_shards, op8_substrings, op9_simhash, op10_warc, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": r"""
with d as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents)
select doc_id, first(doc_id) over (partition by t order by chars desc, doc_id) as keep_id,
       count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by chars desc, doc_id) = 1 as kept, sha256(t) as text_sha256 from d""",
        "op8_substrings": r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as l from documents),
s as (select doc_id, unnest(range(1, len(l) - 33)) as a, l from w),
k as (select doc_id, a, array_to_string(l[a:a + 34], ' ') as p from s),
r as (select doc_id, a from k where p in (select p from k group by p having count(*) > 1)),
c as (select doc_id, list_distinct(flatten(list(range(a, a + 35)))) as gone from r group by doc_id),
o as (select w.doc_id, len(l) as n, l, coalesce(gone, []) as gone from w left join c using (doc_id))
select doc_id, n::bigint as n_words, len(gone)::bigint as n_removed,
       sha256(array_to_string(coalesce(list_transform(list_filter(range(1, n + 1), lambda i: not list_contains(gone, i)), lambda i: l[i]), []), ' ')) as kept_sha256 from o""",
        "op10_warc": r"""
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select page_id, strlen(h) as n, sha1(h) as x, min(page_id) over (partition by h) as first_id from p)
select page_id, n::bigint as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to from f""",
    }
