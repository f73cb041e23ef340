"""Queries of the language-model data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotara.llm import garbled, neighbours, packing, sentences, spans, tokenizer
from annotara.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of every document, with their places."""
    return sentences.split(table(spark, d, "documents"), "doc_id", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and series whose text or summary holds a garbled stretch."""
    docs = garbled.found(table(spark, d, "documents"), "doc_id", "text").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_key"))
    geo = garbled.found(table(spark, d, "geo_series"), "row_no", "summary").select(F.lit("geo_series").alias("tbl"), F.col("row_no").alias("row_key"))
    return docs.unionByName(geo)


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """The restored texts of the garbled rows."""
    docs = garbled.restored(table(spark, d, "documents"), "doc_id", "text").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_key"), "restored", "whole")
    geo = garbled.restored(table(spark, d, "geo_series"), "row_no", "summary").select(F.lit("geo_series").alias("tbl"), F.col("row_no").alias("row_key"), "restored", "whole")
    return docs.unionByName(geo)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of words of which one is among the 10 nearest of the other."""
    return neighbours.pairs(neighbours.neighbours(table(spark, d, "w2v_cache"), "idx", "w2v_weights"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The byte_bpe_50k ids of every document."""
    return tokenizer.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The texts decoded again from their ids, streamed through the UTF-8 automaton."""
    return tokenizer.round_trip(p7_ids(spark, d), "doc_id")


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each capacity of pack_sizes."""
    sizes = cut(tokenizer.lengths(table(spark, d, "documents"), "doc_id", "text"))
    return packing.pack(sizes, table(spark, d, "pack_sizes"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The runs of every document that stand in another one too."""
    return spans.shared_spans(table(spark, d, "documents"), "doc_id", "text")


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of every document stands elsewhere too."""
    docs = table(spark, d, "documents")
    return spans.shared_share(docs, "doc_id", "text", p9_found(spark, d))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip, "p8_packs": p8_packs, "p9_found": p9_found, "p9_share": p9_share}

_RUNS = """w as (select doc_id, i, substr(text, i + 1, 200) as s from (select doc_id, text, unnest(range(length(text) - 199)) as i from documents where length(text) >= 200)),
twice as (select s from w group by 1 having min(doc_id) < max(doc_id)), h as (select doc_id, i from w semi join twice using (s)),
g as (select doc_id, i, sum(n) over (partition by doc_id order by i) as run from (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 200 then 1 else 0 end as n from h)),
runs as (select doc_id, min(i) as span_start, max(i) + 200 as span_end from g group by doc_id, run)"""

SQL = {
    "p5_found": """with v as (select idx, w2v_weights as x from w2v_cache where len(w2v_weights) = 64 and not list_bool_or(list_transform(w2v_weights, lambda z: z is null or isnan(z))) and list_bool_or(list_transform(w2v_weights, lambda z: z <> 0))),
n as (select a.idx as i, b.idx as j, row_number() over (partition by a.idx order by list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), b.idx) as r from v a, v b where a.idx <> b.idx)
select distinct least(i, j) as idx_a, greatest(i, j) as idx_b from n where r <= 10""",
    "p7_roundtrip": "select doc_id, coalesce(text, '') as text from documents",
    "p9_found": f"with {_RUNS} select * from runs",
    "p9_share": f"with {_RUNS}, s as (select doc_id, sum(span_end - span_start)::bigint as n from runs group by 1) select doc_id, coalesce(length(text), 0) as n_chars, coalesce(n, 0) as n_shared, coalesce(n / nullif(length(text), 0)::double, 0) as share from documents left join s using (doc_id)",
}
