"""The corpus operators as named queries over the driver's tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import html, matroska, packing, preferences, quality, simhash, spieces, suffix, toxicity, urls
from tessera.sources.shipping import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=2)
    return found.select("doc_id", simhash.hex64("fp").alias("fingerprint"), "component_id")


@_query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_report(_table(spark, sf_dir, "documents"), bytes_of=suffix.byte_strings(400))


@_query
def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(_table(spark, sf_dir, "documents"), unit=64)


@_query
def op8_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=2048, end_id=1)


@_query
def op9_sentencepiece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spieces.round_trip(_table(spark, sf_dir, "documents"))


@_query
def op1_toxicity_multiple_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


@_query
def op6_quality_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


#: The rules that op2 applies.
URL_RULES = [urls.Rule("com/", "allow"), urls.Rule("example.com/en/", "block"), urls.Rule("www.example.com/en/", "allow"), urls.Rule("net/es/", "block"), urls.Rule("net/fr/", "block")]


@_query
def op2_url_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, URL_RULES, urls.train(urls.labelled(pages, _table(spark, sf_dir, "labels"))))


@_query
def op3_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


@_query
def op10_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preferences.preferences(preferences.paired(_table(spark, sf_dir, "conversations")), "_pair", "_side")
    return found.select("pair_id", "n_shared", "prompt", "chosen", "rejected", *[F.to_json(f"{s}_spans").alias(f"{s}_spans") for s in ("chosen", "rejected")])


ORACLES["op10_preference_formatting"] = r"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
same AS (SELECT a.pair_id, a.k FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 AND a.k = b.k AND a.role = b.role AND a.text = b.text),
pre AS (SELECT pair_id, count(*) AS n FROM (SELECT pair_id, k, row_number() OVER (PARTITION BY pair_id ORDER BY k) AS r FROM same) WHERE k = r GROUP BY pair_id),
u AS (SELECT t.*, coalesce(pre.n, 0) AS n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS x FROM t LEFT JOIN pre USING (pair_id)),
v AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY pair_id, side, k > n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM u),
s AS (SELECT *, '{"begin":' || CAST(start_at + length(role) + 13 AS BIGINT) || ',"end":' || CAST(start_at + length(x) - 1 AS BIGINT) || '}' AS span FROM v)
SELECT pair_id, CAST(max(n) AS INTEGER) AS n_shared,
    coalesce(string_agg(x, '' ORDER BY k) FILTER (WHERE side = 0 AND k <= n), '') AS prompt,
    coalesce(string_agg(x, '' ORDER BY k) FILTER (WHERE side = 0 AND k > n), '') AS chosen,
    coalesce(string_agg(x, '' ORDER BY k) FILTER (WHERE side = 1 AND k > n), '') AS rejected,
    '[' || coalesce(string_agg(span, ',' ORDER BY k) FILTER (WHERE side = 0 AND k > n AND role = 'assistant'), '') || ']' AS chosen_spans,
    '[' || coalesce(string_agg(span, ',' ORDER BY k) FILTER (WHERE side = 1 AND k > n AND role = 'assistant'), '') || ']' AS rejected_spans
FROM s GROUP BY pair_id
"""
