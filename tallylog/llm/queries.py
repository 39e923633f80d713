"""Queries of the operators for text corpora (p6 to p8), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallylog.llm import bpe, leakage, spans
from tallylog.sources.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), max_edits=1)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p8_groups(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_groups(table(spark, d, "documents"))


QUERIES = {"p6_ids": p6_ids, "p7_found": p7_found, "p7_near": p7_near, "p8_found": p8_found, "p8_groups": p8_groups}

_WORDS = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w))"
_GRAMS = "unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i : i + 11], ' ')))"

SQL: dict[str, str] = {
    "p7_found": f"""
        with d as (select doc_id, {_WORDS.format("text")} as ws from documents),
        i as (select item_id, {_WORDS.format("passage")} as ws from eval_items),
        dg as (select doc_id, {_GRAMS} as gram from d where len(ws) >= 12),
        ig as (select item_id, {_GRAMS} as gram from i where len(ws) >= 12)
        select distinct doc_id, item_id from dg join ig using (gram)""",
    "p8_groups": """
        with recursive d as (select doc_id, text, unnest(range(1, length(text) - 198)) as s from documents where length(text) >= 200),
        w as (select distinct doc_id, substring(text, s, 200) as stretch from d),
        m as (select stretch, min(doc_id) as low from w group by stretch having min(doc_id) < max(doc_id)),
        e as (select distinct doc_id as a, low as b from w join m using (stretch)),
        n as (select a, b from e union select b, a from e),
        r as (select a as node, a as seen from n union select r.node, n.b from r join n on n.a = r.seen)
        select node as doc_id, min(seen) as group_id from r group by node""",
    "p8_found": """
        with d as (select doc_id, text, unnest(range(1, length(text) - 198)) as s from documents where length(text) >= 200),
        w as (select doc_id, s, substring(text, s, 200) as stretch from d),
        shared as (select stretch from w group by stretch having min(doc_id) < max(doc_id)),
        hits as (select doc_id, s, lead(s) over (partition by doc_id order by s) as t from w semi join shared using (stretch))
        select doc_id, cast(sum(least(200, coalesce(t - s, 200))) as bigint) as shared_chars from hits group by doc_id""",
}
