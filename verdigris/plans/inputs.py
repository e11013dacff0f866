"""Gold and predicted answers made from the tables by rule, in SQL that Spark and other engines read alike.

``[[b|expr|salt]]`` is a hash bucket from 0 to 99; each engine spells it its own way.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CLASSES = r"""
SELECT doc_id, n_chars % 2 = 0 AS even, lang AS gold_lang,
       CASE WHEN n_chars % 2 = 0 THEN 'true' ELSE 'false' END AS gold_flag,
       CASE WHEN f < 8 THEN 'N/A' WHEN f < 20 THEN CASE WHEN n_chars % 2 = 0 THEN 'No' ELSE 'yes' END WHEN f < 30 THEN CASE WHEN n_chars % 2 = 0 THEN ' Yes ' ELSE 'F' END
            WHEN f < 35 THEN 'probably' ELSE CASE WHEN n_chars % 2 = 0 THEN 'TRUE' ELSE 'false' END END AS pred_flag,
       CASE WHEN g < 8 THEN 'not stated' WHEN g < 12 THEN 'Klingon' WHEN g < 20 THEN 'en' WHEN g < 35 THEN upper(lang)
            WHEN g < 45 THEN CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'Deutsch' WHEN 'fr' THEN 'French' ELSE 'Spanish' END
            WHEN g < 55 THEN concat(substr(lang, 1, 1), '.', substr(lang, 2, 1), '.') ELSE lang END AS pred_lang,
       concat('ORD-', CAST(doc_id AS STRING)) AS gold_number,
       CASE WHEN h < 8 THEN '--' WHEN h < 16 THEN concat('ORD-', CAST(doc_id + 1 AS STRING)) WHEN h < 30 THEN concat('"ord-', CAST(doc_id AS STRING), '"')
            WHEN h < 45 THEN concat('  ORD-', CAST(doc_id AS STRING), '  ') ELSE concat('ORD-', CAST(doc_id AS STRING)) END AS pred_number,
       CASE WHEN h < 97 THEN true ELSE false END AS ok
FROM (SELECT doc_id, n_chars, lang, [[b|doc_id|flag]] AS f, [[b|doc_id|lang]] AS g, [[b|doc_id|number]] AS h FROM documents)
"""
NAMES = r"""
SELECT p_partkey AS id, concat(p_name, ' ', p_type, ' Inc') AS gold,
       CASE WHEN b < 8 THEN 'n/a' WHEN b < 20 THEN concat(p_type, ' ', p_name, ', L.L.C.') WHEN b < 30 THEN concat('The ', p_name, '  ', p_type, ' Co.')
            WHEN b < 45 THEN concat(substr(p_name, 1, length(p_name) - 2), ' ', p_type, ' Corp') WHEN b < 52 THEN 'Acme & Sons' ELSE concat(p_name, ' ', p_type, ' Inc') END AS pred
FROM (SELECT *, [[b|p_partkey|name]] AS b FROM part)
"""
PEOPLE = r"""
SELECT c_custkey AS id,
       CASE WHEN b < 10 THEN 'none' WHEN b < 35 THEN concat('Dr. ', c_name, ', Ph.D.') WHEN b < 55 THEN concat('MR ', c_name, ' Jr.') WHEN b < 70 THEN concat(c_name, ' Esq') ELSE replace(c_name, '#', ' - ') END AS name
FROM (SELECT *, [[b|c_custkey|person]] AS b FROM customer)
"""
AMOUNTS = r"""
SELECT o_orderkey AS id, k,
       concat('$', CAST(k AS STRING)) AS gold,
       CASE WHEN b < 8 THEN 'not found' WHEN b < 20 THEN concat('USD ', CAST(k + 500 AS STRING)) WHEN b < 30 THEN concat(CAST(k AS STRING), ' dollars') WHEN b < 40 THEN concat('(', CAST(k AS STRING), ')')
            WHEN b < 50 THEN concat(CAST(k AS STRING), ' EUR') WHEN b < 55 THEN 'several' WHEN b < 65 THEN concat('US$ ', CAST(k // 1000 AS STRING), ' thousand') ELSE concat(CAST(k AS STRING), ' USD') END AS pred
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS k, [[b|o_orderkey|amount]] AS b FROM orders)
"""
DATES = r"""
SELECT id, iso AS gold,
       CASE WHEN b < 8 THEN 'unspecified' WHEN b < 20 THEN concat(substr(iso, 1, 8), '01') WHEN b < 30 THEN substr(iso, 1, 7) WHEN b < 38 THEN substr(iso, 1, 4)
            WHEN b < 55 THEN concat(substr(iso, 6, 2), '/', substr(iso, 9, 2), '/', substr(iso, 1, 4)) WHEN b < 60 THEN 'whenever' WHEN b < 68 THEN concat('march ', substr(iso, 1, 4)) ELSE iso END AS pred
FROM (SELECT o_orderkey AS id, substr(CAST(o_orderdate AS STRING), 1, 10) AS iso, [[b|o_orderkey|date]] AS b FROM orders)
"""
EVENTS = r"""
SELECT user_id, event_type, [[b|concat(CAST(user_id AS STRING), event_type)|set]] AS b FROM (SELECT DISTINCT user_id, event_type FROM events)
"""
ITEMS = r"""
SELECT l_orderkey, l_linenumber, p_name, [[b|concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))|item]] AS b
FROM lineitem JOIN part ON p_partkey = l_partkey
"""
SPANS = r"""
SELECT doc_id AS id, CAST(a AS INT) AS gold_start, CAST(a + 40 + doc_id % 60 AS INT) AS gold_stop,
       CASE WHEN b < 10 THEN NULL ELSE CAST(a + CASE WHEN b < 40 THEN b % 30 ELSE 0 END AS INT) END AS pred_start,
       CASE WHEN b < 10 THEN NULL WHEN b < 15 THEN CAST(a - 5 AS INT) ELSE CAST(a + 40 + doc_id % 60 + CASE WHEN b < 60 THEN b % 20 ELSE 0 END AS INT) END AS pred_stop
FROM (SELECT doc_id, n_chars % 200 AS a, [[b|doc_id|span]] AS b FROM documents)
"""
_BUCKET = re.compile(r"\[\[b\|(.+?)\|(\w+)\]\]")


def spelled(sql: str, engine: str = "duckdb") -> str:
    """The SQL with buckets, and whole-number division, as an engine spells them."""
    if engine == "spark":
        sql = _BUCKET.sub(lambda m: f"(CAST(conv(substr(md5(concat(CAST({m[1]} AS STRING), ':{m[2]}')), 1, 8), 16, 10) AS BIGINT) % 100)", sql)
        return sql.replace(" // ", " div ")
    return _BUCKET.sub(lambda m: f"(CAST(concat('0x', substr(md5(concat(CAST({m[1]} AS STRING), ':{m[2]}')), 1, 8)) AS BIGINT) % 100)", sql)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above over the tables of a folder."""
    text = spelled(sql, "spark")
    for name in ("documents", "part", "customer", "orders", "events", "lineitem"):
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **used)
