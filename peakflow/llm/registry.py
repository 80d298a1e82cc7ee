"""Queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from . import decontaminate, jaccard, lm_score, main_text, mixing, pii, quality, secrets, token_counts, training_order


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark, sf_dir):
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_main_text(spark, sf_dir):
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op3_training_order(spark, sf_dir):
    return training_order.sequence_report(_table(spark, sf_dir, "documents"))


def op4_secrets(spark, sf_dir):
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op8_lm_score(spark, sf_dir):
    return lm_score.scores(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.components_of(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_private(spark, sf_dir):
    return pii.private_report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_main_text, op3_training_order, op4_secrets, op5_token_counts, op6_mixing, op7_quality, op8_lm_score, op9_jaccard_join, op10_private)}

_SHINGLES = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"""
_SETS = """SELECT {id}, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM (SELECT {id}, """ + _SHINGLES + """ AS w FROM {table})"""

_LEAKS = f"""
WITH d AS (SELECT doc_id, unnest(s) AS x FROM ({_SETS.format(id="doc_id", table="documents")})),
b AS ({_SETS.format(id="item_id", table="benchmark")}),
i AS (SELECT item_id, len(s) AS n_item, unnest(s) AS x FROM b)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n_item)::BIGINT AS n_item, count(*) / any_value(n_item) AS containment
FROM d JOIN i USING (x) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n_item)
"""

_COMPONENTS = f"""
WITH RECURSIVE d AS ({_SETS.format(id="doc_id", table="documents")}),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM d),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, c.component_id
FROM d JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""

ORACLE_SQL = {"op9_jaccard_join": _COMPONENTS, "op1_decontaminate": _LEAKS, "op6_mixing": mixing.ORACLE, "op7_quality": quality.oracle()}
