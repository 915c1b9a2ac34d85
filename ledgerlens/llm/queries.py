"""The pN_ queries: each operator over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import addresses, boilerplate, components, digests, leakage, mixing, names, quality, ranking, releases
from ._runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_address_pairs(table(spark, d, "loans"))


def p1_places(spark: SparkSession, d: str) -> DataFrame:
    return addresses.place_members(table(spark, d, "loans"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, d, "press_releases"), letters=False).select(F.col("id").alias("release_id"), "line_no").distinct()


def p2_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.without_repeated_lines(table(spark, d, "press_releases"))


def p2_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Repeated passages cut by content alone, wherever lines end."""
    return boilerplate.without_repeated_chunks(table(spark, d, "press_releases"))


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.net_flow_ranking(table(spark, d, "signals"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return releases.reported_loans(table(spark, d, "press_releases"), table(spark, d, "loans")).select("release_id", "loan_number").distinct()


def p4_confidence(spark: SparkSession, d: str) -> DataFrame:
    return releases.release_matches(table(spark, d, "press_releases"), table(spark, d, "loans"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_name_pairs(table(spark, d, "loans"), table(spark, d, "fraud_cases"), table(spark, d, "press_releases"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.boruvka_groups(table(spark, d, "loan_pairs")).withColumnRenamed("node", "loan_number")


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return digests.certified_percentiles(table(spark, d, "loans").dropDuplicates(["loan_number"]), ["naics_code", "borrower_state"], ["current_approval_amount", "jobs_reported"], QUANTILES)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).where("exact_windows > 0").select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Nearly equal passages too, with their similarity."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(p10_statistics(spark, d)).select("doc_id").distinct()


def queries() -> dict[str, Query]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("p") and k[1].isdigit()}


LINES = """l AS (SELECT DISTINCT id, source, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line_no FROM press_releases WHERE id IS NOT NULL AND body IS NOT NULL),
  k AS (SELECT *, regexp_replace(lower(line), '[^\\p{L}]', '', 'g') AS letters FROM l), n AS (SELECT source, count(DISTINCT id) AS n FROM press_releases GROUP BY 1),
  f AS (SELECT source, letters, count(DISTINCT id) AS d FROM k WHERE letters <> '' GROUP BY 1, 2),
  hit AS (SELECT DISTINCT k.id, k.line_no FROM k JOIN f ON k.letters = f.letters AND k.source IS NOT DISTINCT FROM f.source JOIN n ON n.source IS NOT DISTINCT FROM k.source WHERE d >= 3 AND d >= 0.05 * n.n)"""
WORDS = "list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express on whole tables; the others are held against brute force in the tests."""
    runs = lambda t, i: f"SELECT {i}, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT {i}, w, unnest(range(1, len(w) - 11)) AS p FROM (SELECT {i}, {WORDS.format(c='text')} AS w FROM {t}) WHERE len(w) >= 13)"
    return {
        "p2_found": f"WITH {LINES} SELECT id AS release_id, line_no FROM hit",
        "p2_cleaned": f"""WITH {LINES}, r AS (SELECT DISTINCT id, source, body FROM press_releases), c AS (SELECT id, list(DISTINCT line_no) AS cut FROM hit GROUP BY 1)
          SELECT r.id, r.source, CASE WHEN cut IS NULL THEN body ELSE array_to_string(list_filter(string_split(body, chr(10)), lambda x, i: NOT list_contains(cut, i)), chr(10)) END AS body, CAST(coalesce(len(cut), 0) AS INTEGER) AS lines_cut FROM r LEFT JOIN c ON c.id = r.id""",
        "p3_ranking": """WITH o AS (SELECT loan_number, detector_id, max(score) AS score FROM signals WHERE loan_number IS NOT NULL AND detector_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
          c AS (SELECT detector_id, score, count(*) AS n FROM o GROUP BY 1, 2), t AS (SELECT *, (sum(n) OVER (PARTITION BY detector_id ORDER BY score) - n / 2) / sum(n) OVER (PARTITION BY detector_id) AS x, sum(n) OVER (PARTITION BY detector_id) AS total FROM c),
          f AS (SELECT a.detector_id, a.score, sum(b.n * least(greatest((a.x - b.x - 0.05) / 0.45, 0), 1)) / greatest(any_value(a.total) - 1, 1) AS up, sum(b.n * least(greatest((b.x - a.x - 0.05) / 0.45, 0), 1)) / greatest(any_value(a.total) - 1, 1) AS down FROM t a JOIN t b USING (detector_id) GROUP BY 1, 2),
          s AS (SELECT loan_number, count(*) AS n_scores, round(sum(up) / (SELECT count(DISTINCT detector_id) FROM c), 9) AS plus_flow, round(sum(down) / (SELECT count(DISTINCT detector_id) FROM c), 9) AS minus_flow, round((sum(up) - sum(down)) / (SELECT count(DISTINCT detector_id) FROM c), 9) AS net_flow FROM o JOIN f USING (detector_id, score) GROUP BY 1)
          SELECT *, rank() OVER (ORDER BY net_flow DESC) AS rank FROM s""",
        "p6_found": """WITH RECURSIVE e AS (SELECT DISTINCT loan_a AS a, loan_b AS b FROM loan_pairs WHERE loan_a IS NOT NULL AND loan_b IS NOT NULL AND loan_a <> loan_b), v AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
          c(n, m) AS (SELECT a, a FROM v UNION SELECT v.b, c.m FROM c JOIN v ON v.a = c.n WHERE c.m < v.b) SELECT n AS loan_number, min(m) AS group_id FROM c GROUP BY 1""",
        "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({runs('documents', 'doc_id')}) d JOIN ({runs('eval_items', 'item_id')}) i USING (g)",
    }
