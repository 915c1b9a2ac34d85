"""The core queries in SQL, written from their definitions, for a run beside Spark on another engine."""

from __future__ import annotations

from .functions.stats import upper_tail_sql
from .functions.text import NAME_STOP_WORDS as STOP

CAP = "(CASE WHEN naics_code LIKE '72%' THEN 29166.67 ELSE 20833.33 END)"
TOKENS = "list_filter(string_split(regexp_replace(upper(coalesce({c}, '')), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ('INC','INCORPORATED','LLC','LLP','LP','LTD','CO','COMPANY','CORP','CORPORATION','PLLC','PLC','PC','PA','DBA','THE','AND','OF'))"
STREET = (
    "array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(upper({c}), '\\b(?:SUITE|STE|UNIT|APT|APARTMENT)\\b\\.?\\s*#?\\s*[\\w-]+', ' ', 'g'), '#\\s*[\\w-]+', ' ', 'g'), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: w <> ''), "
    "lambda w: CASE w WHEN 'STREET' THEN 'ST' WHEN 'AVENUE' THEN 'AVE' WHEN 'ROAD' THEN 'RD' WHEN 'BOULEVARD' THEN 'BLVD' WHEN 'DRIVE' THEN 'DR' WHEN 'LANE' THEN 'LN' WHEN 'COURT' THEN 'CT' WHEN 'PLACE' THEN 'PL' ELSE w END), ' ')"
)


def distinct(*columns: str, extra: str = "") -> str:
    return f"(SELECT DISTINCT loan_number, {', '.join(columns)} FROM loans WHERE loan_number IS NOT NULL){extra}"


def keys() -> str:
    """loan_number, name, building, entity of every loan, as a sub-query."""
    name = f"array_to_string({TOKENS.format(c='borrower_name')}, ' ')"
    town = "trim(regexp_replace(regexp_replace(upper(borrower_city), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"""(SELECT *, CASE WHEN norm_name <> '' AND building_key IS NOT NULL THEN norm_name || ' @ ' || building_key END AS entity_key FROM
      (SELECT *, CASE WHEN street <> '' THEN concat_ws(' | ', street, nullif({town}, ''), nullif(upper(trim(borrower_state)), ''), nullif(substr(trim(borrower_zip), 1, 5), '')) END AS building_key FROM
        (SELECT *, {name} AS norm_name, {STREET.format(c='borrower_address')} AS street FROM {distinct('borrower_name', 'borrower_address', 'borrower_city', 'borrower_state', 'borrower_zip', 'processing_method', 'current_approval_amount')})))"""


SIGNALS = "(SELECT DISTINCT loan_number, detector_id, score FROM signals WHERE loan_number IS NOT NULL AND detector_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))"
POSITIVES = "(SELECT DISTINCT loan_number FROM fraud_cases WHERE loan_number IS NOT NULL)"
SLICE = "current_approval_amount >= 150000"
USABLE = "jobs_reported >= 1 AND current_approval_amount > 0"
KS = "(VALUES (100), (250), (500), (1000), (2000), (5000)) ks(k)"


def composite(signals: str = SIGNALS) -> str:
    return f"""(SELECT p.*, borrower_name, naics_code, borrower_state AS state, current_approval_amount AS amount, jobs_reported FROM
      (SELECT loan_number, max(pct) + 0.5 * (count(*) - 1) AS composite_score, count(*) AS n_signals, array_to_string(list_sort(list(DISTINCT detector_id)), ',') AS detectors
       FROM (SELECT *, cume_dist() OVER (PARTITION BY detector_id ORDER BY score) AS pct FROM {signals}) GROUP BY 1) p
      LEFT JOIN {distinct('borrower_name', 'naics_code', 'borrower_state', 'current_approval_amount', 'jobs_reported')} l USING (loan_number))"""


def ranking() -> str:
    return f"(SELECT loan_number, row_number() OVER (ORDER BY round_even(composite_score, 9) DESC, loan_number) AS rank FROM {composite()})"


def cohort(size: int = 30, fdr: float = 0.01, least_z: float = 3) -> str:
    z = f"CASE WHEN mad > 0 THEN greatest(0.6744897501960817 * (x - med) / greatest(mad, 0.05), 0) ELSE 0.0 END"
    return f"""WITH b AS (SELECT *, current_approval_amount / jobs_reported AS d, ln(1 + current_approval_amount / jobs_reported) AS x, naics_code || ' | ' || borrower_state AS cohort FROM {distinct('borrower_name', 'naics_code', 'borrower_state', 'current_approval_amount', 'jobs_reported')} WHERE {USABLE} AND naics_code IS NOT NULL AND borrower_state IS NOT NULL),
    c AS (SELECT cohort, count(*) AS cohort_size, median(x) AS med, median(d) AS raw FROM b GROUP BY 1 HAVING count(*) >= {size}),
    m AS (SELECT cohort, median(abs(x - med)) AS mad FROM b JOIN c USING (cohort) GROUP BY 1),
    z AS (SELECT *, {z} AS z FROM b JOIN c USING (cohort) JOIN m USING (cohort)),
    p AS (SELECT *, {upper_tail_sql('z')} AS p FROM z),
    r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw_q FROM p),
    q AS (SELECT *, least(1.0, min(raw_q) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM r)
    SELECT loan_number, round_even(z, 4) AS score, cohort, cohort_size, naics_code, borrower_state AS state, borrower_name, current_approval_amount AS amount, jobs_reported, round_even(d, 2) AS amount_per_job, round_even(raw, 2) AS cohort_median_amount_per_job, round_even(d / raw, 2) AS x_cohort_median, round_even(z, 4) AS robust_z, round_even(p, 6) AS p_value, round_even(q, 6) AS q_value, CAST({fdr} AS DOUBLE) AS fdr_target
    FROM q WHERE q <= {fdr} AND z >= {least_z}"""


def overcount(ratio: float = 4.0) -> str:
    return f"""WITH b AS (SELECT loan_number, substr(trim(borrower_zip), 1, 5) AS zip, substr(trim(naics_code), 1, 6) AS naics_cell FROM {distinct('borrower_zip', 'naics_code')}),
          c AS (SELECT zip, naics_cell, count(*) AS n FROM b WHERE coalesce(zip, '') <> '' AND coalesce(naics_cell, '') <> '' GROUP BY 1, 2), e AS (SELECT substr(trim(zip), 1, 5) AS zip, substr(trim(naics), 1, 6) AS naics_cell, CAST(sum(establishments) AS BIGINT) AS est FROM establishments WHERE establishments IS NOT NULL GROUP BY 1, 2)
          SELECT loan_number, round_even(ln(n / greatest(est, 1)), 4) AS score, zip, naics_cell, 6 AS naics_digits, n AS ppp_loan_count, est AS establishment_count, round_even(n / greatest(est, 1), 4) AS ratio, CAST({ratio} AS DOUBLE) AS min_ratio FROM b JOIN c USING (zip, naics_cell) JOIN e USING (zip, naics_cell) WHERE n / greatest(est, 1) >= {ratio}"""


def lenders(least: int = 100, least_z: float = 3.0) -> str:
    return f"""WITH b AS (SELECT loan_number, originating_lender, CASE WHEN current_approval_amount / jobs_reported >= CAST({CAP} AS DOUBLE) THEN 1 ELSE 0 END AS bust FROM {distinct('originating_lender', 'naics_code', 'current_approval_amount', 'jobs_reported')} WHERE {USABLE} AND coalesce(originating_lender, '') <> ''),
          k AS (SELECT originating_lender, count(*) AS n, CAST(sum(bust) AS BIGINT) AS s, sum(bust) / count(*) AS rate FROM b GROUP BY 1 HAVING count(*) >= {least}), m AS (SELECT median(rate) AS med FROM k), d AS (SELECT median(abs(rate - med)) AS mad FROM k, m),
          z AS (SELECT k.*, CASE WHEN mad > 0 THEN 0.6744897501960817 * (rate - med) / greatest(mad, 0.01) END AS z FROM k, m, d)
          SELECT loan_number, round_even(z, 4) AS score, originating_lender, n AS lender_loan_count, s AS lender_suspicious_count, round_even(rate, 4) AS lender_suspicious_rate, round_even(z, 4) AS lender_robust_z, {least} AS min_loans, CAST({least_z} AS DOUBLE) AS min_z FROM b JOIN z USING (originating_lender) WHERE z >= {least_z}"""


def edges(key: str) -> str:
    return f"""WITH k AS (SELECT loan_number, {key} AS k FROM {keys()} WHERE current_approval_amount >= 0 AND {key} IS NOT NULL),
    g AS (SELECT k FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)
    SELECT DISTINCT a.loan_number AS src, b.loan_number AS dst FROM k a JOIN g USING (k) JOIN k b USING (k) WHERE a.loan_number < b.loan_number"""


def share(c: str) -> str:
    return f"coalesce(least(greatest(coalesce({c}, 0.0) / CASE WHEN current_approval_amount > 0 THEN current_approval_amount END, 0.0), 2.0), 0.0)"


def structured() -> dict[str, str]:
    a = "coalesce(current_approval_amount, 0.0)"
    cols = {
        "log_amount": f"ln(1 + greatest({a}, 0.0))", "log_jobs": "ln(1 + greatest(coalesce(jobs_reported, 0.0), 0.0))", "log_amount_per_job": "ln(1 + greatest(coalesce(current_approval_amount / CASE WHEN jobs_reported < 1 THEN 1.0 ELSE jobs_reported END, 0.0), 0.0))",
        "term": "coalesce(CAST(term AS DOUBLE), 0.0)", "sba_guaranty_pct": "coalesce(sba_guaranty_pct, 0.0)", "jobs_is_one": "CASE WHEN jobs_reported = 1 THEN 1.0 ELSE 0.0 END", "round_amount": "CASE WHEN current_approval_amount > 0 AND current_approval_amount % 10000 = 0 THEN 1.0 ELSE 0.0 END", "is_naics_72": "CASE WHEN naics_code LIKE '72%' THEN 1.0 ELSE 0.0 END",
    }
    return cols


def thin() -> str:
    from .operators.features import DETECTORS

    cols = structured() | {"payroll_share": share("payroll_proceed"), "forgiveness_ratio": share("forgiveness_amount")}
    det = ", ".join(f"max(CASE WHEN detector_id = '{d}' THEN score END) AS det_{d}" for d in DETECTORS)
    return f"""SELECT l.loan_number, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {n}' for n, c in cols.items())}, {', '.join(f'round(coalesce(det_{d}, 0.0), 6) AS det_{d}' for d in DETECTORS)}
    FROM {distinct('current_approval_amount', 'jobs_reported', 'payroll_proceed', 'forgiveness_amount', 'term', 'sba_guaranty_pct', 'naics_code')} l LEFT JOIN (SELECT loan_number, {det} FROM {SIGNALS} GROUP BY 1) s USING (loan_number) WHERE {SLICE}"""


def evidence() -> str:
    from .operators.features import EVIDENCE

    cols = ", ".join(f"round(coalesce(max(CASE WHEN detector_id = '{d}' THEN try_cast(evidence_json ->> '$.{k}' AS DOUBLE) END), 0.0), 6) AS {c}" for d, keys_ in EVIDENCE.items() for k, c in keys_.items())
    return f"SELECT loan_number, {cols} FROM signals WHERE loan_number IS NOT NULL AND detector_id IN ({', '.join(repr(d) for d in EVIDENCE)}) GROUP BY 1"


def categories() -> str:
    from .operators.features import CATEGORIES

    clean = lambda c: f"coalesce(nullif(trim({c}), ''), '__missing__')"
    cats = ", ".join(f"{clean(c)} AS {n}" for n, c in CATEGORIES.items())
    return f"""WITH b AS (SELECT loan_number, CASE WHEN length(substr(coalesce(naics_code, ''), 1, 2)) = 2 THEN substr(naics_code, 1, 2) ELSE '__missing__' END AS cat_naics_sector, {cats}, CASE WHEN coalesce(trim(franchise_name), '') <> '' THEN 'Y' ELSE 'N' END AS cat_franchise, {clean('originating_lender')} AS lender
      FROM {distinct('current_approval_amount', 'naics_code', 'franchise_name', 'originating_lender', *CATEGORIES.values())} WHERE {SLICE})
    SELECT * EXCLUDE (lender), CASE WHEN lender = '__missing__' OR count(*) OVER (PARTITION BY lender) >= 25 THEN lender ELSE '__rare__' END AS cat_originating_lender FROM b"""


def releases_text() -> str:
    from .functions.text import EIDL_WORDS, LOAN_WORDS, PPP_WORDS

    has = lambda words: "(" + " OR ".join(f"contains(blob, '{w}')" for w in words) + ")"
    money = "regexp_extract_all(coalesce(body, ''), '\\$\\s?([\\d,]+(?:\\.\\d+)?)\\s*(million|billion|thousand)?', {g}, 'i')"
    largest = f"list_max(list_transform(list_zip({money.format(g=1)}, {money.format(g=2)}), lambda p: try_cast(replace(p[1], ',', '') AS DOUBLE) * CASE lower(p[2]) WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 ELSE 1 END))"
    figures = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(body, ''), '\\$\\s?(\\d{1,3}(?:,\\d{3})+|\\d{4,})(?:\\.\\d{2})?', 1), lambda x: try_cast(replace(x, ',', '') AS BIGINT)), lambda x: x >= 5000)))"
    return f"""SELECT id, CASE WHEN {has(PPP_WORDS)} AND {has(EIDL_WORDS)} THEN 'both' WHEN {has(PPP_WORDS)} THEN 'ppp' WHEN {has(EIDL_WORDS)} THEN 'eidl' ELSE 'other' END AS program, {has((*PPP_WORDS, *EIDL_WORDS, *LOAN_WORDS))} AS about_loans, round_even({largest}, 2) AS largest,
      CASE WHEN body IS NULL THEN NULL ELSE coalesce(array_to_string(list_transform({figures}, lambda x: CAST(x AS VARCHAR)), ','), '') END AS figures, substr(sha256(id), 1, 16) AS hash
    FROM (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(body, '')) AS blob FROM (SELECT DISTINCT id, title, body FROM press_releases))"""


def staged() -> str:
    return "(SELECT *, coalesce(title, '') || ' . ' || coalesce(body, '') AS txt FROM (SELECT DISTINCT ON (url) * FROM press_releases WHERE url IS NOT NULL) WHERE program IN ('ppp', 'eidl', 'both'))"


def exact() -> str:
    from .functions.text import GENERIC_PHRASES, STATES

    states = ", ".join(f"('{code}', '{name.upper()}')" for code, name in STATES.items())
    generic = ", ".join(f"'{g}'" for g in GENERIC_PHRASES)
    return f"""WITH r AS (SELECT *, {TOKENS.format(c='txt')} AS t FROM {staged()}),
    g AS (SELECT DISTINCT url, array_to_string(t[i:i + n - 1], ' ') AS name FROM r, (SELECT unnest(range(2, 7)) AS n) ns, LATERAL (SELECT unnest(range(1, greatest(len(t) - n + 2, 1))) AS i) p WHERE len(t) >= n),
    l AS (SELECT loan_number, borrower_state AS state, current_approval_amount AS amount, {TOKENS.format(c='borrower_name')} AS lt FROM {distinct('borrower_name', 'borrower_state', 'current_approval_amount')} WHERE borrower_name IS NOT NULL),
    h AS (SELECT g.url, g.name, l.*, len(lt) AS n_tokens, r.txt, upper(r.txt) AS u, r.alleged_amount, r.published_date, r.source, s.full_name FROM g JOIN l ON array_to_string(lt, ' ') = g.name AND len(lt) >= 2 JOIN r USING (url) LEFT JOIN (VALUES {states}) s(code, full_name) ON s.code = l.state WHERE g.name NOT IN ({generic})),
    e AS (SELECT *, coalesce(coalesce(state, '') <> '' AND (list_contains(string_split(regexp_replace(u, '[^A-Z0-9_]+', ' ', 'g'), ' '), state) OR coalesce(contains(u, full_name), false)), false) AS in_state,
      coalesce(amount, 0) <> 0 AND (contains(txt, format('{{:,}}', CAST(round_even(amount, 0) AS BIGINT))) OR contains(txt, CAST(CAST(round_even(amount, 0) AS BIGINT) AS VARCHAR))) AS exact FROM h),
    a AS (SELECT *, coalesce(amount, 0) <> 0 AND NOT exact AND coalesce(alleged_amount, 0) <> 0 AND abs(alleged_amount - amount) / amount <= 0.2 AS near FROM e),
    c AS (SELECT *, round_even(least(0.4 + CASE WHEN in_state THEN 0.25 ELSE 0 END + CASE WHEN exact THEN 0.3 WHEN near THEN 0.15 ELSE 0 END + CASE WHEN n_tokens >= 3 THEN 0.1 ELSE 0 END, 1.0), 3) AS conf, concat_ws('+', 'name', CASE WHEN in_state THEN 'state' END, CASE WHEN exact THEN 'amount' WHEN near THEN 'amount~' END) AS method FROM a WHERE exact OR near),
    b AS (SELECT *, row_number() OVER (PARTITION BY url, loan_number ORDER BY conf DESC, n_tokens DESC, name) AS rn FROM c WHERE conf >= 0.6)
    SELECT substr(sha256(url || '|' || loan_number), 1, 16) AS case_id, loan_number, CAST(NULL AS VARCHAR) AS defendant_name, name AS business_name, alleged_amount, published_date AS charge_date, source, url AS source_url, method AS match_method, CAST(conf AS DOUBLE) AS match_confidence FROM b WHERE rn = 1"""


def amounts() -> str:
    return f"""WITH said AS (SELECT DISTINCT url, unnest(list_filter(list_transform(regexp_extract_all(txt, '\\$\\s?(\\d{{1,3}}(?:,\\d{{3}})+|\\d{{4,}})(?:\\.\\d{{2}})?', 1), lambda x: try_cast(replace(x, ',', '') AS BIGINT)), lambda x: x >= 5000)) AS matched_dollar FROM {staged()}),
    l AS (SELECT loan_number, borrower_name, borrower_state AS state, current_approval_amount AS amount, CAST(round_even(current_approval_amount, 0) AS BIGINT) AS matched_dollar FROM {distinct('borrower_name', 'borrower_state', 'current_approval_amount')} WHERE borrower_name IS NOT NULL AND current_approval_amount IS NOT NULL),
    few AS (SELECT matched_dollar FROM l GROUP BY 1 HAVING count(*) <= 25)
    SELECT url, loan_number, borrower_name, state, amount, matched_dollar FROM said JOIN few USING (matched_dollar) JOIN l USING (matched_dollar) WHERE loan_number NOT IN (SELECT loan_number FROM {POSITIVES})"""


def pool() -> str:
    l = distinct("borrower_name", "borrower_city", "borrower_state", "borrower_zip", "naics_code", "current_approval_amount", "jobs_reported")
    return f"""WITH l AS {l}, t AS (SELECT loan_number AS target, borrower_state AS s, current_approval_amount AS a FROM l WHERE loan_number IN (SELECT loan_number FROM {POSITIVES}) AND trim(coalesce(borrower_name, '')) <> '' AND current_approval_amount > 0),
    p AS (SELECT target, loan_number, row_number() OVER (PARTITION BY target ORDER BY abs(current_approval_amount - a), loan_number) AS n FROM l JOIN t ON borrower_state = s AND loan_number <> target AND current_approval_amount >= 150000 AND current_approval_amount BETWEEN a * 0.75 AND a * 1.25 WHERE coalesce(borrower_name, '') <> '')
    SELECT target, loan_number FROM p WHERE n <= 3000"""


def metrics(rank: str, known: str, population: str) -> str:
    return f"""SELECT k, h AS hits, round_even(h / k, 5) AS precision, round_even(CASE WHEN n > 0 THEN (h / k) / (n / CAST(pop AS DOUBLE)) END, 2) AS lift, round_even(CASE WHEN n > 0 THEN h / n END, 4) AS recall FROM
      (SELECT CAST(k AS INTEGER) AS k, (SELECT count(*) FROM {rank} r JOIN {known} y USING (loan_number) WHERE r.rank <= k) AS h, (SELECT count(*) FROM {known}) AS n, (SELECT count(*) FROM {population}) AS pop FROM {KS})"""


def default_signals() -> str:
    """(loan_number, detector_id, score) of the detectors that run by default."""
    found = sql_of_detectors()
    return "(" + " UNION ALL ".join(f"SELECT loan_number, '{d}' AS detector_id, score FROM ({found[f'detect_{d}']})" for d in ("naics_cohort_outlier", "payroll_cap_exceedance", "multiple_funded_loans")) + ")"


def score_top(k: int = 25) -> str:
    return f"""SELECT *, CAST(row_number() OVER (ORDER BY raw DESC, loan_number) AS INTEGER) AS rank FROM (SELECT loan_number, borrower_name, naics_code, state, amount, jobs_reported, composite_score AS raw, round_even(composite_score, 6) AS composite_score, n_signals, detectors FROM {composite(f"(SELECT DISTINCT * FROM {default_signals()})")}) QUALIFY rank <= {k}"""


def benchmark(where: str = SLICE) -> str:
    """Every ranking of a part of the loans, held against its known positives."""
    universe = f"(SELECT loan_number FROM {distinct('current_approval_amount')} WHERE {where})"
    known = f"(SELECT loan_number FROM {POSITIVES} WHERE loan_number IN (SELECT loan_number FROM u))"
    score = f"SELECT 'composite' AS ranking, loan_number, composite_score AS s FROM {composite()} UNION ALL SELECT detector_id, loan_number, max(score) FROM {SIGNALS} GROUP BY 1, 2 UNION ALL SELECT 'amount_per_job', loan_number, current_approval_amount / jobs_reported FROM {distinct('current_approval_amount', 'jobs_reported')} WHERE {USABLE} UNION ALL SELECT 'raw_amount', loan_number, current_approval_amount FROM {distinct('current_approval_amount', 'jobs_reported')} WHERE {USABLE}"
    return f"""WITH u AS {universe}, r AS (SELECT ranking, loan_number, row_number() OVER (PARTITION BY ranking ORDER BY s DESC, loan_number) AS rank FROM ({score}) WHERE loan_number IN (SELECT loan_number FROM u)),
    names AS (SELECT DISTINCT detector_id AS ranking FROM {SIGNALS} UNION ALL SELECT unnest(['composite', 'amount_per_job', 'raw_amount'])),
    h AS (SELECT names.ranking, CAST(k AS INTEGER) AS k, count(y.loan_number) AS h FROM names CROSS JOIN {KS} LEFT JOIN r ON r.ranking = names.ranking AND r.rank <= ks.k LEFT JOIN {known} y ON y.loan_number = r.loan_number GROUP BY 1, 2),
    n AS (SELECT (SELECT count(*) FROM {known}) AS n, (SELECT count(*) FROM u) AS pop)
    SELECT ranking, k, h AS hits, round_even(h / k, 5) AS precision, round_even(CASE WHEN n > 0 THEN (h / k) / (n / CAST(pop AS DOUBLE)) END, 2) AS lift, round_even(CASE WHEN n > 0 THEN h / n END, 4) AS recall FROM h, n"""


def embedded(names: str, words: bool = False) -> str:
    """(name, slot, w) of names(name): the unit vectors of the hashing embedder, of grams or words, without their zeros."""
    padded = f"(SELECT name, ' ' || lower(trim(name)) || ' ' AS p FROM {names} WHERE trim(name) <> '')"
    grams = f"(SELECT name, unnest(list_filter(string_split(p, ' '), lambda w: w <> '')) AS g FROM {padded})" if words else f"(SELECT name, substr(p, i, k) AS g FROM (SELECT name, p, k, unnest(range(1, length(p) - k + 2)) AS i FROM {padded}, (VALUES (3), (4), (5)) g(k) WHERE length(p) >= k))"
    return f"""(SELECT name, slot, w / sqrt(sum(w * w) OVER (PARTITION BY name)) AS w FROM
      (SELECT name, h // 16 AS slot, CAST(sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS w FROM (SELECT name, ('0x' || substr(md5(g), 1, 3))::INT AS h FROM {grams}) GROUP BY 1, 2) WHERE w <> 0)"""


def mismatch() -> str:
    return f"""WITH t AS (SELECT trim(naics_code) AS code, max(trim(title)) AS title FROM naics_titles WHERE naics_code IS NOT NULL AND title IS NOT NULL GROUP BY 1), u AS (SELECT DISTINCT title FROM t),
    b AS (SELECT loan_number, borrower_name, coalesce(a.title, s.title) AS title FROM {distinct('borrower_name', 'naics_code')} l LEFT JOIN t a ON l.naics_code = a.code LEFT JOIN t s ON substr(l.naics_code, 1, 2) = s.code WHERE trim(coalesce(borrower_name, '')) <> '' AND coalesce(naics_code, '') <> '' AND coalesce(a.title, s.title) IS NOT NULL),
    n AS (SELECT DISTINCT borrower_name AS name FROM b), v AS MATERIALIZED {embedded('n')}, x AS MATERIALIZED {embedded('(SELECT title AS name FROM u)')},
    d AS (SELECT v.name, x.name AS title, sum(v.w * x.w) AS sim FROM v JOIN x USING (slot) GROUP BY 1, 2),
    f AS MATERIALIZED (SELECT n.name, u.title, round_even(coalesce(sim, 0.0), 12) + 0.0 AS sim FROM n CROSS JOIN u LEFT JOIN d ON d.name = n.name AND d.title = u.title),
    best AS (SELECT name, max(sim) AS hi, min(sim) AS lo, min(title) FILTER (WHERE sim = m) AS best_title FROM (SELECT *, max(sim) OVER (PARTITION BY name) AS m FROM f) GROUP BY 1),
    g AS (SELECT b.*, f.sim AS own, hi, best_title, round_even(CASE WHEN hi - lo > 1e-9 THEN (hi - f.sim) / (hi - lo) ELSE 0.0 END, 4) AS gap FROM b JOIN f ON f.name = b.borrower_name AND f.title = b.title JOIN best ON best.name = b.borrower_name)
    SELECT loan_number, gap AS score, title AS declared_title, round_even(own, 4) + 0.0 AS declared_similarity, best_title AS best_match_title, round_even(hi, 4) + 0.0 AS best_similarity, gap AS mismatch_gap, (SELECT CAST(count(*) AS INTEGER) FROM u) AS n_titles FROM g WHERE gap >= 0.6"""


def similar(k: int = 20) -> str:
    """The fused neighbours of every labelled loan, as a sub-query."""
    return f"""(WITH pool AS MATERIALIZED ({pool()}), l AS {distinct('borrower_name', 'borrower_city', 'borrower_state', 'borrower_zip', 'naics_code', 'current_approval_amount', 'jobs_reported')},
    p AS MATERIALIZED (SELECT pool.target, pool.loan_number, a.borrower_name, t.borrower_name AS t_name, abs(a.current_approval_amount - t.current_approval_amount) / t.current_approval_amount AS gap, coalesce(a.naics_code = t.naics_code, false) AS same_naics, coalesce(a.borrower_state = t.borrower_state, false) AS same_state, coalesce(nullif(substr(trim(coalesce(a.borrower_zip, '')), 1, 5), '') = nullif(substr(trim(coalesce(t.borrower_zip, '')), 1, 5), ''), false) AS same_zip5 FROM pool JOIN l a ON a.loan_number = pool.loan_number JOIN l t ON t.loan_number = pool.target),
    v AS MATERIALIZED {embedded('(SELECT borrower_name AS name FROM p UNION SELECT t_name FROM p)')}, x AS MATERIALIZED {embedded('(SELECT borrower_name AS name FROM p UNION SELECT t_name FROM p)', True)}, pairs AS (SELECT DISTINCT borrower_name, t_name FROM p),
    d AS (SELECT borrower_name, t_name, sum(a.w * b.w) AS sim FROM pairs JOIN v a ON a.name = borrower_name JOIN v b ON b.name = t_name AND a.slot = b.slot GROUP BY 1, 2),
    e AS (SELECT borrower_name, t_name, sum(a.w * b.w) AS sim FROM pairs JOIN x a ON a.name = borrower_name JOIN x b ON b.name = t_name AND a.slot = b.slot GROUP BY 1, 2),
    s AS (SELECT p.*, round_even(coalesce(d.sim, 0.0), 6) + 0.0 AS lexical, round_even(coalesce(e.sim, 0.0), 6) + 0.0 AS semantic FROM p LEFT JOIN d ON d.borrower_name = p.borrower_name AND d.t_name = p.t_name LEFT JOIN e ON e.borrower_name = p.borrower_name AND e.t_name = p.t_name),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY lexical DESC, loan_number) AS rl, row_number() OVER (PARTITION BY target ORDER BY semantic DESC, loan_number) AS rm, row_number() OVER (PARTITION BY target ORDER BY same_naics DESC, gap, same_zip5 DESC, loan_number) AS rs FROM s),
    f AS (SELECT *, CAST(1.0 AS DOUBLE) / (60 + rm) + CAST(0.6 AS DOUBLE) / (60 + rl) + CAST(0.8 AS DOUBLE) / (60 + rs) AS fused FROM r),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY fused DESC, loan_number) AS INTEGER) AS rank FROM f QUALIFY rank <= {k})
    SELECT target, rank, loan_number, borrower_name, round_even(semantic, 4) + 0.0 AS semantic_sim, round_even(lexical, 4) + 0.0 AS lexical_sim, round_even(gap, 4) AS amount_delta_pct, same_naics, same_state, same_zip5, loan_number IN (SELECT loan_number FROM {POSITIVES}) AS is_fraud, round_even(fused, 6) AS fused_score FROM top)"""


def homophily() -> str:
    base = f"(SELECT avg(CASE WHEN loan_number IN (SELECT loan_number FROM {POSITIVES}) THEN 1.0 ELSE 0.0 END) FROM {distinct('current_approval_amount')} WHERE {SLICE})"
    return f"""SELECT n_targets, round_even(near, 6) AS neighbour_rate, round_even(base, 6) AS base_rate, round_even(CASE WHEN base > 0 THEN near / base END, 4) AS lift FROM (SELECT count(DISTINCT target) AS n_targets, CAST(avg(CASE WHEN is_fraud THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS near, CAST({base} AS DOUBLE) AS base FROM {similar(10)})"""


def whole_loans() -> str:
    return "SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY loan_number ORDER BY coalesce(CAST(loan_status_date AS VARCHAR), ''), coalesce(loan_status, '')) AS _n FROM loans WHERE loan_number IS NOT NULL) WHERE _n = 1"


def curve() -> str:
    n = f"(SELECT count(*) FROM {distinct('current_approval_amount')})"
    at = f"(SELECT DISTINCT k FROM (SELECT greatest(1, CAST(round_even(pow({n}, CAST(i AS DOUBLE) / 39), 0) AS BIGINT)) AS k FROM range(40) t(i) UNION SELECT k FROM {KS}) WHERE k <= {n})"
    return metrics(ranking(), POSITIVES, distinct("current_approval_amount")).replace(KS, f"{at} ks")


def detector_alone() -> str:
    """A detector and the composite on the charges after 2022, without the earlier ones."""
    first = "(SELECT loan_number, min(charge_date) AS d FROM fraud_cases WHERE loan_number IS NOT NULL AND charge_date IS NOT NULL GROUP BY 1)"
    score = f"SELECT 'tested' AS ranking, loan_number, max(score) AS s FROM {SIGNALS} WHERE detector_id = 'payroll_cap_exceedance' GROUP BY 1, 2 UNION ALL SELECT 'composite', loan_number, composite_score FROM {composite()}"
    return f"""WITH f AS {first}, u AS (SELECT loan_number FROM {distinct('current_approval_amount')} WHERE loan_number NOT IN (SELECT loan_number FROM f WHERE year(d) <= 2022)), y AS (SELECT loan_number FROM f WHERE year(d) > 2022 AND loan_number IN (SELECT loan_number FROM u)),
    r AS (SELECT ranking, loan_number, row_number() OVER (PARTITION BY ranking ORDER BY s DESC, loan_number) AS rank FROM ({score}) WHERE loan_number IN (SELECT loan_number FROM u)),
    h AS (SELECT g.ranking, CAST(k AS INTEGER) AS k, count(y.loan_number) AS h FROM (VALUES ('tested'), ('composite')) g(ranking) CROSS JOIN {KS} LEFT JOIN r ON r.ranking = g.ranking AND r.rank <= ks.k LEFT JOIN y ON y.loan_number = r.loan_number GROUP BY 1, 2), n AS (SELECT (SELECT count(*) FROM y) AS n, (SELECT count(*) FROM u) AS pop)
    SELECT ranking, k, h AS hits, round_even(h / k, 5) AS precision, round_even(CASE WHEN n > 0 THEN (h / k) / (n / CAST(pop AS DOUBLE)) END, 2) AS lift, round_even(CASE WHEN n > 0 THEN h / n END, 4) AS recall FROM h, n"""


def gate() -> str:
    ks = "(VALUES (25), (50), (100), (250)) ks(k)"
    new = f"(SELECT r.loan_number, row_number() OVER (ORDER BY CASE WHEN r.rank <= 250 THEN 0 ELSE 1 END, CASE WHEN r.rank <= 250 THEN -n END, r.rank) AS rank FROM {ranking()} r JOIN (SELECT loan_number, count(*) AS n FROM {SIGNALS} GROUP BY 1) s USING (loan_number))"
    one = lambda r: metrics(r, POSITIVES, distinct("current_approval_amount")).replace(KS, ks)
    return f"""WITH g AS (SELECT k, a.hits AS hits_before, coalesce(a.lift, 0.0) AS lift_before, b.hits AS hits_after, coalesce(b.lift, 0.0) AS lift_after FROM ({one(ranking())}) a JOIN ({one(new)}) b USING (k)), d AS (SELECT sum(lift_after - lift_before) AS d FROM g)
    SELECT g.*, CASE WHEN d > 1e-9 THEN 'improved' WHEN d < -1e-9 THEN 'regressed' ELSE 'neutral' END AS verdict FROM g, d"""


def profiles() -> str:
    from .operators.investigate import PROFILE

    return f"SELECT y.loan_number, l.loan_number IS NOT NULL AS found, {', '.join(PROFILE)}, CASE WHEN jobs_reported >= 1 THEN round_even(current_approval_amount / jobs_reported, 2) END AS amount_per_job FROM {POSITIVES} y LEFT JOIN (SELECT {', '.join(('loan_number', *PROFILE))} FROM ({whole_loans()})) l USING (loan_number)"


def patterns() -> str:
    return f"""WITH b AS (SELECT l.*, y.loan_number IS NOT NULL AS y, CASE WHEN {USABLE} THEN current_approval_amount / jobs_reported END AS d FROM {distinct('naics_code', 'borrower_state', 'current_approval_amount', 'jobs_reported')} l LEFT JOIN {POSITIVES} y USING (loan_number)), i AS (SELECT * FROM b WHERE {SLICE}),
    o AS (SELECT (SELECT count(*) FILTER (WHERE y) / nullif(CAST(count(*) AS DOUBLE), 0) FROM i) AS base, (SELECT median(d) FROM i) AS m, (SELECT median(d) FILTER (WHERE y) FROM i) AS ml, (SELECT s FROM (SELECT substr(naics_code, 1, 2) AS s, count(*) AS c FROM i WHERE y AND length(substr(naics_code, 1, 2)) = 2 GROUP BY 1) ORDER BY c DESC, s LIMIT 1) AS top),
    c AS (SELECT naics_code, borrower_state, count(*) FILTER (WHERE y) / CAST(count(*) AS DOUBLE) AS rate FROM i GROUP BY 1, 2)
    SELECT loan_number, round_even(d, 4) AS amount_per_job, round_even(base, 6) AS base_rate, round_even((d - m) / m, 6) AS off_median, round_even((d - ml) / ml, 6) AS off_labelled_median, round_even(rate, 6) AS cell_rate, substr(naics_code, 1, 2) = top AS top_sector FROM b CROSS JOIN o LEFT JOIN c USING (naics_code, borrower_state) WHERE y"""


def snippets() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP)
    return f"""WITH c AS (SELECT DISTINCT case_id, business_name AS n, source_url AS url FROM fraud_cases WHERE business_name IS NOT NULL), r AS (SELECT url, min(body) AS body FROM press_releases WHERE url IS NOT NULL AND body IS NOT NULL GROUP BY 1), j AS (SELECT *, greatest(instr(body, n), 1) AS a, greatest(greatest(instr(body, n), 1) - 180, 1) AS s FROM c JOIN r USING (url))
    SELECT case_id, substr(body, s, a + length(n) + 180 - s) AS snippet, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(upper(n), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4 AND w NOT IN ({stop})))), ' ') AS tokens FROM j"""


def rich() -> str:
    """The structured part of the rich features joined with the parts that have SQL of their own; no graph."""
    from .operators.features import DETECTORS, SHARES

    cols = structured() | {n: share(c) for n, c in SHARES.items()}
    cols["amount_delta_share"] = "coalesce(least(greatest((current_approval_amount - initial_approval_amount) / CASE WHEN current_approval_amount > 0 THEN current_approval_amount END, -2.0), 2.0), 0.0)"
    det = ", ".join(f"max(CASE WHEN detector_id = '{d}' THEN score END) AS det_{d}" for d in DETECTORS)
    parts = sql_of_parts()
    from .operators.features import EVIDENCE

    numbers = [c for keys_ in EVIDENCE.values() for c in keys_.values()]
    return f"""SELECT l.loan_number, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {n}' for n, c in cols.items())}, {', '.join(f'round(coalesce(det_{d}, 0.0), 6) AS det_{d}' for d in DETECTORS)}, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in numbers)}, round(coalesce(pay_ratio_pctile, 0.0), 6) AS pay_ratio_pctile, coalesce(pay_ratio_cohort_size, 0.0) AS pay_ratio_cohort_size, c.* EXCLUDE (loan_number)
    FROM {distinct('current_approval_amount', 'initial_approval_amount', 'jobs_reported', 'term', 'sba_guaranty_pct', 'naics_code', *SHARES.values())} l LEFT JOIN (SELECT loan_number, {det} FROM {SIGNALS} GROUP BY 1) s USING (loan_number) LEFT JOIN ({evidence()}) e USING (loan_number) LEFT JOIN ({parts['features_pay_ratio']}) p USING (loan_number) JOIN ({categories()}) c USING (loan_number) WHERE {SLICE}"""


def bootstrap(n_boot: int = 2000) -> str:
    """Poisson draws of every place of the ranking in every replicate, by the arithmetic of ranking.drawn()."""
    from .operators.ranking import POISSON

    u = "((((id * 48271 + place * 69621 + 12345) % 2147483647) * 16807 + place * 40692 + id) % 2147483647)"
    v = f"(({u} * 39373 + id * 16807) % 2147483647)"
    drawn = " + ".join(f"CASE WHEN v >= {t} THEN 1 ELSE 0 END" for t in POISSON)
    return f"""WITH r AS (SELECT loan_number, row_number() OVER (ORDER BY composite_score DESC, loan_number) AS place FROM {composite()} QUALIFY place <= 25000), y AS (SELECT place, CASE WHEN loan_number IN (SELECT loan_number FROM {POSITIVES}) THEN 1 ELSE 0 END AS y FROM r),
    d AS (SELECT id, place, y, {drawn} AS m FROM (SELECT id, place, y, {v} AS v FROM y, range({n_boot}) b(id))),
    c AS (SELECT id, y, m, sum(m) OVER (PARTITION BY id ORDER BY place) AS upto FROM d), h AS (SELECT id, CAST(k AS INTEGER) AS k, CAST(sum(y * greatest(least(m, k - (upto - m)), 0)) AS DOUBLE) AS hits FROM c, {KS} GROUP BY 1, 2),
    q AS (SELECT k, quantile_cont(hits, 0.025) AS lo, quantile_cont(hits, 0.975) AS hi FROM h GROUP BY 1), b AS (SELECT (SELECT count(*) FROM {POSITIVES}) / (SELECT CAST(count(*) AS DOUBLE) FROM {distinct('current_approval_amount')}) AS base)
    SELECT k, round_even(lo, 1) AS hits_low, round_even(hi, 1) AS hits_high, round_even(lo / k / base, 2) AS lift_low, round_even(hi / k / base, 2) AS lift_high FROM q, b"""


def sql() -> dict[str, str]:
    return sql_of_detectors() | sql_of_parts() | {
        "signals_by_detector": f"SELECT detector_id, count(*) AS n, round_even(max(score), 4) AS top FROM {default_signals()} GROUP BY 1", "score_top25": score_top().replace("SELECT *,", "SELECT * EXCLUDE (raw),", 1), "benchmark_slice": benchmark(), "detect_naics_name_mismatch": mismatch(),
        "similar_top": f"SELECT * FROM {similar()}", "similar_homophily": homophily(), "warehouse_loans": whole_loans(), "features_rich_plain": rich(), "rank_bootstrap": bootstrap(),
        "benchmark_population": benchmark("true"), "benchmark_detector": detector_alone(), "lift_curve": curve(), "triage_gate": gate(), "loan_profiles": profiles(), "loan_patterns": patterns(), "label_snippets": snippets(),
        "flag_rates": f"SELECT detector_id, count(DISTINCT loan_number) AS n, round_even(count(DISTINCT loan_number) / CAST((SELECT count(*) FROM {distinct('current_approval_amount')}) AS DOUBLE), 6) AS share FROM signals WHERE loan_number IS NOT NULL GROUP BY 1",
        "label_exact_tier": "SELECT DISTINCT case_id, loan_number, match_method, match_confidence FROM fraud_cases WHERE match_method NOT ILIKE '%llm%'",
        "sample_loans": f"SELECT loan_number, current_approval_amount FROM {distinct('current_approval_amount')} WHERE {SLICE} ORDER BY md5(loan_number || '|0'), loan_number LIMIT 500",
    }


def sql_of_detectors() -> dict[str, str]:
    return {k: v for k, v in sql_of_parts().items() if k.startswith("detect_")}


def sql_of_parts() -> dict[str, str]:
    ln = lambda *c: distinct(*c)
    amt = ln("current_approval_amount")
    return {
        "detect_naics_cohort_outlier": cohort(),
        "detect_payroll_cap_exceedance": f"SELECT loan_number, round_even(d / cap, 4) AS score, naics_code, state, borrower_name, amount, jobs_reported, round_even(d, 2) AS amount_per_job, cap AS per_employee_cap, round_even(d / cap, 2) AS x_cap FROM (SELECT loan_number, naics_code, borrower_state AS state, borrower_name, current_approval_amount AS amount, jobs_reported, current_approval_amount / jobs_reported AS d, CAST({CAP} AS DOUBLE) AS cap FROM {ln('borrower_name', 'naics_code', 'borrower_state', 'current_approval_amount', 'jobs_reported')} WHERE {USABLE}) WHERE d / cap >= 1.5",
        "detect_multiple_funded_loans": f"""WITH b AS (SELECT loan_number, entity_key, coalesce(processing_method, '') AS draw, current_approval_amount AS a FROM {keys()} WHERE entity_key IS NOT NULL),
          d AS (SELECT entity_key, draw, count(*) AS c, sum(a) AS s FROM b GROUP BY 1, 2), e AS (SELECT entity_key, CAST(sum(c) AS BIGINT) AS n_loans, CAST(sum(greatest(c - 1, 0)) AS BIGINT) AS w, sum(s) AS t, '{{' || string_agg('"' || draw || '":' || c, ',' ORDER BY draw) || '}}' AS per_draw_counts FROM d GROUP BY 1)
          SELECT loan_number, CAST(greatest(w, n_loans - 2) AS DOUBLE) AS score, entity_key, n_loans, greatest(w, n_loans - 2) AS excess_loans, per_draw_counts, round_even(t, 2) AS total_amount, loan_numbers FROM b JOIN e USING (entity_key) JOIN (SELECT entity_key, array_to_string(list_sort(list(DISTINCT loan_number))[1:25], ';') AS loan_numbers FROM b GROUP BY 1) USING (entity_key) WHERE greatest(w, n_loans - 2) > 0""",
        "detect_duplicate_address_ring": f"""WITH b AS (SELECT loan_number, borrower_name, building_key AS normalized_address, current_approval_amount AS a FROM {keys()} WHERE building_key IS NOT NULL),
          e AS (SELECT normalized_address, count(DISTINCT CASE WHEN trim(borrower_name) <> '' THEN borrower_name END) AS ring_size, count(*) AS n_loans, round_even(coalesce(sum(a), 0.0), 2) AS total_ring_amount, array_to_string(list_sort(list(DISTINCT borrower_name) FILTER (WHERE trim(borrower_name) <> ''))[1:10], ';') AS borrower_names_sample FROM b GROUP BY 1)
          SELECT loan_number, round_even(ln(1 + ring_size) + ln(1 + total_ring_amount), 4) AS score, normalized_address, ring_size, n_loans, total_ring_amount, borrower_names_sample FROM b JOIN e USING (normalized_address) WHERE ring_size >= 3""",
        "detect_amount_anomaly": f"""WITH b AS (SELECT *, CAST(round_even(current_approval_amount * 100, 0) AS BIGINT) AS cents, CAST({CAP} AS DOUBLE) AS cap, CASE WHEN jobs_reported >= 1 THEN current_approval_amount / jobs_reported END AS d FROM {ln('borrower_name', 'naics_code', 'borrower_state', 'current_approval_amount', 'jobs_reported')} WHERE current_approval_amount > 0),
          c AS (SELECT *, CASE WHEN cents % 1000000 = 0 THEN 10000 WHEN cents % 500000 = 0 THEN 5000 WHEN cents % 100000 = 0 THEN 1000 END AS v, CASE WHEN cents % 1000000 = 0 THEN 1.0 WHEN cents % 500000 = 0 THEN 0.66 WHEN cents % 100000 = 0 THEN 0.33 ELSE 0.0 END AS r, CASE WHEN d >= cap * (1 - CAST(0.05 AS DOUBLE)) AND d <= cap THEN (d - cap * (1 - CAST(0.05 AS DOUBLE))) / (cap - cap * (1 - CAST(0.05 AS DOUBLE))) ELSE 0.0 END AS n FROM b)
          SELECT loan_number, round_even(CAST(r AS DOUBLE) + n, 4) AS score, naics_code, borrower_state AS state, borrower_name, current_approval_amount AS amount, jobs_reported, v AS round_divisor, CAST(r AS DOUBLE) AS round_score, round_even(d, 2) AS per_employee_amount, cap AS per_employee_cap, round_even(n, 4) AS cap_maximization_score, concat_ws(',', CASE WHEN n > 0 THEN 'cap_maximization' END, CASE WHEN r > 0 THEN 'round_amount' END) AS signals_fired FROM c WHERE r + n > 0""",
        "detect_establishment_overcount": overcount(),
        "detect_establishment_overcount_relaxed": overcount(0.3),
        "detect_lender_concentration": lenders(),
        "detect_lender_concentration_relaxed": lenders(20, 1.0),
        "detect_naics_cohort_outlier_relaxed": cohort(10, 0.25, 1.5),
        "detect_business_recency": f"SELECT * FROM (SELECT loan_number, CASE lower(trim(business_age_description)) WHEN 'startup, loan funds will open business' THEN CAST(3 AS DOUBLE) WHEN 'new business or 2 years or less' THEN CAST(2 AS DOUBLE) WHEN 'change of ownership' THEN CAST(1 AS DOUBLE) END AS score, business_age_description, date_approved, lower(trim(business_age_description)) AS matched_tell FROM {ln('business_age_description', 'date_approved')}) WHERE score IS NOT NULL",
        "rank_composite": f"SELECT loan_number, borrower_name, naics_code, state, amount, jobs_reported, round_even(composite_score, 6) AS composite_score, n_signals, detectors FROM {composite()}",
        "rank_baseline_top100": f"SELECT loan_number, round_even(s, 4) AS score, CAST(row_number() OVER (ORDER BY s DESC, loan_number) AS INTEGER) AS rank FROM (SELECT loan_number, current_approval_amount / jobs_reported AS s FROM {ln('current_approval_amount', 'jobs_reported')} WHERE {USABLE}) QUALIFY rank <= 100",
        "rank_metrics": metrics(ranking(), POSITIVES, amt),
        "rank_positive_stats": f"""WITH r AS {ranking()}, p AS (SELECT CAST(rank AS DOUBLE) AS rank FROM r JOIN {POSITIVES} y USING (loan_number)), n AS (SELECT (SELECT count(*) FROM {POSITIVES}) AS np, (SELECT count(*) FROM p) AS nr, (SELECT count(*) FROM r) AS ni, (SELECT count(*) FROM {amt}) AS pop, (SELECT avg(rank) FROM p) AS me, (SELECT median(rank) FROM p) AS md, (SELECT coalesce(sum(rank), 0) FROM p) AS tot)
          SELECT np AS n_positives, nr AS n_ranked, np - nr AS n_unranked, ni AS n_in_ranking, round_even(me, 1) AS mean_rank_ranked, round_even(md, 1) AS median_rank_ranked, round_even(me / ni, 4) AS mean_percentile_in_ranking, round_even((tot + (np - nr) * pop) / np / pop, 4) AS mean_percentile_population_conservative FROM n""",
        "rank_fusion_top200": f"""WITH b AS (SELECT loan_number, current_approval_amount AS a, jobs_reported AS j FROM {ln('current_approval_amount', 'jobs_reported')} WHERE {USABLE}), r AS (SELECT loan_number, row_number() OVER (ORDER BY a / j DESC, loan_number) AS x, row_number() OVER (ORDER BY a DESC, loan_number) AS y FROM b),
          f AS (SELECT loan_number, CAST(1 AS DOUBLE) / (60 + x) + CAST(0.5 AS DOUBLE) / (60 + y) AS s FROM r) SELECT loan_number, round_even(s, 9) AS fused_score, CAST(row_number() OVER (ORDER BY s DESC, loan_number) AS INTEGER) AS rank FROM f QUALIFY rank <= 200""",
        "detector_overlap": "WITH p AS (SELECT loan_number, max(CASE WHEN detector_id = 'amount_anomaly' THEN 1 ELSE 0 END) AS a, max(CASE WHEN detector_id = 'naics_name_mismatch' THEN 1 ELSE 0 END) AS b FROM signals WHERE detector_id IN ('amount_anomaly', 'naics_name_mismatch') AND loan_number IS NOT NULL GROUP BY 1) SELECT CAST(coalesce(sum(a), 0) AS BIGINT) AS n_a, CAST(coalesce(sum(b), 0) AS BIGINT) AS n_b, CAST(coalesce(sum(a * b), 0) AS BIGINT) AS intersection, count(*) AS \"union\", round_even(CASE WHEN count(*) > 0 THEN sum(a * b) / count(*) ELSE 0 END, 6) AS jaccard FROM p",
        "label_positives": f"SELECT loan_number FROM {POSITIVES}",
        "label_temporal_split": "SELECT loan_number, CASE WHEN year(min(charge_date)) <= 2022 THEN 'train' ELSE 'test' END AS part FROM fraud_cases WHERE loan_number IS NOT NULL AND charge_date IS NOT NULL GROUP BY 1",
        "text_keys": f"SELECT loan_number, norm_name, building_key, entity_key FROM {keys()}",
        "text_releases": releases_text(),
        "labels_exact": exact(),
        "labels_amount_candidates": amounts(),
        "graph_address_edges": edges("building_key"),
        "graph_entity_edges": edges("entity_key"),
        "graph_components": f"""WITH RECURSIVE e AS (SELECT * FROM ({edges('building_key')}) UNION SELECT * FROM ({edges('entity_key')})), v AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), c(n, m) AS (SELECT a, a FROM v UNION SELECT v.b, c.m FROM c JOIN v ON v.a = c.n WHERE c.m < v.b) SELECT n AS loan_number, min(m) AS component FROM c GROUP BY 1""",
        "similar_pool": pool(),
        "vector_top_k": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT q.vec_id AS query, v.vec_id AS vec_id, round_even(list_cosine_similarity(q.e, v.e), 6) AS cosine FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) SELECT query, vec_id, cosine, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 10",
        "features_thin": thin(),
        "features_evidence": evidence(),
        "features_pay_ratio": f"WITH b AS (SELECT loan_number, coalesce(naics_code, '') AS n, coalesce(borrower_state, '') AS s, coalesce(project_county_name, '') AS c, coalesce(current_approval_amount / CASE WHEN jobs_reported < 1 THEN 1.0 ELSE jobs_reported END, 0.0) AS v FROM {ln('current_approval_amount', 'jobs_reported', 'naics_code', 'borrower_state', 'project_county_name')} WHERE {SLICE}) SELECT loan_number, round((rank() OVER (PARTITION BY n, s, c ORDER BY v) + (count(*) OVER (PARTITION BY n, s, c, v) - 1) / 2) / count(*) OVER (PARTITION BY n, s, c), 9) AS pay_ratio_pctile, CAST(count(*) OVER (PARTITION BY n, s, c) AS DOUBLE) AS pay_ratio_cohort_size FROM b",
        "features_categories": categories(),
        "profile_summary": f"SELECT count(*) AS n, round_even(sum(current_approval_amount), 2) AS total, round_even(median(current_approval_amount), 2) AS median_amount, count(*) FILTER (WHERE forgiveness_amount > 0) AS forgiven, count(*) FILTER (WHERE processing_method = 'PPS') AS second_draw FROM {ln('current_approval_amount', 'forgiveness_amount', 'processing_method')} WHERE {SLICE}",
        "profile_amounts": f"SELECT CASE WHEN current_approval_amount < 350000 THEN '150k-350k' WHEN current_approval_amount < 1000000 THEN '350k-1M' WHEN current_approval_amount < 2000000 THEN '1M-2M' ELSE '2M+' END AS bucket, count(*) AS loans FROM {amt} WHERE {SLICE} GROUP BY 1",
        "profile_jobs": f"SELECT CASE WHEN jobs_reported IS NULL OR jobs_reported < 1 THEN 'none' WHEN jobs_reported = 1 THEN '1' WHEN jobs_reported <= 5 THEN '2-5' WHEN jobs_reported <= 25 THEN '6-25' WHEN jobs_reported <= 100 THEN '26-100' ELSE '100+' END AS bucket, count(*) AS loans FROM {ln('current_approval_amount', 'jobs_reported')} WHERE {SLICE} GROUP BY 1",
        "profile_top_lenders": f"SELECT originating_lender AS key, count(*) AS value FROM {ln('current_approval_amount', 'originating_lender')} WHERE {SLICE} AND coalesce(originating_lender, '') <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
        "profile_top_states_by_amount": f"SELECT borrower_state AS key, round_even(sum(current_approval_amount), 2) AS value FROM {ln('current_approval_amount', 'borrower_state')} WHERE {SLICE} AND coalesce(borrower_state, '') <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
        "profile_coverage": f"SELECT detector_id, count(DISTINCT loan_number) AS flagged_loans FROM signals WHERE loan_number IN (SELECT loan_number FROM {amt} WHERE {SLICE}) GROUP BY 1",
        "profile_population": f"SELECT count(*) AS n_total, count(*) FILTER (WHERE {SLICE}) AS n_slice, count(*) FILTER (WHERE {SLICE} AND loan_number IN (SELECT loan_number FROM {POSITIVES})) AS n_labels FROM {amt}",
        "profile_pay_medians": f"WITH b AS (SELECT *, current_approval_amount / jobs_reported AS d, loan_number IN (SELECT loan_number FROM {POSITIVES}) AS y FROM {ln('current_approval_amount', 'jobs_reported')} WHERE {SLICE} AND {USABLE}) SELECT round_even(median(d), 4) AS median_per_job, round_even(median(current_approval_amount) FILTER (WHERE y), 4) AS labelled_amount, round_even(median(d) FILTER (WHERE y), 4) AS labelled_per_job FROM b",
        "profile_percentile": f"SELECT round_even(100.0 * count(*) FILTER (WHERE current_approval_amount / jobs_reported < 20000) / nullif(count(*), 0), 4) AS percentile FROM {ln('current_approval_amount', 'jobs_reported')} WHERE {SLICE} AND {USABLE}",
        "profile_histogram": f"SELECT round(log10(current_approval_amount / jobs_reported), 1) AS log_per_job, count(*) AS loans FROM {ln('current_approval_amount', 'jobs_reported')} WHERE {SLICE} AND {USABLE} GROUP BY 1",
        "profile_sectors": f"SELECT substr(naics_code, 1, 2) AS sector, count(*) AS total_loans, count(y.loan_number) AS prosecuted_loans, round(100.0 * count(y.loan_number) / count(*), 4) AS rate_pct FROM {ln('current_approval_amount', 'naics_code')} l LEFT JOIN {POSITIVES} y USING (loan_number) WHERE {SLICE} AND coalesce(naics_code, '') <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "profile_cells": f"SELECT naics_code, borrower_state AS state, count(*) AS total, count(y.loan_number) AS prosecuted, round_even(median(current_approval_amount / nullif(jobs_reported, 0)), 4) AS median_per_job FROM {ln('current_approval_amount', 'naics_code', 'borrower_state', 'jobs_reported')} l LEFT JOIN {POSITIVES} y USING (loan_number) WHERE {SLICE} AND naics_code IS NOT NULL AND borrower_state IS NOT NULL GROUP BY 1, 2",
        "profile_density": f"SELECT CAST(floor(log10(current_approval_amount / jobs_reported) / CAST(0.05 AS DOUBLE) + 0.5) AS INTEGER) AS ix, CAST(floor(log10(current_approval_amount) / CAST(0.05 AS DOUBLE) + 0.5) AS INTEGER) AS iy, count(*) AS n FROM {ln('current_approval_amount', 'jobs_reported')} WHERE {USABLE} GROUP BY 1, 2",
        "profile_peers": f"""WITH l AS {ln('naics_code', 'borrower_state', 'current_approval_amount', 'jobs_reported')}, c AS (SELECT naics_code, borrower_state, count(*) AS cs, median(current_approval_amount / jobs_reported) AS m FROM l WHERE {USABLE} GROUP BY 1, 2),
          t AS (SELECT y.loan_number, l.naics_code, l.borrower_state, current_approval_amount AS a, jobs_reported AS j, cs, m, CASE WHEN l.loan_number IS NULL THEN 'loan_not_found' WHEN coalesce(jobs_reported, 0) < 1 OR coalesce(current_approval_amount, 0) <= 0 THEN 'missing_jobs_or_amount' WHEN l.naics_code IS NULL OR l.borrower_state IS NULL THEN 'missing_cohort_key' WHEN coalesce(cs, 0) < 30 THEN 'cohort_too_small' END AS reason FROM {POSITIVES} y LEFT JOIN l USING (loan_number) LEFT JOIN c ON c.naics_code = l.naics_code AND c.borrower_state = l.borrower_state)
          SELECT loan_number, reason IS NULL AS available, reason, CASE WHEN reason IS NULL THEN naics_code || ' | ' || borrower_state END AS cohort, CASE WHEN reason IS NULL OR reason = 'cohort_too_small' THEN coalesce(cs, 0) END AS cohort_size, CASE WHEN reason IS NULL THEN round_even(a / j, 2) END AS amount_per_job, CASE WHEN reason IS NULL THEN round_even(m, 2) END AS cohort_median_amount_per_job, CASE WHEN reason IS NULL THEN round_even(a / j / m, 2) END AS x_cohort_median FROM t""",
        "profile_raw_composite": f"SELECT loan_number, round_even(max(score) + 0.5 * (count(*) - 1), 4) AS composite_score, count(*) AS n_signals, array_to_string(list_sort(list(DISTINCT detector_id)), ',') AS detectors FROM {SIGNALS} GROUP BY 1",
        "profile_case_files": f"SELECT case_id, loan_number, borrower_name, business_name, current_approval_amount, match_method, match_confidence, source_url, title FROM (SELECT DISTINCT * FROM fraud_cases WHERE loan_number IS NOT NULL) JOIN {ln('borrower_name', 'current_approval_amount')} l USING (loan_number) LEFT JOIN (SELECT url AS source_url, min(title) AS title FROM press_releases WHERE url IS NOT NULL GROUP BY 1) r USING (source_url)",
        "stream_rolling_counts": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    }
