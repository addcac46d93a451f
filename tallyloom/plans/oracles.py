"""The same results as SQL text for DuckDB."""

from __future__ import annotations

RAW = """
raw AS (
  SELECT o_orderkey + copy AS row_index,
    CASE WHEN o_orderkey % 89 = 0 THEN strftime(o_orderdate, '%d-%b-%Y')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
    c_name AS merchant,
    CASE WHEN o_orderkey % 83 <> 0 THEN '  ' || o_orderpriority || ' ' END AS description,
    CASE WHEN o_orderkey % 79 = 0 THEN 'N/A'
         WHEN o_orderkey % 97 = 0 THEN CAST(-o_totalprice AS VARCHAR)
         ELSE CAST(o_totalprice AS VARCHAR) END AS amount,
    c_mktsegment AS category
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN (VALUES (0), (10000000)) AS v(copy) ON copy = 0 OR o_orderkey % 101 = 0
)"""

CLEANED = RAW + """,
cleaned AS (
  SELECT row_index, date, merchant, coalesce(trim(description), 'nan') AS description,
    try_cast(amount AS DOUBLE) AS amount, category,
    CAST(try_strptime(date, '%Y-%m-%d') AS DATE) AS date_parsed
  FROM raw
)"""


def threshold(source: str) -> str:
    """The interpolated 95 % order statistic of ``source``, step by step."""
    return f""",
ranked AS (
  SELECT amount, row_number() OVER (ORDER BY amount) - 1 AS r FROM {source} WHERE amount IS NOT NULL
),
place AS (SELECT (count(*) - 1) * CAST(0.95 AS DOUBLE) AS p, count(*) AS n_amounts FROM ranked),
edges AS (
  SELECT n_amounts, p - floor(p) AS t,
    (SELECT amount FROM ranked, place WHERE r = floor(p)) AS low,
    (SELECT amount FROM ranked, place WHERE r = floor(p) + 1) AS high
  FROM place
),
threshold AS (
  SELECT n_amounts, CASE WHEN t = 0 THEN low
    WHEN t >= CAST(0.5 AS DOUBLE) THEN high - (high - low) * (1 - t)
    ELSE low + (high - low) * t END AS high_thresh
  FROM edges
)"""


def ruled(source: str) -> str:
    return threshold(source) + f""",
marked AS (
  SELECT *, amount > high_thresh AS is_high, amount < 0 AS is_negative,
    count(*) OVER (PARTITION BY date, amount, merchant, description) > 1 AS is_duplicate
  FROM {source} CROSS JOIN threshold
),
-- Fixed values: the reason texts.
reasoned AS (
  SELECT *, concat_ws(', ',
    CASE WHEN is_high THEN printf('Unusually high amount (> %.2f)', high_thresh) END,
    CASE WHEN is_negative THEN 'Negative amount (possible refund or data issue)' END,
    CASE WHEN is_duplicate THEN 'Possible duplicate transaction' END) AS anomaly_reasons_rule
  FROM marked
),
ruled AS (SELECT *, anomaly_reasons_rule <> '' AS is_anomaly_rule FROM reasoned)"""


PREDICTIONS = """,
predictions AS (
  SELECT row_index AS row, CASE WHEN row_index % 59 <> 0 THEN category END AS category_llm,
    row_index % 37 = 0 AS suspicious_llm,
    CASE WHEN row_index % 37 = 0 THEN 'Unusual pattern' ELSE 'Looks normal' END AS suspicious_reason_llm,
    CAST(row_index % 100 AS DOUBLE) / 100 AS confidence_llm
  FROM cleaned WHERE row_index % 53 <> 0
)"""


def merge(source: str, name: str, predictions: str = "predictions") -> str:
    return f""",
{name} AS (
  SELECT s.*,
    CASE WHEN row IS NOT NULL THEN category_llm ELSE '' END AS category_llm,
    CASE WHEN row IS NOT NULL THEN suspicious_llm ELSE false END AS suspicious_llm,
    CASE WHEN row IS NOT NULL THEN suspicious_reason_llm ELSE '' END AS suspicious_reason_llm,
    confidence_llm
  FROM {source} s LEFT JOIN {predictions} ON s.row_index = row
)"""


MERGED = CLEANED + PREDICTIONS + merge("cleaned", "merged")
RULED = CLEANED + ruled("cleaned")
ENRICHED = RULED + PREDICTIONS + merge("ruled", "enriched")
FLAGGED = ENRICHED + """,
flagged AS (
  SELECT *,
    CASE WHEN is_anomaly_rule AND suspicious_llm THEN 'Rule-based + AI'
         WHEN is_anomaly_rule THEN 'Rule-based only'
         WHEN suspicious_llm THEN 'AI only' ELSE 'Unknown' END AS analysis_source,
    coalesce(nullif(concat_ws(' | ', nullif(trim(anomaly_reasons_rule), ''),
      CASE WHEN trim(suspicious_reason_llm) <> '' THEN 'AI: ' || trim(suspicious_reason_llm) END), ''), '—')
      AS combined_reason,
    CASE WHEN trim(coalesce(category_llm, '')) = '' THEN '—' ELSE category_llm END AS category_display,
    CASE WHEN confidence_llm > 0 THEN printf('%.2f', confidence_llm) ELSE '—' END AS confidence_display
  FROM enriched WHERE is_anomaly_rule OR suspicious_llm
)"""

MONEY = "coalesce(CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE), 0)"

TOTALS = f""",
totals AS (
  SELECT count(*) AS total_transactions, count(amount) AS transactions_with_amount,
    {MONEY} AS total_amount,
    CAST(count(*) FILTER (WHERE is_anomaly_rule) AS BIGINT) AS rule_anomalies,
    CAST(count(*) FILTER (WHERE suspicious_llm) AS BIGINT) AS suspicious_transactions,
    CAST(count(*) FILTER (WHERE is_anomaly_rule OR suspicious_llm) AS BIGINT) AS num_anomalies
  FROM enriched
)"""


def categories(source: str) -> str:
    return f""",
categories AS (
  SELECT category_llm, {MONEY} AS amount FROM {source} WHERE category_llm IS NOT NULL GROUP BY category_llm
),
shares AS (
  SELECT category_llm, amount, coalesce(amount / nullif(total, 0), 0) * 100 AS percent,
    row_number() OVER (ORDER BY amount DESC, category_llm) AS line_no
  FROM categories CROSS JOIN (SELECT {MONEY} AS total FROM {source})
)"""


FIRST_TEN = """,
first_ten AS (
  SELECT *, row_number() OVER (ORDER BY row_index) AS line_no FROM flagged ORDER BY row_index LIMIT 10
)"""

REPORT = FLAGGED + TOTALS + categories("enriched") + FIRST_TEN + """,
report AS (
  SELECT '1 totals' AS section, 1 AS line_no, 'Total transactions: ' || total_transactions AS line FROM totals
  UNION ALL SELECT '1 totals', 2, 'Total amount: ' || format('{:,.2f}', total_amount) FROM totals
  UNION ALL SELECT '1 totals', 3, 'Total anomalies: ' || num_anomalies FROM totals
  UNION ALL SELECT '2 categories', line_no, '- ' || category_llm || ': ' || format('{:,.2f}', amount) FROM shares
  UNION ALL SELECT '3 anomalies', line_no, concat_ws(' | ', date,
    coalesce(format('{:,.2f}', amount), 'nan'), merchant, anomaly_reasons_rule) FROM first_ten
)"""

EDITED = """,
edited AS (
  SELECT * REPLACE (
    CASE WHEN row_index % 41 = 0 AND row_index % 5 = 0 THEN '1997-01-15' ELSE date END AS date,
    CASE WHEN row_index % 41 <> 0 OR row_index % 3 = 2 THEN amount
         WHEN row_index % 3 = 0 THEN amount * 3 END AS amount,
    CASE WHEN row_index % 41 = 0 AND row_index % 2 = 0 THEN 'Edited' ELSE category_llm END AS category_llm,
    CASE WHEN row_index % 41 = 0 AND row_index % 5 = 0 THEN DATE '1997-01-15' ELSE date_parsed END AS date_parsed)
  FROM merged
)"""

NUMBERED = CLEANED + """,
numbered AS (SELECT *, row_number() OVER (ORDER BY row_index) - 1 AS pos FROM cleaned),
batched AS (
  SELECT *, pos // 20 AS batch_id, min(row_index) OVER b AS first_row, max(row_index) OVER b AS last_row
  FROM numbered WINDOW b AS (PARTITION BY pos // 20)
)"""

CLASSIFIED = NUMBERED + """,
classified AS (
  SELECT row_index AS row,
    CASE description[1] WHEN '1' THEN 'Travel' WHEN '2' THEN 'Software' WHEN '3' THEN 'Meals'
      WHEN '4' THEN 'Utilities' WHEN '5' THEN 'Miscellaneous' ELSE 'Other' END AS category_llm,
    amount IS NULL AS suspicious_llm,
    CASE WHEN amount IS NULL THEN 'No amount' ELSE 'Looks normal' END AS suspicious_reason_llm,
    CAST(row_index % 100 AS DOUBLE) / 100 AS confidence_llm, pos
  FROM numbered
)"""

GENERATED = """
hashed AS (SELECT o_orderkey AS id, sha256('42:' || o_orderkey) AS h FROM orders),
drawn AS (
  SELECT id, list_transform([1, 9, 17, 25, 33, 41, 49],
    lambda x: CAST(CAST('0x' || substr(h, x, 8) AS BIGINT) AS DOUBLE) / 4294967296) AS u
  FROM hashed
),
chosen AS (
  SELECT id, u, CASE WHEN u[1] < 0.2 THEN 'Travel' WHEN u[1] < 0.45 THEN 'Meals' WHEN u[1] < 0.6 THEN 'Software'
    WHEN u[1] < 0.7 THEN 'Utilities' WHEN u[1] < 0.85 THEN 'Office' WHEN u[1] < 0.9 THEN 'Salary'
    ELSE 'Miscellaneous' END AS c
  FROM drawn
),
-- Fixed values: merchants, error rows and labels.
named AS (
  SELECT *, CASE c
    WHEN 'Travel' THEN ['Uber', 'United Airlines', 'Marriott Hotel', 'Shell Gas Station']
    WHEN 'Meals' THEN ['Starbucks', 'McDonald''s', 'Chipotle', 'Pizza Hut']
    WHEN 'Software' THEN ['AWS', 'OpenAI API', 'GitHub', 'Microsoft 365']
    WHEN 'Utilities' THEN ['Electric Co', 'Water Department', 'Comcast Internet']
    WHEN 'Office' THEN ['Staples', 'Office Depot', 'Amazon Business']
    WHEN 'Salary' THEN ['Payroll - Employee']
    ELSE ['Walmart', 'Target', 'CVS Pharmacy'] END AS names,
    CASE c WHEN 'Travel' THEN 25 WHEN 'Software' THEN 15 WHEN 'Salary' THEN 3000 ELSE 10 END AS low,
    CASE c WHEN 'Travel' THEN 400 WHEN 'Software' THEN 150 WHEN 'Salary' THEN 5000 ELSE 120 END AS high
  FROM chosen
),
generated AS (
  SELECT 'TXN' || (id + 1000) AS transaction_id,
    strftime(DATE '2025-01-01' + CAST(floor(u[4] * 90) AS INTEGER), '%Y-%m-%d') AS date,
    names[CAST(floor(u[2] * len(names)) AS INTEGER) + 1] AS merchant,
    names[CAST(floor(u[2] * len(names)) AS INTEGER) + 1] AS description,
    (floor(u[3] * ((high - low) * 100) + CAST(0.5 AS DOUBLE)) + low * 100) / 100 AS amount,
    'USD' AS currency,
    ['Credit Card', 'Debit Card', 'Bank Transfer', 'Cash'][CAST(floor(u[5] * 4) AS INTEGER) + 1] AS payment_method,
    ['New York, NY', 'San Francisco, CA', 'Chicago, IL', 'Austin, TX', 'Boston, MA']
      [CAST(floor(u[6] * 5) AS INTEGER) + 1] AS location,
    CASE WHEN u[7] <= CAST(0.3 AS DOUBLE) THEN 'Business expense' ELSE '' END AS notes
  FROM named
  UNION ALL VALUES
    ('TXN2001', '2025-02-15', 'Unknown Store', '', 75.50, 'USD', 'Credit Card', 'New York, NY', ''),
    ('TXN2002', '15-Feb-2025', 'Best Buy', 'Best Buy Electronics', 199.99, 'USD', 'Debit Card', 'Chicago, IL', 'Office supplies'),
    ('TXN2003', '2025-02-20', 'Suspicious Vendor LLC', 'Large Equipment Purchase', 9500, 'USD', 'Bank Transfer', 'Austin, TX', 'Urgent purchase'),
    ('TXN2004', '2025-01-25', 'Starbucks', 'Starbucks Coffee', 45.67, 'USD', 'Credit Card', 'San Francisco, CA', 'Team meeting'),
    ('TXN2005', '2025-01-25', 'Starbucks', 'Starbucks Coffee', 45.67, 'USD', 'Credit Card', 'San Francisco, CA', 'Team meeting'),
    ('TXN2006', '2025-03-01', 'Refund Processing', 'Refund', -150, 'USD', 'Credit Card', 'Boston, MA', 'Return')
)"""

LABELLED = GENERATED + """,
labelled AS (
  SELECT amount, CASE
    WHEN merchant IN ('Uber', 'United Airlines', 'Marriott Hotel', 'Shell Gas Station') THEN 'Travel'
    WHEN merchant IN ('Starbucks', 'McDonald''s', 'Chipotle', 'Pizza Hut') THEN 'Meals'
    WHEN merchant IN ('AWS', 'OpenAI API', 'GitHub', 'Microsoft 365') THEN 'Software'
    WHEN merchant IN ('Electric Co', 'Water Department', 'Comcast Internet') THEN 'Utilities'
    WHEN merchant IN ('Staples', 'Office Depot', 'Amazon Business') THEN 'Office Supplies'
    WHEN merchant IN ('Payroll - Employee') THEN 'Salary'
    WHEN merchant IN ('Walmart', 'Target', 'CVS Pharmacy') THEN 'Miscellaneous'
    ELSE 'Other' END AS category_llm
  FROM generated
)"""

PREDICTION = "category_llm, suspicious_llm, suspicious_reason_llm, confidence_llm"
RULE_COLUMNS = "row_index, amount, anomaly_reasons_rule, is_anomaly_rule"
SHARE = "SELECT category_llm, amount, round_even(percent * 10, 0) / 10 AS Percent FROM shares"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


ORACLES: dict[str, str] = {
    "clean_ledger": _with(CLEANED, "SELECT * FROM cleaned"),
    "null_tokens": _with(
        RAW, "SELECT row_index, merchant, description, nullif(amount, 'N/A') AS amount, category FROM raw"
    ),
    "drop_blank_rows": _with(RAW, "SELECT row_index, merchant, category FROM raw WHERE row_index % 71 <> 0"),
    "date_parse_failures": _with(CLEANED, "SELECT row_index, date FROM cleaned WHERE date_parsed IS NULL"),
    "second_date_format": _with(
        RAW,
        "SELECT row_index, CAST(coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%d-%b-%Y')) AS DATE)"
        " AS date_parsed FROM raw",
    ),
    "inferred_dates": "SELECT o_orderkey AS row_index, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END"
    " AS date_parsed FROM orders",
    "quantile_threshold": _with(
        CLEANED + threshold("cleaned"),
        "SELECT n_amounts, high_thresh, printf('%.2f', high_thresh) AS threshold_text FROM threshold",
    ),
    "approx_threshold": _with(CLEANED, "SELECT count(amount) AS n_amounts, true AS rank_holds FROM cleaned"),
    "threshold_attached": _with(
        RULED, "SELECT row_index, amount, high_thresh, coalesce(is_high, false) AS is_high FROM ruled"
    ),
    "high_amounts": _with(RULED, "SELECT row_index, amount FROM ruled WHERE is_high"),
    "negative_amounts": _with(CLEANED, "SELECT row_index, amount FROM cleaned WHERE amount < 0"),
    "duplicate_keys": _with(
        CLEANED,
        "SELECT date, amount, merchant, description, count(*) AS n FROM cleaned"
        " GROUP BY date, amount, merchant, description HAVING count(*) > 1",
    ),
    "duplicate_rows": _with(RULED, "SELECT row_index, date, amount, merchant FROM ruled WHERE is_duplicate"),
    "hot_duplicate_rows": _with(
        CLEANED,
        "SELECT row_index, count(*) OVER (PARTITION BY date_parsed, description) > 1 AS is_duplicate FROM cleaned",
    ),
    "rule_anomalies": _with(RULED, f"SELECT {RULE_COLUMNS} FROM ruled"),
    "rule_anomaly_counts": _with(
        RULED,
        "SELECT anomaly_reasons_rule, count(*) AS n, CAST(count(*) FILTER (WHERE is_anomaly_rule) AS BIGINT)"
        " AS n_flagged FROM ruled GROUP BY anomaly_reasons_rule",
    ),
    "kpi_totals": _with(ENRICHED + TOTALS, "SELECT * FROM totals"),
    "measure_cells": _with(
        ENRICHED,
        "SELECT coalesce(strftime(date_parsed, '%Y-%m'), 'NaT') AS month, category_llm, count(*) AS n, count(amount) AS n_amounts,"
        " count(*) FILTER (is_anomaly_rule) AS n_rule, count(*) FILTER (suspicious_llm) AS n_suspicious,"
        f" count(*) FILTER (is_anomaly_rule OR suspicious_llm) AS n_flagged, {MONEY} AS amount FROM enriched GROUP BY 1, 2",
    ),
    "totals_of_cells": _with(ENRICHED + TOTALS, "SELECT * FROM totals"),
    "category_totals": _with(MERGED + categories("merged"), "SELECT category_llm, amount FROM shares"),
    "category_share": _with(MERGED + categories("merged"), SHARE),
    "monthly_trend": _with(
        MERGED,
        f"SELECT coalesce(strftime(date_parsed, '%Y-%m'), 'NaT') AS month, category_llm, {MONEY} AS amount"
        " FROM merged WHERE category_llm IS NOT NULL GROUP BY ALL",
    ),
    "merchant_lookup": _with(
        CLEANED,
        "SELECT row_index, merchant, coalesce(c_mktsegment, 'Other') AS category_llm FROM cleaned"
        " LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON merchant = c_name",
    ),
    "strict_labels": _with(
        CLEANED,
        "SELECT row_index, merchant, CASE WHEN c_custkey % 3 = 0 THEN 'Travel' ELSE 'Other' END AS category_llm"
        " FROM cleaned LEFT JOIN customer ON merchant = c_name",
    ),
    "batch_assignment": _with(NUMBERED, "SELECT row_index, batch_id FROM batched"),
    "interactive_batches": _with(NUMBERED, "SELECT row_index, pos // 10 AS batch_id FROM numbered"),
    "sparse_key_batches": _with(
        CLEANED + """,
        far AS (SELECT (row_index * 7919 + 13) * CASE WHEN row_index % 2 = 0 THEN 1 ELSE -1 END AS row_index FROM cleaned)""",
        "SELECT row_index, (row_number() OVER (ORDER BY row_index) - 1) // 20 AS batch_id FROM far",
    ),
    "batch_payloads": _with(
        NUMBERED,
        "SELECT batch_id, first_row, last_row, row_index, date, amount, merchant, description, '' AS currency"
        " FROM batched",
    ),
    "parse_responses": _with(
        NUMBERED,
        "SELECT row_index, CASE row_index % 7 WHEN 0 THEN 'Meals' WHEN 1 THEN 'Other' WHEN 3 THEN 'Travel'"
        " WHEN 4 THEN 'Salary' WHEN 5 THEN 'Second' END AS category_llm,"
        " row_index % 7 = 0 AS suspicious_llm,"
        " CASE WHEN row_index % 7 = 0 THEN 'Odd' ELSE '' END AS suspicious_reason_llm,"
        " CASE row_index % 7 WHEN 0 THEN CAST(0.75 AS DOUBLE) WHEN 3 THEN CAST(0.5 AS DOUBLE)"
        " ELSE CAST(0 AS DOUBLE) END AS confidence_llm"
        " FROM batched WHERE row_index % 7 <> 6 AND batch_id % 13 <> 0",
    ),
    "merged_predictions": _with(MERGED, f"SELECT row_index, {PREDICTION} FROM merged"),
    "classified_rows": _with(CLASSIFIED, f"SELECT row AS row_index, {PREDICTION} FROM classified"),
    "logged_answers": _with(CLASSIFIED, f"SELECT row AS row_index, {PREDICTION} FROM classified"),
    "failed_batches": _with(
        NUMBERED,
        "SELECT DISTINCT batch_id, first_row, last_row, 'TimeoutError: no answer' AS error FROM batched WHERE first_row % 13 = 0",
    ),
    "flagged_rows": _with(FLAGGED, "SELECT row_index, amount, category_llm FROM flagged"),
    "anomaly_sources": _with(FLAGGED, "SELECT analysis_source, count(*) AS n FROM flagged GROUP BY analysis_source"),
    "combined_reasons": _with(FLAGGED, "SELECT row_index, combined_reason FROM flagged"),
    "anomaly_display": _with(
        FLAGGED,
        "SELECT row_index, date, amount, merchant, description, analysis_source, combined_reason,"
        " category_display, confidence_display FROM flagged",
    ),
    "first_ten_anomalies": _with(
        FLAGGED + FIRST_TEN, "SELECT row_index, date, amount, merchant, anomaly_reasons_rule FROM first_ten"
    ),
    "suspicious_counts": _with(
        MERGED, "SELECT CAST(count(*) FILTER (WHERE suspicious_llm) AS BIGINT) AS n_suspicious FROM merged"
    ),
    "preview_rows": _with(
        CLEANED, "SELECT row_index, date, merchant, amount FROM cleaned ORDER BY row_index LIMIT 20"
    ),
    "edit_overlay": _with(
        MERGED + EDITED, "SELECT row_index, date, amount, category_llm, merchant, date_parsed FROM edited"
    ),
    "reanalysed_ledger": _with(
        MERGED + EDITED + ruled("edited"), f"SELECT {RULE_COLUMNS}, category_llm, suspicious_llm FROM ruled"
    ),
    "review_view": _with(
        ENRICHED,
        "SELECT row_index, date, amount, merchant, description, category_llm, anomaly_reasons_rule,"
        " suspicious_llm, confidence_llm FROM enriched",
    ),
    "summary_json": _with(
        FLAGGED + TOTALS + categories("enriched") + FIRST_TEN,
        "SELECT '1 totals' AS section, CAST(1 AS BIGINT) AS line_no, total_transactions, total_amount, num_anomalies,"
        " CAST(NULL AS VARCHAR) AS category_llm, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS date,"
        " CAST(NULL AS VARCHAR) AS merchant, CAST(NULL AS VARCHAR) AS description,"
        " CAST(NULL AS VARCHAR) AS anomaly_reasons_rule, CAST(NULL AS VARCHAR) AS suspicious_reason_llm FROM totals"
        " UNION ALL SELECT '2 categories', line_no, NULL, NULL, NULL, category_llm, amount, NULL, NULL, NULL, NULL, NULL FROM shares"
        " UNION ALL SELECT '3 anomalies', line_no, NULL, NULL, NULL, NULL, amount, date, merchant, description,"
        " anomaly_reasons_rule, suspicious_reason_llm FROM first_ten",
    ),
    "report_lines": _with(REPORT, "SELECT section, CAST(line_no AS BIGINT) AS line_no, line FROM report"),
    "summary_lines": _with(
        ENRICHED + TOTALS + categories("enriched"),
        "SELECT '1 basic' AS section, CAST(1 AS BIGINT) AS line_no,"
        " 'Total transactions: ' || total_transactions AS line FROM totals"
        " UNION ALL SELECT '1 basic', 2, printf('Total amount: %.2f', total_amount) FROM totals"
        " UNION ALL SELECT '2 categories', line_no,"
        " printf('- %s: %.2f (%.1f%%)', category_llm, amount, percent) FROM shares"
        " UNION ALL SELECT '3 anomalies', 1, 'Rule-based anomalies flagged: ' || rule_anomalies FROM totals"
        " UNION ALL SELECT '3 anomalies', 2, 'LLM-suspicious transactions: ' || suspicious_transactions FROM totals",
    ),
    "generated_ledger": _with(GENERATED, "SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM generated"),
    "shuffled_order": "SELECT count(*) AS n, count(*) AS n_places, count(*) - 1 AS last_place, true AS mixed,"
    " count(*) AS n_same_again FROM orders",
    "generated_category_share": _with(LABELLED + categories("labelled"), SHARE),
    "csv_round_trip": _with(
        CLEANED,
        "SELECT CAST(row_index AS VARCHAR) AS transaction_id, date, merchant, description, amount, category,"
        " date_parsed FROM cleaned",
    ),
    "quoted_csv_round_trip": _with(
        RAW,
        "SELECT CAST(row_index AS VARCHAR) AS transaction_id, CASE WHEN amount <> 'N/A' THEN amount END AS amount, category,"
        " CASE WHEN row_index % 3 = 0 THEN 'one, \"two\"' || chr(10) || chr(10) || '\",' || chr(10) || description || chr(10) || '\"'"
        " ELSE description END AS description FROM raw",
    ),
    "numbered_rows": _with(
        CLEANED,
        "SELECT count(*) AS n, CAST(0 AS BIGINT) AS first_row, count(*) - 1 AS last_row, count(*) AS n_distinct"
        " FROM cleaned",
    ),
    "file_order": _with(
        RAW, "SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, row_index AS transaction_id FROM raw"
    ),
    "enriched_export": _with(
        ENRICHED,
        "SELECT date, merchant, description, category, amount, date_parsed, nullif(anomaly_reasons_rule, '')"
        " AS anomaly_reasons_rule, is_anomaly_rule, coalesce(category_llm, '') AS category_llm,"
        " suspicious_llm, nullif(suspicious_reason_llm, '') AS suspicious_reason_llm, confidence_llm,"
        " coalesce(strftime(date_parsed, '%Y-%m'), 'NaT') AS month FROM enriched",
    ),
    "review_export": _with(
        ENRICHED,
        "SELECT date, amount, merchant, description, coalesce(category_llm, '') AS category_llm,"
        " anomaly_reasons_rule, suspicious_llm, confidence_llm FROM enriched",
    ),
    "parquet_export": _with(
        ENRICHED,
        f"SELECT row_index, date, merchant, description, amount, category, date_parsed, anomaly_reasons_rule, is_anomaly_rule,"
        f" {PREDICTION}, coalesce(strftime(date_parsed, '%Y-%m'), 'NaT') AS month FROM enriched",
    ),
    "pending_review_export": _with(
        ENRICHED + EDITED.replace("FROM merged", "FROM enriched"),
        "SELECT row_index, date, amount, merchant, description, coalesce(category_llm, '') AS category_llm, anomaly_reasons_rule,"
        " suspicious_llm, confidence_llm FROM edited",
    ),
    "optional_columns_absent": _with(
        CLEANED.replace("date, merchant, coalesce", "date, coalesce") + ruled("cleaned").replace("date, amount, merchant, description", "date, amount, description"),
        "SELECT row_index, date, amount, description, anomaly_reasons_rule AS combined_reason, 'Other' AS category_display"
        " FROM ruled WHERE is_anomaly_rule",
    ),
    "report_export": _with(REPORT, "SELECT line FROM report"),
}
