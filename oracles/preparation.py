from __future__ import annotations

from oracles.common import class_code, class_name, r, sql, uniform

AGE_BAND = "CASE WHEN age <= 29 THEN '<30' WHEN age <= 39 THEN '30-39' WHEN age <= 49 THEN '40-49' WHEN age <= 59 THEN '50-59' ELSE '60+' END"
SPAN_BAND = "CASE WHEN span <= 7 THEN '0-7 days' WHEN span <= 30 THEN '8-30 days' WHEN span <= 90 THEN '31-90 days' ELSE 'over 90 days' END"

RAW_TEXT = """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 97 = 0 THEN 'continuation' ELSE o_custkey::VARCHAR END AS cust,
 strftime(o_orderdate, '%-m/%-d/%Y') AS rday, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE
 lpad(((o_orderkey % 86400) // 3600)::VARCHAR, 2, '0') || '.' || lpad((((o_orderkey % 86400) // 60) % 60)::VARCHAR, 2, '0') || '.' || lpad(((o_orderkey % 86400) % 60)::VARCHAR, 2, '0') END AS clock,
 replace(CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR, '.', ',') AS amt,
 CASE o_orderpriority WHEN '1-URGENT' THEN '5411' WHEN '2-HIGH' THEN '5651' WHEN '3-MEDIUM' THEN '5541' WHEN '4-NOT SPECIFIED' THEN '4812' ELSE '5812' END AS mcode,
 CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE o_orderpriority END AS rtext FROM orders"""
TYPED = """SELECT seq, TRY_CAST(trim(cust) AS BIGINT) AS customer_id, strftime(TRY_STRPTIME(trim(rday), '%m/%d/%Y'), '%Y-%m-%d') AS dt,
 strftime(TRY_STRPTIME(trim(clock), '%H.%M.%S'), '%H:%M:%S') AS tm, TRY_CAST(replace(trim(amt), ',', '.') AS DOUBLE) AS amount, TRY_CAST(mcode AS DOUBLE)::INTEGER AS mcc,
 CASE WHEN NOT regexp_full_match(cust, '\\s*\\d+\\s*') THEN 'broken line' WHEN rtext IS NULL OR trim(rtext) = '' THEN 'empty RTEXT'
 WHEN TRY_STRPTIME(trim(rday), '%m/%d/%Y') IS NULL OR TRY_CAST(replace(trim(amt), ',', '.') AS DOUBLE) IS NULL OR TRY_CAST(mcode AS DOUBLE) IS NULL THEN 'missing value' END AS reject FROM raw_text"""
RAW_CUSTOMERS = """SELECT c_custkey AS seq, CASE WHEN c_custkey % 89 = 0 THEN 'continuation' ELSE c_custkey::VARCHAR END AS cust,
 CASE WHEN c_custkey % 41 = 0 THEN 'unknown' ELSE (18 + c_custkey % 60)::VARCHAR END AS age_text,
 CASE WHEN c_custkey % 37 = 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
 CASE c_custkey % 3 WHEN 0 THEN 'Married' WHEN 1 THEN ' Single' ELSE 'Divorced' END AS marital,
 CASE WHEN c_nationkey % 2 = 0 THEN 'College' ELSE 'High School' END AS school, c_mktsegment AS job,
 CASE WHEN c_acctbal >= 0 THEN replace(CAST(c_acctbal AS DECIMAL(18,2))::VARCHAR, '.', ',') END AS income_text FROM customer"""
EXPORTED = """SELECT TRY_CAST(trim(cust) AS BIGINT) AS customer_id, TRY_CAST(age_text AS INTEGER) AS age,
 CASE WHEN trim(sex) = '' THEN NULL WHEN trim(sex) = 'M' THEN 'male' WHEN trim(sex) = 'F' THEN 'female' END AS gender,
 CASE trim(marital) WHEN 'Married' THEN 'married' WHEN 'Single' THEN 'single' WHEN 'Divorced' THEN 'divorced or widowed' END AS marital_status,
 CASE trim(school) WHEN 'College' THEN 'university' WHEN 'High School' THEN 'high school' END AS education,
 CASE job WHEN 'MACHINERY' THEN 'private sector employee' WHEN 'BUILDING' THEN 'public sector employee' ELSE 'other occupation' END AS occupation,
 TRY_CAST(replace(income_text, ',', '.') AS DOUBLE) AS income, seq FROM raw_customers WHERE regexp_full_match(cust, '\\s*\\d+\\s*')"""
RAW = {"raw_text": RAW_TEXT, "typed": TYPED, "raw_customers": RAW_CUSTOMERS, "exported": EXPORTED}

ORACLES = {
    "load_transactions": sql(f"SELECT bank, customer_id, dt::VARCHAR AS date, tm AS time, {r('amount')} AS amount, mcc::BIGINT AS mcc, seq, {class_name('code')} AS category, code::BIGINT AS code FROM tx"),
    "canonical_order": sql("SELECT bank, customer_id, seq, rn FROM rk"),
    "load_demographics": sql(f"SELECT customer_id, age::BIGINT AS age, gender, marital_status, education, occupation, {r('income')} AS income, income_group FROM demo"),
    "complete_profiles": sql(f"""SELECT customer_id, age::BIGINT AS age, gender, marital_status, education, occupation, {r('income')} AS income FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY part) AS k FROM (
          SELECT *, 1 AS part FROM raw_demo WHERE income IS NOT NULL
          UNION ALL SELECT customer_id, age + 1, gender, marital_status, education, occupation, coalesce(income, 1), 2 FROM raw_demo)) WHERE k = 1"""),
    "deflate": sql(f"""SELECT customer_id, seq, {r('amount * ((100 + 15)::DOUBLE / (100 + (year(dt) - 1995) * 12 + month(dt) - 1)::DOUBLE)')} AS amount FROM tx_a"""),
    "read_ids": sql("SELECT customer_id FROM tx_a UNION SELECT customer_id FROM tx_b"),
    "row_fingerprints": "SELECT o_orderkey, sha256(concat_ws('|', o_custkey, o_orderstatus, o_orderpriority)) AS sha256 FROM orders",
    "manifest_diff": """WITH old AS (SELECT o_orderkey, sha256(concat_ws('|', o_custkey, o_orderstatus, o_orderpriority)) AS h FROM orders WHERE o_orderkey % 91 <> 0),
        cur AS (SELECT o_orderkey, sha256(concat_ws('|', o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END, o_orderpriority)) AS h FROM orders WHERE o_orderkey % 77 <> 0)
        SELECT * FROM (SELECT coalesce(old.o_orderkey, cur.o_orderkey) AS o_orderkey, CASE WHEN cur.h IS NULL THEN 'missing' WHEN old.h IS NULL THEN 'new' WHEN old.h <> cur.h THEN 'changed' END AS status
        FROM old FULL JOIN cur ON old.o_orderkey = cur.o_orderkey) WHERE status IS NOT NULL""",
    "export_transactions": sql(f"SELECT customer_id, dt AS date, tm AS time, {r('amount')} AS amount, mcc::BIGINT AS mcc, seq FROM typed WHERE reject IS NULL", **RAW),
    "export_rejects": sql("SELECT seq, reject FROM typed WHERE reject IS NOT NULL", **RAW),
    "export_report": sql("""SELECT unnest(['rows read', 'dropped: broken line', 'dropped: empty RTEXT', 'without a recorded time (kept)', 'dropped: missing date, amount or code', 'rows written', 'customers', 'first date', 'last date']) AS item,
        unnest([count(*)::VARCHAR, (count(*) FILTER (reject = 'broken line'))::VARCHAR, (count(*) FILTER (reject = 'empty RTEXT'))::VARCHAR,
          (count(*) FILTER (tm IS NULL AND (reject IS NULL OR reject = 'missing value')))::VARCHAR, (count(*) FILTER (reject = 'missing value'))::VARCHAR, (count(*) FILTER (reject IS NULL))::VARCHAR,
          (count(DISTINCT customer_id) FILTER (reject IS NULL))::VARCHAR, min(dt) FILTER (reject IS NULL), max(dt) FILTER (reject IS NULL)]) AS value FROM typed""", **RAW),
    "export_demographics": sql(f"SELECT customer_id, age::BIGINT AS age, gender, marital_status, education, occupation, {r('income')} AS income, seq FROM exported", **RAW),
    "demographics_report": sql("""SELECT field, level, count(*) AS n FROM (
        SELECT 'gender' AS field, coalesce(gender, '(missing)') AS level FROM exported UNION ALL SELECT 'marital_status', coalesce(marital_status, '(missing)') FROM exported
        UNION ALL SELECT 'education', coalesce(education, '(missing)') FROM exported UNION ALL SELECT 'occupation', coalesce(occupation, '(missing)') FROM exported
        UNION ALL SELECT 'customers', 'all' FROM exported UNION ALL SELECT 'customers', 'complete' FROM exported
          WHERE age IS NOT NULL AND gender IS NOT NULL AND marital_status IS NOT NULL AND education IS NOT NULL AND occupation IS NOT NULL AND income IS NOT NULL) GROUP BY ALL""", **RAW),
    "unlisted_labels": sql("""SELECT DISTINCT 'marital_status' AS field, trim(marital) AS label FROM raw_customers WHERE regexp_full_match(cust, '\\d+') AND trim(marital) <> 'Married'
        UNION SELECT DISTINCT 'occupation', trim(job) FROM raw_customers WHERE regexp_full_match(cust, '\\d+') AND trim(job) <> 'MACHINERY'""", **RAW),
    "raw_files": sql("""SELECT cust AS "CUST", rday AS "RDAY", clock AS "CLOCK", amt AS "AMT", mcode AS "CODE", nullif(rtext, '') AS "RTEXT", seq::VARCHAR AS "KEY",
        'order ' || seq || CASE seq % 3 WHEN 0 THEN chr(10) || 'said ' || chr(39) || 'yes; no' || chr(39) || chr(10) WHEN 1 THEN '; plain' ELSE '' END AS "NOTE" FROM raw_text""", **RAW),
    "csv_folder": sql(f"SELECT customer_id, strftime(dt, '%Y-%m-%d') || CASE WHEN customer_id % 2 = 0 THEN ' 00:00:00' ELSE ' 18:30:00' END AS date, {r('amount')} AS amount, mcc::BIGINT AS mcc, {class_name('code')} AS category FROM tx_a"),
    "file_manifest": "SELECT o_orderstatus AS status, sha256(string_agg(o_orderkey || chr(10), '' ORDER BY o_orderkey)) AS sha256 FROM orders GROUP BY 1",
    "map_categories": sql(f"""SELECT 'default' AS map, mcc::BIGINT AS mcc, {class_name('code')} AS category, count(*) AS n FROM tx_a GROUP BY ALL
        UNION ALL SELECT 'override', mcc, CASE WHEN mcc IN (5651, 5411) THEN 'Clothing' WHEN mcc = 4812 THEN 'Gas stations' ELSE 'Other' END AS c, count(*) FROM tx_a GROUP BY ALL"""),
    "season_filter": sql(f"SELECT {class_name('code')} AS category, count(*) AS n, min(dt)::VARCHAR AS first, max(dt)::VARCHAR AS last FROM tx_a WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY ALL"),
    "age_bands": sql(f"SELECT {AGE_BAND} AS band, count(*) AS n, min(age)::BIGINT AS lo, max(age)::BIGINT AS hi FROM demo GROUP BY ALL"),
    "span_slices": sql(f"SELECT bank, {SPAN_BAND} AS slice, count(*) AS n, min(span) AS lo, max(span) AS hi FROM w WHERE length = 9 GROUP BY ALL"),
    "encode_classes": f"""SELECT answer, ({class_code('answer')})::BIGINT AS code, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority
        ELSE ['Clothing', 'Gas stations', 'Food and grocery', 'Other'][o_orderkey % 4 + 1] END AS answer FROM orders) GROUP BY ALL""",
    "active_customers": sql("SELECT bank, customer_id, count(*) AS n_txn FROM tx GROUP BY ALL HAVING count(*) >= 10"),
    "class_shares": sql(f"SELECT bank, {class_name('code')} AS category, code::BIGINT AS code, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY bank)')} AS share FROM tx GROUP BY bank, code"),
    "eligible_customers": sql("""SELECT bank, customer_id, 'inputs' AS rule FROM activity WHERE n >= 10 AND input_classes >= 2
        UNION ALL SELECT bank, customer_id, 'with target' FROM activity WHERE n >= 10 AND window_classes >= 2
        UNION ALL SELECT bank, customer_id, 'three classes' FROM activity WHERE n >= 10 AND input_classes >= 3
        UNION ALL SELECT bank, customer_id, 'unfiltered' FROM activity WHERE n >= 10 AND input_classes >= 1
        UNION ALL SELECT bank, customer_id, 'profiled' FROM activity WHERE n >= 10 AND input_classes >= 2 AND customer_id IN (SELECT customer_id FROM demo)"""),
    "tie_report": sql(f"""SELECT bank, count(*) AS customers, count(*) FILTER (on_last >= 2) AS tied_last_date, {r('avg((on_last >= 2)::INT)')} AS tied_share,
        count(*) FILTER (on_last >= 2 AND classes > 1) AS tied_with_different_classes FROM lastday GROUP BY bank"""),
    "tied_customers": sql("SELECT bank, customer_id FROM lastday WHERE on_last >= 2"),
    "single_category_share": sql(f"SELECT bank, length::BIGINT AS length, count(*) AS customers, count(*) FILTER (classes = 1) AS single_category, {r('avg((classes = 1)::INT)')} AS share FROM w GROUP BY bank, length"),
    "cohort_funnel": sql("""SELECT bank, unnest(['customers with transactions', 'with complete demographics', 'with at least 10 transactions', 'eligible: at least 2 classes among the 9 inputs',
        'earlier rule: at least 2 classes among the last 10 (target included)']) AS step,
        unnest([count(*), count(*) FILTER (p), count(*) FILTER (p AND n >= 10), count(*) FILTER (p AND n >= 10 AND input_classes >= 2), count(*) FILTER (p AND n >= 10 AND window_classes >= 2)]) AS customers
        FROM (SELECT *, customer_id IN (SELECT customer_id FROM demo) AS p FROM activity) GROUP BY bank"""),
    "cohort_customers": sql("SELECT bank, customer_id, n_txn, span AS span_days, classes AS distinct_inputs, truth::BIGINT AS target, age::BIGINT AS age, gender, income_group FROM cohort"),
    "last_windows": sql(f"""SELECT bank, customer_id, string_agg(code::VARCHAR, ',' ORDER BY pos) FILTER (rn > 1) AS codes, string_agg(dt::VARCHAR, ',' ORDER BY pos) FILTER (rn > 1) AS dates,
        string_agg(CAST(round(amount, 2) AS DECIMAL(38,6))::VARCHAR, ',' ORDER BY pos) FILTER (rn > 1) AS amounts, {class_name('max(code) FILTER (rn = 1)')} AS ground_truth FROM win WHERE length = 9 GROUP BY bank, customer_id"""),
    "windows_at_lengths": sql("SELECT bank, customer_id, length::BIGINT AS length, string_agg(code::VARCHAR, ',' ORDER BY pos) FILTER (rn > 1) AS codes, (max(code) FILTER (rn = 1))::BIGINT AS target FROM win GROUP BY bank, customer_id, length"),
    "variable_windows": sql(f"""SELECT bank, customer_id, length, string_agg(code::VARCHAR, ',' ORDER BY rn DESC) FILTER (rn > 1) AS codes, (max(code) FILTER (rn = 1))::BIGINT AS target
        FROM (SELECT *, 4 + floor({uniform("'42:length:' || customer_id")} * (least(14, n - 1) - 4 + 1))::BIGINT AS length FROM rk WHERE n >= 5) WHERE rn <= length + 1 GROUP BY bank, customer_id, length"""),
    "draw_customers": sql("SELECT customer_id FROM activity WHERE bank = 'bank_a' AND n >= 10 AND input_classes >= 2 ORDER BY md5('42:' || customer_id), customer_id LIMIT 400"),
    "draw_excluding": sql("SELECT customer_id FROM activity WHERE bank = 'bank_a' AND n >= 10 AND input_classes >= 2 AND customer_id % 3 <> 0 ORDER BY md5('42:' || customer_id), customer_id LIMIT 100"),
    "train_val_split": sql("""SELECT customer_id, CASE WHEN row_number() OVER (ORDER BY md5('42:val:' || customer_id), customer_id) <= ceil(0.2 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split
        FROM activity WHERE bank = 'bank_a' AND n >= 10 AND input_classes >= 2"""),
    "prepare_splits": sql("SELECT customer_id, bank, split FROM assignment"),
    "prepare_splits_earlier_rule": sql("""SELECT customer_id, 'bank_a' AS bank, CASE WHEN row_number() OVER (ORDER BY md5('42:val:' || customer_id), customer_id) <= ceil(0.2 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split
        FROM (SELECT customer_id FROM activity WHERE bank = 'bank_a' AND n >= 10 AND window_classes >= 2 AND customer_id IN (SELECT customer_id FROM demo) ORDER BY md5('42:' || customer_id), customer_id LIMIT 400)
        UNION ALL SELECT * FROM (SELECT customer_id, 'bank_b', 'test' FROM activity WHERE bank = 'bank_b' AND n >= 10 AND window_classes >= 2 AND customer_id IN (SELECT customer_id FROM demo) ORDER BY md5('42:' || customer_id), customer_id LIMIT 50)"""),
    "split_summary": sql("SELECT bank, split, count(*) AS customers FROM assignment GROUP BY ALL"),
    "split_report": sql("""SELECT item, value FROM (VALUES ('seed', '42'), ('diversity on inputs', 'true'), ('min transactions', '10'), ('min distinct categories', '2'),
        ('categories', 'Clothing, Gas stations, Food and grocery, Other'), ('amounts', 'nominal')) v(item, value)
        UNION ALL SELECT 'eligible: ' || replace(bank, '_', ' '), count(*)::VARCHAR FROM elig WHERE strict GROUP BY bank
        UNION ALL SELECT 'excluded from confirmation: earlier list', count(*)::VARCHAR FROM used
        UNION ALL SELECT 'customers: ' || split, count(*)::VARCHAR FROM assignment GROUP BY split"""),
    "split_leakage_check": sql("""SELECT 'train and val' AS "check", (SELECT count(*) FROM assignment a JOIN assignment b USING (customer_id) WHERE a.split = 'train' AND b.split = 'val') AS overlap
        UNION ALL SELECT 'bank_a_test and pool', (SELECT count(*) FROM assignment a JOIN assignment b USING (customer_id) WHERE a.split = 'bank_a_test' AND b.split IN ('train', 'val'))
        UNION ALL SELECT 'bank_b_confirm and excluded', (SELECT count(*) FROM assignment WHERE split = 'bank_b_confirm' AND customer_id IN (SELECT customer_id FROM used))"""),
    "splits_table": sql("SELECT split, count(*) AS customers, count(*) FILTER (n >= 10) AS at_length_9, count(*) FILTER (n >= 15) AS at_length_14 FROM assignment JOIN activity USING (bank, customer_id) GROUP BY split"),
    "filter_counts": sql("SELECT split, " + ", ".join(
        f"count(*) FILTER (n > {x} AND c{x} = 1) AS single_at_{x}, {r(f'100 * count(*) FILTER (n > {x} AND c{x} = 1) / count(*) FILTER (n > {x})')} AS single_at_{x}_pct" for x in (4, 7, 9))
        + f", count(*) AS customers, count(*) FILTER (on_last >= 2) AS tied, {r('100 * avg((on_last >= 2)::INT)')} AS tied_pct, count(*) FILTER (on_last >= 2 AND classes > 1) AS tied_mixed "
        "FROM assignment JOIN (SELECT bank, customer_id, max(n) AS n, " + ", ".join(f"count(DISTINCT code) FILTER (rn BETWEEN 2 AND {x + 1}) AS c{x}" for x in (4, 7, 9))
        + " FROM rk GROUP BY ALL) USING (bank, customer_id) JOIN lastday USING (bank, customer_id) GROUP BY split"),
    "overlap_check": sql("""SELECT 200::BIGINT AS list_a, 300::BIGINT AS list_b, count(*) AS in_both, (200 * 300 / 1500)::DOUBLE AS expected FROM
        (SELECT customer_id FROM activity WHERE bank = 'bank_a' AND n >= 10 AND input_classes >= 2 ORDER BY md5('1:' || customer_id), customer_id LIMIT 200) JOIN
        (SELECT customer_id FROM activity WHERE bank = 'bank_a' AND n >= 10 AND input_classes >= 2 ORDER BY md5('2:' || customer_id), customer_id LIMIT 300) USING (customer_id)""")
        .replace("200::BIGINT", "least(200, (SELECT count(*) FROM activity WHERE bank = 'bank_a' AND n >= 10 AND input_classes >= 2))")
        .replace("300::BIGINT", "least(300, (SELECT count(*) FROM activity WHERE bank = 'bank_a' AND n >= 10 AND input_classes >= 2))"),
    "id_set_operations": sql("""SELECT 'union' AS how, customer_id FROM (SELECT customer_id FROM activity WHERE bank = 'bank_a' AND n >= 10 UNION SELECT customer_id FROM activity WHERE bank = 'bank_b' AND n >= 70)
        UNION ALL SELECT 'intersection', customer_id FROM (SELECT customer_id FROM activity WHERE bank = 'bank_a' AND n >= 10 INTERSECT SELECT customer_id FROM activity WHERE bank = 'bank_b' AND n >= 70)
        UNION ALL SELECT 'difference', customer_id FROM (SELECT customer_id FROM activity WHERE bank = 'bank_a' AND n >= 10 EXCEPT SELECT customer_id FROM activity WHERE bank = 'bank_b' AND n >= 70)"""),
    "cohort_count_check": sql("SELECT 'bank_a' AS bank, (SELECT count(*) FROM cohort WHERE bank = 'bank_a') AS cohort, (SELECT count(*) FROM elig WHERE bank = 'bank_a' AND strict) AS recorded, TRUE AS same"),
}
