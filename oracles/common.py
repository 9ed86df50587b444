"""Shared table expressions. `sql(body)` puts the ones a statement needs in front of it."""
from __future__ import annotations

import re


def r(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0e0)"


def uniform(text: str) -> str:
    """32 bits of the md5 of a text expression, as a number in [0, 1)."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def argmax(*e: str) -> str:
    a, b, c, d = (f"({x})" for x in e)
    return (f"CASE WHEN {a} >= {b} AND {a} >= {c} AND {a} >= {d} THEN 0 WHEN {b} >= {c} AND {b} >= {d} THEN 1 "
            f"WHEN {c} >= {d} THEN 2 ELSE 3 END")


NAME = "CASE {} WHEN 0 THEN 'Clothing' WHEN 1 THEN 'Gas stations' WHEN 2 THEN 'Food and grocery' WHEN 3 THEN 'Other' END"


def class_name(e: str) -> str:
    return NAME.format(f"({e})")


def class_code(e: str) -> str:
    return f"CASE {e} WHEN 'Clothing' THEN 0 WHEN 'Gas stations' THEN 1 WHEN 'Food and grocery' THEN 2 WHEN 'Other' THEN 3 ELSE 4 END"


CODE = ("CASE WHEN mcc BETWEEN 5600 AND 5699 OR mcc IN (5137, 5139, 5941) THEN 0 WHEN mcc IN (5541, 5542, 5983) THEN 1 "
        "WHEN mcc BETWEEN 5400 AND 5499 THEN 2 ELSE 3 END")
MCC_A = ("CASE o_orderpriority WHEN '1-URGENT' THEN 5411 WHEN '2-HIGH' THEN 5651 WHEN '3-MEDIUM' THEN 5541 "
         "WHEN '4-NOT SPECIFIED' THEN 4812 ELSE 5812 END")
LENGTHS = "(VALUES (4), (7), (9), (14))"

TABLES: dict[str, str] = {
    "tx_a": f"SELECT *, {CODE} AS code FROM (SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS dt, CAST(NULL AS VARCHAR) AS tm, "
            f"o_orderkey AS seq, o_totalprice AS amount, {MCC_A} AS mcc FROM orders)",
    "tx_b": f"SELECT *, {CODE} AS code FROM (SELECT user_id AS customer_id, CAST(ts AS DATE) AS dt, strftime(ts, '%H:%M:%S') AS tm, "
            "event_id AS seq, value AS amount, CASE event_type WHEN 'purchase' THEN 5411 WHEN 'click' THEN 5651 WHEN 'signup' THEN 5541 "
            "WHEN 'view' THEN 4812 ELSE 5812 END AS mcc FROM events)",
    "tx": "SELECT 'bank_a' AS bank, * FROM tx_a UNION ALL SELECT 'bank_b', * FROM tx_b",
    "rk": "SELECT *, row_number() OVER (PARTITION BY bank, customer_id ORDER BY dt DESC, tm DESC NULLS LAST, seq DESC) AS rn, "
          "count(*) OVER (PARTITION BY bank, customer_id) AS n FROM tx",
    "raw_demo": "SELECT c_custkey AS customer_id, CAST(18 + c_custkey % 60 AS INTEGER) AS age, CASE c_custkey % 2 WHEN 0 THEN 'male' ELSE 'female' END AS gender, "
                "CASE c_custkey % 3 WHEN 0 THEN 'married' WHEN 1 THEN 'single' ELSE 'divorced or widowed' END AS marital_status, "
                "CASE c_nationkey % 5 WHEN 0 THEN 'primary school' WHEN 1 THEN 'middle school' WHEN 2 THEN 'high school' WHEN 3 THEN 'university' "
                "ELSE 'graduate school' END AS education, CASE c_mktsegment WHEN 'MACHINERY' THEN 'private sector employee' "
                "WHEN 'BUILDING' THEN 'public sector employee' WHEN 'AUTOMOBILE' THEN 'self-employed' WHEN 'HOUSEHOLD' THEN 'not employed' "
                "ELSE 'retired' END AS occupation, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS income FROM customer",
    "demo": "SELECT d.*, CASE WHEN income <= q1 THEN 'low' WHEN income <= q2 THEN 'middle' ELSE 'high' END AS income_group FROM raw_demo d, "
            "(SELECT quantile_cont(income, 1/3::DOUBLE) AS q1, quantile_cont(income, 2/3::DOUBLE) AS q2 FROM raw_demo) WHERE income IS NOT NULL",
    # windows: pos 1 = oldest input, pos = length + 1 is the target
    "win": f"SELECT bank, x.length, customer_id, code, dt, amount, rn, x.length + 2 - rn AS pos, n FROM rk JOIN {LENGTHS} x(length) "
           "ON n >= x.length + 1 AND rn <= x.length + 1",
    "w": "SELECT bank, length, customer_id, max(n) AS n_txn, max(code) FILTER (rn = 1) AS truth, max(code) FILTER (rn = 2) AS lastc, "
         + ", ".join(f"count(*) FILTER (rn > 1 AND code = {k}) AS n{k}, min(rn) FILTER (rn > 1 AND code = {k}) AS r{k}" for k in range(4))
         + ", count(DISTINCT code) FILTER (rn > 1) AS classes, count(DISTINCT code) AS classes_all, "
         "date_diff('day', max(dt) FILTER (rn = length + 1), max(dt) FILTER (rn = 1)) AS span FROM win GROUP BY ALL",
    "modal": "SELECT *, " + argmax(*[f"n{k} * (length + 1) + CASE WHEN n{k} > 0 THEN length + 1 - r{k} ELSE -1 END" for k in range(4)]) + " AS modal FROM w",
    "activity": "SELECT bank, customer_id, max(n) AS n, count(DISTINCT code) FILTER (rn BETWEEN 2 AND 10) AS input_classes, "
                "count(DISTINCT code) FILTER (rn <= 10) AS window_classes FROM rk GROUP BY ALL",
    "cohort": "SELECT m.*, d.* EXCLUDE (customer_id) FROM modal m JOIN demo d USING (customer_id) WHERE length = 9 AND classes >= 2",
    # splits of the test recipe
    "elig": "SELECT bank, customer_id, input_classes >= 2 AS strict FROM activity WHERE n >= 10 AND customer_id IN (SELECT customer_id FROM demo)",
    "pool": "SELECT customer_id FROM elig WHERE bank = 'bank_a' AND strict ORDER BY md5('42:' || customer_id), customer_id LIMIT 400",
    "val": "SELECT customer_id FROM pool ORDER BY md5('42:val:' || customer_id), customer_id LIMIT (SELECT ceil(0.2 * count(*))::BIGINT FROM pool)",
    "dev": "SELECT customer_id FROM elig WHERE bank = 'bank_b' AND strict AND customer_id % 7 = 0",
    "used": "SELECT DISTINCT customer_id FROM tx_b WHERE customer_id % 7 = 0",
    "assignment": "SELECT customer_id, 'bank_a' AS bank, CASE WHEN customer_id IN (SELECT customer_id FROM val) THEN 'val' ELSE 'train' END AS split FROM pool "
                  "UNION ALL SELECT * FROM (SELECT customer_id, 'bank_a', 'bank_a_test' FROM elig WHERE bank = 'bank_a' AND strict AND customer_id NOT IN (SELECT customer_id FROM pool) "
                  "ORDER BY md5('42:test:' || customer_id), customer_id LIMIT 100) "
                  "UNION ALL SELECT customer_id, 'bank_b', 'bank_b_dev' FROM dev "
                  "UNION ALL SELECT customer_id, 'bank_b', 'bank_b_confirm' FROM elig WHERE bank = 'bank_b' AND strict AND customer_id NOT IN (SELECT customer_id FROM used) "
                  "UNION ALL SELECT customer_id, 'bank_b', 'bank_b_unfiltered' FROM elig WHERE bank = 'bank_b' AND customer_id NOT IN (SELECT customer_id FROM used)",
    "lastday": "SELECT bank, customer_id, count(*) AS on_last, count(DISTINCT code) AS classes FROM (SELECT *, max(dt) OVER (PARTITION BY bank, customer_id) AS top FROM tx) "
               "WHERE dt = top GROUP BY ALL",
}


def sql(body: str, **extra: str) -> str:
    """`body` with every table expression it mentions, directly or through another one, in front; names that end in _m are kept once made."""
    known = {**TABLES, **extra}
    done: list[str] = []

    def need(text, stack=()):
        for name in known:
            if name not in done and name not in stack and re.search(rf"\b{name}\b(?!\s*\.)(?!')", text):
                need(known[name], (*stack, name))
                done.append(name)

    need(body)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n.endswith('_m') else ''}({known[n]})" for n in done) + "\n" + body
