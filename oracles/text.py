from __future__ import annotations

from oracles.common import sql
from oracles.evaluation import TABLES as PRED, metrics, ALL

INSTRUCTION = "Based on the information about me below, predict the category of my next purchase. Answer with one of: "
FULL_LABELS, NEUTRAL_LABELS = "Clothing, Gas stations, Food and grocery, Other.", "A, B, C, D."
WORD = "CASE code WHEN 0 THEN 'Clothing' WHEN 1 THEN 'Gas stations' WHEN 2 THEN 'Food and grocery' ELSE 'Other' END"
LETTER = "CASE code WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END"
listed = lambda e: f"string_agg({e}, ', ' ORDER BY pos) FILTER (rn > 1)"
PARTS = {
    "ptx": f"SELECT bank, customer_id, max(code) FILTER (rn = 1) AS truth, 'I made 9 purchases. Their categories, oldest first: ' || {listed(WORD)} || '.' AS cats, "
           f"'I made 9 purchases. Their categories, oldest first: ' || {listed(LETTER)} || '.' AS letters, ' Their dates, oldest first: ' || {listed('dt::VARCHAR')} || '.' AS dates, "
           f"' Their amounts, oldest first: ' || {listed(chr(39) + 'TL ' + chr(39) + ' || amount::DECIMAL(18,2)::VARCHAR')} || '. In total I spent TL ' || (sum(amount::DECIMAL(24,6)) FILTER (rn > 1))::DECIMAL(28,2)::VARCHAR || '.' AS amounts "
           "FROM win WHERE length = 9 GROUP BY bank, customer_id",
    "ptext": "SELECT p.*, d.* EXCLUDE (customer_id), 'I am ' || age || ' years old, ' || marital_status || ' ' || gender || ', ' || education || ' graduate, and ' || occupation || '.' AS who, "
             "' In terms of my income, I belong to the ' || income_group || ' income group.' AS money FROM ptx p JOIN demo d USING (customer_id)",
}
RESPONSE = WORD.replace("code", "truth") + " || '.'"


def sample(text: str, neutral=False, where="TRUE", extra="") -> str:
    response = (LETTER.replace("code", "truth") + " || '.'") if neutral else RESPONSE
    return (f"SELECT {extra}customer_id, '{INSTRUCTION}{NEUTRAL_LABELS if neutral else FULL_LABELS}' AS instruction, {text} AS input, {response} AS response, truth::BIGINT AS target_class FROM ptext WHERE {where}")


ONE = "bank = 'bank_a'"
COND = {"seq": "cats", "seq+amounts": "cats || amounts", "seq+dates": "cats || dates", "seq+demographics": "who || money || ' ' || cats", "seq+amounts+dates": "cats || dates || amounts",
        "seq+amounts+demographics": "who || money || ' ' || cats || amounts", "seq+dates+demographics": "who || money || ' ' || cats || dates", "neutral": "letters"}
WHOLE = " || money || ' ' || cats || dates || amounts"
MINUS = {
    "gender": "'I am ' || age || ' years old, ' || marital_status || ', ' || education || ' graduate, and ' || occupation || '.'" + WHOLE,
    "age": "'I am ' || marital_status || ' ' || gender || ', ' || education || ' graduate, and ' || occupation || '.'" + WHOLE,
    "marital_status": "'I am ' || age || ' years old, ' || gender || ', ' || education || ' graduate, and ' || occupation || '.'" + WHOLE,
    "education": "'I am ' || age || ' years old, ' || marital_status || ' ' || gender || ', and ' || occupation || '.'" + WHOLE,
    "occupation": "'I am ' || age || ' years old, ' || marital_status || ' ' || gender || ', and ' || education || ' graduate.'" + WHOLE,
    "income_group": "who || ' ' || cats || dates || amounts",
}


def shots(k: int) -> dict:
    return {"shot": f"SELECT *, row_number() OVER (ORDER BY md5('42:order:' || customer_id), customer_id) AS position FROM (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY md5('42:shot:' || customer_id), customer_id) AS k_ FROM ptext WHERE {ONE}) WHERE k_ <= {k}"}


def t(body: str, **extra) -> str:
    return sql(body, **{**PRED, **PARTS, **extra})


# a number starts a text or follows a character that is neither a word character nor a dot; the next one may not be either
FOUND = ("SELECT {key}, regexp_replace(m, '^[-+−]', '') AS number FROM (SELECT {key}, unnest(regexp_extract_all({text}, '(^|[^\\w.+−-]|[^\\w.])([-+−]?\\d*\\.\\d+)($|[^\\w.])', 2)) AS m FROM {source})")


def traced(key: str, text: str, source: str, known: str) -> str:
    # separators are doubled, so that one separator between two numbers serves both of them
    spaced = f"regexp_replace({text}, '([^\\w.])', '\\1 \\1', 'g')"
    return (f"SELECT {key}, number, decimals FROM (SELECT *, length(split_part(number, '.', 2))::BIGINT AS decimals FROM ({FOUND.format(key=key, text=spaced, source=source)})) f "
            f"WHERE number NOT IN ('0.05', '0.95', '0.80', '1.96', '2.80', '0.10', '0.25') AND decimals BETWEEN 1 AND 4 AND NOT EXISTS (SELECT 1 FROM ({known}) k WHERE k.d = f.decimals AND k.v = f.number::DOUBLE)")


rounded = lambda src: f"SELECT DISTINCT d, CASE d WHEN 1 THEN round_even(abs(x), 1) WHEN 2 THEN round_even(abs(x), 2) WHEN 3 THEN round_even(abs(x), 3) ELSE round_even(abs(x), 4) END AS v FROM ({src}), range(1, 5) t(d)"

ORACLES = {
    "build_samples_full": t(sample("who || money || ' ' || cats || dates || amounts")),
    "build_samples_conditions": t(" UNION ALL ".join(sample(e, c == "neutral", ONE, f"'{c}' AS condition, ") for c, e in COND.items())),
    "build_samples_minus_field": t(" UNION ALL ".join(sample(e, False, ONE, f"'{f}' AS dropped, ") for f, e in MINUS.items())),
    "few_shot_examples": t(f"SELECT position, customer_id, cats AS input, {RESPONSE} AS response, truth::BIGINT AS target_class FROM shot", **shots(4)),
    "with_few_shot": t(sample("'Examples from other customers:' || chr(10) || chr(10) || (SELECT string_agg('Example ' || position || ':' || chr(10) || cats || chr(10) || 'Answer: ' || " + RESPONSE
                              + ", chr(10) || chr(10) ORDER BY position) FROM shot) || chr(10) || chr(10) || 'Now my information:' || chr(10) || cats", where="bank = 'bank_b'"), **shots(2)),
    "chat_messages": t(f"SELECT customer_id, 0::BIGINT AS turn, 'user' AS role, '{INSTRUCTION}{FULL_LABELS}' || chr(10) || chr(10) || cats AS content FROM ptext WHERE {ONE} UNION ALL SELECT customer_id, 1, 'assistant', {RESPONSE} FROM ptext WHERE {ONE}"),
    "sample_length_guard": t(f"SELECT count(*) AS samples, max(len(string_split(instruction || ' ' || input || ' ' || response, ' ')))::BIGINT AS longest FROM ({sample('who || money || chr(32) || cats || dates || amounts', where=ONE)})"),
    "run_names": """SELECT lower(o_orderstatus) || '-full' || CASE o_orderkey % 3 WHEN 0 THEN '-minus-income-group' WHEN 1 THEN '-minus-age' ELSE '' END || CASE o_orderkey % 2 WHEN 0 THEN '' ELSE '-seed2' END AS name, count(*) AS n FROM orders GROUP BY ALL""",
    "trace_numbers": t(traced("customer_id", "cats || amounts", f"(SELECT * FROM ptext WHERE {ONE})", rounded("SELECT unnest([min(o_totalprice), max(o_totalprice), count(*)::DOUBLE, o_custkey::DOUBLE]) AS x FROM orders GROUP BY o_custkey"))),
    "trace_metric_numbers": t(traced("customer_id", "cats || amounts", "(SELECT * FROM ptext WHERE bank = 'bank_b')", rounded("SELECT unnest([length, n, " + ", ".join(ALL) + f"]) AS x FROM ({metrics('SELECT * FROM lpred WHERE bank = ' + chr(39) + 'bank_a' + chr(39), 'model, length')})"))),
}
