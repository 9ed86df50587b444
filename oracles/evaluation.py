from __future__ import annotations

from oracles.common import argmax, class_name, r, sql, uniform
from oracles.preparation import AGE_BAND, SPAN_BAND

SHORT = ("clothing", "gas", "food", "other")
OVERALL = ("acc", "prec_w", "rec_w", "f1_w", "macro_f1", "bal_acc")
F1S = tuple(f"f1_{s}" for s in SHORT)
ALL = OVERALL + tuple(f"{m}_{s}" for s in SHORT for m in ("p", "r", "f1"))


def seeded(base, s):
    return base if s == 42 else f"{base}-seed{s}"


def coin(seed: int, name: str, right: str) -> str:
    u = uniform(f"'{seed}:{name}-right:' || length || ':' || customer_id")
    h = uniform(f"'{seed}:{name}:' || length || ':' || customer_id")
    return f"CASE WHEN {u} < {right} THEN truth ELSE floor({h} * 4)::INTEGER END"


NOISY_U = [f"({uniform(f'{chr(39)}42:noisy{k}:{chr(39)} || length || {chr(39)}:{chr(39)} || customer_id')} + CASE WHEN truth = {k} THEN 0.3::DOUBLE ELSE 0::DOUBLE END)" for k in range(4)]
NONE = ", ".join(f"NULL::DOUBLE AS p{k}" for k in range(4))


def free(base: str, seed: int) -> str:
    if base == "random":
        code = f"floor({uniform(f'{chr(39)}{seed}:random:{chr(39)} || customer_id')} * 4)::INTEGER"
    else:
        u = uniform(f"'{seed}:proportional:' || customer_id")
        code = f"(({u} >= s0 / st)::INT + ({u} >= s0 / st + s1 / st)::INT + ({u} >= s0 / st + s1 / st + s2 / st)::INT)"
    return f"SELECT bank, '{seeded(base, seed)}' AS model, NULL::INTEGER AS length, customer_id, truth, {code} AS yhat, {NONE} FROM final_tx, shares_a"


TABLES = {
    "mkpair": "SELECT code AS prev, nxt FROM (SELECT code, lead(code) OVER (PARTITION BY customer_id ORDER BY pos) AS nxt FROM win WHERE bank = 'bank_a' AND length = 9) WHERE nxt IS NOT NULL",
    "mk": "SELECT prev, nxt, n, n / sum(n) OVER (PARTITION BY prev) AS p FROM (SELECT a.k AS prev, b.k AS nxt, 1 + (SELECT count(*) FROM mkpair q WHERE q.prev = a.k AND q.nxt = b.k) AS n FROM range(4) a(k), range(4) b(k))",
    "mkp": "SELECT prev, " + ", ".join(f"max(p) FILTER (nxt = {k}) AS p{k}" for k in range(4)) + " FROM mk GROUP BY prev",
    "freqw": "SELECT *, " + ", ".join(f"(n{k} + 1) / (length + 4) AS p{k}" for k in range(4)) + " FROM w",
    "noisyu": "SELECT bank, length, customer_id, truth, " + ", ".join(f"{u} AS u{k}" for k, u in enumerate(NOISY_U)) + " FROM w",
    "noisyw": "SELECT bank, length, customer_id, truth, " + ", ".join(f"u{k} / (u0 + u1 + u2 + u3) AS p{k}" for k in range(4)) + " FROM noisyu",
    "final_tx": "SELECT bank, customer_id, code AS truth FROM rk WHERE rn = 1 AND n >= 2",
    "shares_a": "SELECT *, s0 + s1 + s2 + s3 AS st FROM (SELECT " + ", ".join(f"count(*) FILTER (code = {k}) / count(*) AS s{k}" for k in range(4)) + " FROM tx_a)",
    "lpred": f"SELECT bank, 'averaging' AS model, length, customer_id, truth, modal AS yhat, {NONE} FROM modal "
             f"UNION ALL SELECT bank, 'last-category', length, customer_id, truth, lastc, {NONE} FROM w "
             f"UNION ALL SELECT bank, 'markov1', length, customer_id, truth, {argmax('p0', 'p1', 'p2', 'p3')}, p0, p1, p2, p3 FROM w JOIN mkp ON prev = lastc "
             f"UNION ALL SELECT bank, 'freq', length, customer_id, truth, {argmax('p0', 'p1', 'p2', 'p3')}, p0, p1, p2, p3 FROM freqw "
             f"UNION ALL SELECT bank, 'noisy', length, customer_id, truth, {argmax('p0', 'p1', 'p2', 'p3')}, p0, p1, p2, p3 FROM noisyw "
             + " ".join(f"UNION ALL SELECT bank, '{seeded('coin', s)}', length, customer_id, truth, {coin(s, 'coin', '0.4')}, {NONE} FROM w" for s in (42, 2, 3)),
    "fpred": " UNION ALL ".join(free(b, s) for s in (42, 2, 3) for b in ("random", "proportional")),
    "pred": "SELECT * FROM lpred UNION ALL SELECT * FROM fpred",
    # length-free answers repeated at the lengths that have the customer
    "epred": "SELECT * FROM lpred UNION ALL SELECT f.bank, f.model, w.length, f.customer_id, f.truth, f.yhat, f.p0, f.p1, f.p2, f.p3 FROM fpred f JOIN w USING (bank, customer_id)",
    "ovr": "SELECT bank, model, length, customer_id, truth, yhat, k, CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS q, (truth = k)::INT AS o FROM pred, range(4) t(k) WHERE p0 IS NOT NULL",
    "gen": "SELECT bank, customer_id, truth, CASE WHEN customer_id % 50 = 0 THEN 4 ELSE yhat END AS yhat FROM fpred WHERE model = 'random'",
}
BASE = "CASE WHEN model LIKE '%-seed%' THEN regexp_replace(model, '-seed\\d+$', '') ELSE model END"
PBIN = lambda q: "(" + " + ".join(f"({q} >= {k}::DOUBLE / 15)::INT" for k in range(1, 15)) + ")"


def metrics(source: str, keys: str, weight: str = "1") -> str:
    """Every metric of rows (keys, truth, yhat)."""
    s = ", ".join(f"coalesce(sum({weight}) FILTER (truth = {k}), 0)::DOUBLE AS s{k}, coalesce(sum({weight}) FILTER (yhat = {k}), 0)::DOUBLE AS q{k}, coalesce(sum({weight}) FILTER (truth = {k} AND yhat = {k}), 0)::DOUBLE AS t{k}" for k in range(4))
    ratios = ", ".join(f"CASE WHEN q{k} > 0 THEN t{k} / q{k} ELSE 0 END AS p_{n}, CASE WHEN s{k} > 0 THEN t{k} / s{k} ELSE 0 END AS r_{n}, CASE WHEN s{k} + q{k} > 0 THEN 2 * t{k} / (s{k} + q{k}) ELSE 0 END AS f1_{n}" for k, n in enumerate(SHORT))
    wsum = lambda m: "(" + " + ".join(f"s{k} / n * {m}_{c}" for k, c in enumerate(SHORT)) + ")"
    mean = lambda m: "((" + " + ".join(f"{m}_{c}" for c in SHORT) + ") / 4)"
    return (f"SELECT *, (t0 + t1 + t2 + t3) / n AS acc, {wsum('p')} AS prec_w, {wsum('r')} AS rec_w, {wsum('f1')} AS f1_w, {mean('f1')} AS macro_f1, {mean('r')} AS bal_acc "
            f"FROM (SELECT *, s0 + s1 + s2 + s3 AS n, {ratios} FROM (SELECT {keys}, {s} FROM ({source}) GROUP BY {keys}))")


def cols(names, alias=""):
    return ", ".join(f"{r(alias + n)} AS {n}" for n in names)


def unpivot(names, alias=""):
    return "unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS metric, unnest([" + ", ".join(alias + n for n in names) + "]) AS value"


DRAWS = 10_000
MASK = 4294967295


def mixed(source: str, name: str) -> str:
    """Rows of `source` with the 32-bit number `name` mixed."""
    step = lambda src, by, times: f"SELECT * REPLACE (((xor({name}, {name} >> {by}) * {times}) & {MASK})::UBIGINT AS {name}) FROM ({src})"
    return f"SELECT * REPLACE (xor({name}, {name} >> 16) AS {name}) FROM ({step(step(source, 16, 0x85EBCA6B), 13, 0xC2B2AE35)})"


# what a Poisson count's distribution comes to in 32 bits, for the sizes of chunks
LIMITS = ("SELECT lam, list(t ORDER BY k) AS ts FROM (SELECT lam, k, floor(sum(exp(k * ln(lam) - lam - lgamma(k + 1))) OVER (PARTITION BY lam ORDER BY k) * 4294967296)::BIGINT AS t "
          "FROM (SELECT unnest(range(1, 65)) AS lam UNION ALL SELECT 4096), range(0, 5000) r(k) WHERE k < lam + 12 * sqrt(lam) + 24) WHERE t < 4294967296 GROUP BY lam")
WEIGHTS = {"limits_m": LIMITS}


def drawn_rows(source: str, keys: str, models=None) -> str:
    """(keys, truth, yhat, draw, weight) of rows (keys, customer_id, truth, yhat): every joint cell's customers get one Poisson number per chunk.

    models: the order of the answers in a cell's name, -1 for a model without one; by default all models of the rows, by name.
    """
    pop = keys.replace(", model", "")
    codes = ("concat_ws(',', " + ", ".join(f"coalesce(max(yhat) FILTER (WHERE model = '{m}'), -1)" for m in models) + ")" if models else "string_agg(yhat::VARCHAR, ',' ORDER BY model)")
    names = "'" + ",".join(models) + "'" if models else "string_agg(model, ',' ORDER BY model)"
    wide = f"SELECT {pop}, customer_id, any_value(truth) AS truth, {codes} AS codes, {names} AS names FROM ({source}) GROUP BY {pop}, customer_id"
    text = " || ':' || ".join(["'42'", *pop.split(", "), "truth", "codes"])
    cell = f"SELECT *, row_number() OVER () AS cell, md5({text}) AS h FROM (SELECT {pop}, truth, codes, names, count(*) AS n FROM ({wide}) GROUP BY ALL)"
    word = lambda i: f"('0x' || substr(h, {1 + 8 * i}, 8))::UBIGINT"
    chunk = (f"SELECT cell, {word(0)} AS w0, xor({word(1)}, ((c * {0x85EBCA77}) & {MASK})::UBIGINT) AS w1, lam FROM ("
             "SELECT cell, h, 0 AS c, n % 64 AS lam FROM cells_ WHERE n % 64 > 0 UNION ALL SELECT cell, h, 64 * l + i, power(64, l)::BIGINT FROM cells_, (VALUES (1), (2)) t(l), range(0, 64) r(i) "
             "WHERE i < (n // power(64, l)::BIGINT) % 64)")
    number = mixed(f"SELECT cell, draw, lam, xor(w0, w1) AS u FROM ({mixed(f'SELECT cell, draw, lam, w1, xor(w0, ((draw * {0x9E3779B1}) & {MASK})::UBIGINT) AS w0 FROM ({mixed(chunk, chr(119) + chr(49))}), range(1, {DRAWS + 1}) d(draw)', 'w0')})", "u")
    weight = f"SELECT cell, draw, sum(len(list_filter(ts, lambda x: u >= x))) AS weight FROM ({number}) JOIN limits_m USING (lam) GROUP BY cell, draw"
    unfolded = f"SELECT {pop}, cell, truth, unnest(string_split(names, ',')) AS model, unnest(string_split(codes, ','))::INTEGER AS yhat FROM cells_"
    rows = f"SELECT u.*, w.draw, w.weight FROM ({unfolded}) u JOIN ({weight}) w USING (cell) WHERE yhat >= 0 AND weight > 0"
    return f"WITH cells_ AS MATERIALIZED ({cell}) {rows}"


def drawn(source: str, keys: str, models=None) -> str:
    """Metrics per draw."""
    return metrics(drawn_rows(source, keys, models), keys + ", draw", "weight")


def compared(points: str, draws: str, keys: str, pairs: str, names) -> str:
    """Paired differences: rows (keys, a, b, metric, diff, low, high, p, mde)."""
    on = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys.split(", "))
    kk = lambda x: ", ".join(f"{x}.{k}" for k in keys.split(", "))
    pt = lambda src, extra: (f"SELECT {kk('x')}, {'x.draw, ' if extra else ''}pr.a, pr.b, unnest([{', '.join(chr(39) + n + chr(39) for n in names)}]) AS metric, "
                             f"unnest([{', '.join(f'x.{n} - y.{n}' for n in names)}]) AS v FROM ({pairs}) pr JOIN ({src}) x ON x.model = pr.a JOIN ({src}) y ON y.model = pr.b AND {on('x', 'y')}"
                             + (" AND x.draw = y.draw" if extra else ""))
    return (f"SELECT {kk('d')}, d.a, d.b, d.metric, max(e.v) AS diff, quantile_cont(d.v, 0.025) AS low, quantile_cont(d.v, 0.975) AS high, "
            f"greatest(avg((abs(d.v - e.v) >= abs(e.v) - 1e-12)::INT), 1 / count(*)) AS p, 2.80::DOUBLE * stddev_samp(d.v) AS mde "
            f"FROM ({pt(draws, True)}) d JOIN ({pt(points, False)}) e ON {on('d', 'e')} AND d.a = e.a AND d.b = e.b AND d.metric = e.metric GROUP BY {kk('d')}, d.a, d.b, d.metric")


def pairs(*ab) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ab) + ") v(a, b)"


def mcnemar(rows: str, keys: str, pair_rows: str) -> str:
    """(keys, a, b, only_a, only_b, mcnemar_p) of rows (keys, model, customer_id, truth, yhat)."""
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    kk = ", ".join(f"x.{k}" for k in keys.split(", "))
    return (f"SELECT *, CASE WHEN only_a + only_b = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) END AS mcnemar_p "
            f"FROM (SELECT {kk}, pr.a, pr.b, count(*) FILTER (x.yhat = x.truth AND y.yhat <> y.truth) AS only_a, count(*) FILTER (x.yhat <> x.truth AND y.yhat = y.truth) AS only_b "
            f"FROM ({pair_rows}) pr JOIN ({rows}) x ON x.model = pr.a JOIN ({rows}) y ON y.model = pr.b AND x.customer_id = y.customer_id AND {on} GROUP BY {kk}, pr.a, pr.b)")


def holm(source: str, p: str, family: str, out: str = "p_holm") -> str:
    return (f"SELECT * EXCLUDE (rk_, m_), max(least(1, {p} * (m_ - rk_ + 1))) OVER (PARTITION BY {family} ORDER BY rk_) AS {out} FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY {p}) AS rk_, count(*) OVER (PARTITION BY {family}) AS m_ FROM ({source}))")


def q(body: str, **extra) -> str:
    return sql(body, **{**TABLES, **WEIGHTS, **extra})


A = "SELECT * FROM lpred WHERE bank = 'bank_a'"
SIX = "SELECT length, model, customer_id, truth, yhat FROM lpred WHERE bank = 'bank_a' AND model IN ('averaging', 'last-category', 'markov1', 'coin', 'coin-seed2', 'coin-seed3')"
PTEXT = " || ',' || ".join(f"CAST(round(p{k}, 6) AS DECIMAL(38,6))::VARCHAR" for k in range(4))
AP = ("SELECT bank, model, length, k, sum(tp * ctp / cn) / nullif(sum(tp), 0) AS ap FROM (SELECT *, sum(tp) OVER w2 AS ctp, sum(n) OVER w2 AS cn FROM "
      "(SELECT bank, model, length, k, q, sum(o) AS tp, count(*) AS n FROM ovr GROUP BY ALL) WINDOW w2 AS (PARTITION BY bank, model, length, k ORDER BY q DESC)) GROUP BY bank, model, length, k")


def probability_metrics(where: str) -> str:
    """PR-AUC, top-2, ECE, Brier per (bank, model, length)."""
    ap = ("SELECT bank, model, length, " + ", ".join(f"max(ap) FILTER (k = {k}) AS pr_auc_{s}" for k, s in enumerate(SHORT)) + f", avg(ap) AS pr_auc_macro FROM ({AP}) GROUP BY bank, model, length")
    ahead = " + ".join(f"(p{k} > pt OR (p{k} = pt AND {k} < truth))::INT" for k in range(4))
    brier = " + ".join(f"(p{k} - (truth = {k})::INT) * (p{k} - (truth = {k})::INT)" for k in range(4))
    rows = (f"SELECT bank, model, length, conf, {PBIN('conf')} AS bin, (yhat = truth)::INT AS hit, ({ahead} < 2)::INT AS top2, {brier} AS brier FROM "
            "(SELECT *, greatest(p0, p1, p2, p3) AS conf, CASE truth WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS pt FROM pred WHERE p0 IS NOT NULL)")
    rest = (f"SELECT bank, model, length, sum(top2) / sum(m) AS top2_acc, sum(abs(hit - conf)) / sum(m) AS ece, sum(brier) / sum(m) AS brier FROM "
            f"(SELECT bank, model, length, bin, count(*) AS m, sum(top2) AS top2, sum(hit) AS hit, sum(conf) AS conf, sum(brier) AS brier FROM ({rows}) GROUP BY bank, model, length, bin) GROUP BY bank, model, length")
    names = [f"pr_auc_{s}" for s in SHORT] + ["pr_auc_macro", "top2_acc", "ece", "brier"]
    return f"SELECT a.bank, a.model, a.length, {', '.join(names)} FROM ({ap}) a JOIN ({rest}) b ON a.bank = b.bank AND a.model = b.model AND a.length IS NOT DISTINCT FROM b.length WHERE {where}"


PNAMES = [f"pr_auc_{s}" for s in SHORT] + ["pr_auc_macro", "top2_acc", "ece", "brier"]
CLASS_BINS = f"SELECT bank, model, length, k, {PBIN('q')} AS bin, count(*) AS n, sum(q) AS sq, sum(o) AS so, sum((q - o) * (q - o)) AS se FROM ovr GROUP BY bank, model, length, k, {PBIN('q')}"
CLASS_CAL = ("SELECT bank, model, length, k, sum(n / tot * abs(so / n - sq / n)) AS ece, sum(n / tot * pow(sq / n - so / n, 2)) AS reliability, sum(n / tot * pow(so / n - prior, 2)) AS resolution, sum(se) / max(tot) AS brier, "
             "max(prior) * (1 - max(prior)) AS uncertainty, sum(sq) / max(tot) AS mean_p, max(prior) AS share FROM (SELECT *, sum(n) OVER g AS tot, (sum(so) OVER g) / (sum(n) OVER g) AS prior FROM "
             f"({CLASS_BINS}) WINDOW g AS (PARTITION BY bank, model, length, k)) GROUP BY bank, model, length, k")
CAL_NAMES = [f"ece_{s}" for s in SHORT] + ["ece_class_mean", "brier", "reliability", "resolution", "uncertainty"] + [f"{c}_{s}" for c in ("mean_p", "share") for s in SHORT]
CAL = ("SELECT bank, model, length, " + ", ".join(f"max(ece) FILTER (k = {k}) AS ece_{s}" for k, s in enumerate(SHORT)) + ", avg(ece) AS ece_class_mean, sum(brier) AS brier, sum(reliability) AS reliability, sum(resolution) AS resolution, "
       "sum(uncertainty) AS uncertainty, " + ", ".join(f"max({c}) FILTER (k = {k}) AS {c}_{s}" for c in ("mean_p", "share") for k, s in enumerate(SHORT)) + f" FROM ({CLASS_CAL}) GROUP BY bank, model, length")
# brute force: every candidate threshold against every row
THRESHOLDS = ("SELECT bank, model, length, t, count(*) FILTER (q >= t AND o = 1) AS tp, count(*) FILTER (q >= t) AS flagged, sum(o) AS positives FROM "
              "(SELECT DISTINCT bank, model, length, round_even(q * 10000, 0) / 10000::DOUBLE AS t FROM ovr WHERE k = 0) JOIN (SELECT * FROM ovr WHERE k = 0) USING (bank, model, length) GROUP BY bank, model, length, t")
CHOSEN = f"SELECT * FROM (SELECT *, 5 * (positives - tp) + (flagged - tp) AS cost, row_number() OVER (PARTITION BY bank, model, length ORDER BY 5 * (positives - tp) + (flagged - tp), t) AS k_ FROM ({THRESHOLDS})) WHERE k_ = 1"

SLICE_ROWS = ("SELECT bank AS split, model, customer_id, truth, yhat, unnest(['span', 'distinct']) AS variable, unnest([slice, classes::VARCHAR]) AS level FROM lpred JOIN "
              f"(SELECT bank, customer_id, {SPAN_BAND} AS slice, classes FROM w WHERE length = 9) USING (bank, customer_id) WHERE length = 9 AND (model = 'averaging' OR model LIKE 'coin%')")
FACT = " UNION ALL ".join(f"SELECT length, 'cell{i}{j}{k}' AS model, customer_id, truth, {coin(42, f'cell{i}{j}{k}', f'{0.25 + 0.05 * (i + j + k)!r}::DOUBLE')} AS yhat FROM w WHERE bank = 'bank_a' AND length = 9"
                          for i in (0, 1) for j in (0, 1) for k in (0, 1))
EFFECTS = []
for names in (("amounts",), ("dates",), ("demographics",), ("amounts", "dates"), ("amounts", "demographics"), ("dates", "demographics"), ("amounts", "dates", "demographics")):
    place = {"amounts": 5, "dates": 6, "demographics": 7}
    sign = " * ".join(f"(CASE substr(model, {place[n]}, 1) WHEN '1' THEN 1 ELSE -1 END)" for n in names)
    EFFECTS.append((("main effect: " if len(names) == 1 else "interaction: ") + " x ".join(names), sign))
FMETRICS = ("f1_w", "acc", "macro_f1", "f1_clothing")


def effects(source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}'{name}' AS effect, '{m}' AS metric, sum({sign} * {m}) / 4 AS v FROM ({source}) " + (f"GROUP BY {keys.rstrip(', ')}" if keys else "") for name, sign in EFFECTS for m in FMETRICS)


# seed means by base model
SEED_POINTS = lambda src, keys: f"SELECT {keys}, {BASE} AS base, count(*) AS seeds, max(n) AS n, " + ", ".join(f"avg({m}) AS {m}" for m in ALL) + f" FROM ({src}) GROUP BY {keys}, {BASE}"
as_model = lambda src: f"SELECT * EXCLUDE (base), base AS model FROM ({src})"

MEMBERS = [("coin:averaging", x, str(x), "a0", "coin") for x in (4, 7, 9, 14)] + [("coin:averaging", x, str(x), "b0", "averaging") for x in (4, 7, 9, 14)]
MEMBERS += [("coin,coin-seed2,coin-seed3:markov1", x, str(x), f"a{i}", seeded("coin", s)) for x in (4, 7, 9, 14) for i, s in enumerate((42, 2, 3))]
MEMBERS += [("coin,coin-seed2,coin-seed3:markov1", x, str(x), "b0", "markov1") for x in (4, 7, 9, 14)]
MEMBERS += [("coin:random", x, str(x), "a0", "coin") for x in (4, 7, 9, 14)] + [("coin:random", x, str(x), "b0", "random") for x in (4, 7, 9, 14)]
MEMBERS += [("coin@4:coin@9", 4, "4 vs 9", "a0", "coin"), ("coin@4:coin@9", 9, "4 vs 9", "b0", "coin")]
PAIR = {
    "members": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {x}, '{at}', '{s}', '{m}')" for p, x, at, s, m in MEMBERS) + ") v(pair, mlen, at_, slot, source)",
    "prow": "SELECT m.pair, m.at_, m.slot AS model, e.customer_id, e.truth, e.yhat FROM members m JOIN epred e ON e.bank = 'bank_a' AND e.model = m.source AND e.length = m.mlen "
            "WHERE m.at_ <> '4 vs 9' OR e.customer_id IN (SELECT customer_id FROM w WHERE bank = 'bank_a' AND length = 9)",
}
PM = ("acc", "f1_w", "macro_f1", *F1S)
side = lambda src, keys: f"SELECT {keys}, substr(model, 1, 1) AS model, max(n) AS n, " + ", ".join(f"avg({m}) AS {m}" for m in PM) + f" FROM ({src}) GROUP BY {keys}, substr(model, 1, 1)"
PPOINTS = side(metrics("SELECT * FROM prow", "pair, at_, model"), "pair, at_")
PDRAWS = side(drawn("SELECT * FROM prow", "pair, at_, model", ("a0", "a1", "a2", "b0")), "pair, at_, draw")

SIX_NAMES = ("averaging", "last-category", "markov1", "coin", "coin-seed2", "coin-seed3")
SIX_DRAWS = drawn(SIX, "length, model", SIX_NAMES)
SIG_NAMES = ("coin", "noisy", "averaging", "last-category", "markov1", "random", "proportional")
SIG_ROWS = "SELECT length, model, customer_id, truth, yhat FROM epred WHERE bank = 'bank_a' AND model IN ('coin', 'noisy', 'averaging', 'last-category', 'markov1', 'random', 'proportional')"
SIG_PAIRS = pairs(*[(a, b) for a in ("coin", "noisy") for b in ("averaging", "last-category", "markov1", "random", "proportional")])
TESTED = ("f1_w", "macro_f1", "bal_acc", *F1S)
FAM = ("acc", "f1_w", "macro_f1", "bal_acc", *F1S)


def primary(where: str) -> str:
    chosen = f"SELECT base FROM (SELECT {BASE} AS base, avg(macro_f1) AS s FROM ({metrics('SELECT model, truth, yhat FROM lpred WHERE bank = ' + chr(39) + 'bank_a' + chr(39) + ' AND length = 9', 'model')}) GROUP BY 1) WHERE base IN ('averaging', 'last-category', 'markov1') ORDER BY s DESC, CASE base WHEN 'averaging' THEN 0 WHEN 'last-category' THEN 1 ELSE 2 END LIMIT 1"
    rows = f"SELECT length, model, customer_id, truth, yhat FROM lpred WHERE bank = 'bank_b' AND length = 9 AND (model LIKE 'coin%' OR model = (SELECT base FROM chosen)) AND {where}"
    pts = SEED_POINTS(metrics(rows, "length, model"), "length")
    head = (f"SELECT a.length::BIGINT AS length, a.n::BIGINT AS n, 'coin' AS a, a.seeds AS a_seeds, {r('a.macro_f1')} AS a_macro_f1, b.base AS b, b.seeds AS b_seeds, {r('b.macro_f1')} AS b_macro_f1, {r('a.macro_f1 - b.macro_f1')} AS diff")
    body = f" FROM ({pts}) a JOIN ({pts}) b ON a.base = 'coin' AND b.base = (SELECT base FROM chosen)"
    cmp_ = compared(as_model(pts), "SELECT * FROM draws_m", "length", "SELECT 'coin' AS a, base AS b FROM chosen", ("macro_f1",))
    return q(head + f", {r('c.low')} AS low, {r('c.high')} AS high, {r('c.p')} AS p, {r('c.mde')} AS mde" + body + f", ({cmp_}) c", chosen=chosen, draws_m=as_model(SEED_POINTS(drawn(rows, "length, model"), "length, draw")))


CMP = f"metric, {r('diff')} AS diff, {r('low')} AS low, {r('high')} AS high, {r('p')} AS p, {r('mde')} AS mde"
FIXED9 = "SELECT w.*, " + ", ".join(f"n{k} / length AS sh{k}" for k in range(4)) + " FROM w WHERE length = 9"
SECOND = "SELECT bank, customer_id, max(code) FILTER (rn = 3) AS second, count(*) FILTER (code <> nxt AND rn > 2) AS switches FROM (SELECT *, lead(code) OVER (PARTITION BY bank, customer_id ORDER BY pos) AS nxt FROM win WHERE length = 9) GROUP BY bank, customer_id"
INPUTS = "SELECT bank, customer_id, pos, rn, dt, greatest(amount, 0) AS am, ln(1 + greatest(amount, 0)) AS la FROM win WHERE length = 9 AND rn > 1"
FULL = """SELECT bank, customer_id, avg(la) AS amount_mean, quantile_cont(la, 0.5) AS amount_median, max(la) AS amount_max, max(la) FILTER (rn = 2) AS amount_last, ln(1 + sum(am)) AS amount_total,
 date_diff('day', max(dt) FILTER (rn = 10), max(dt) FILTER (rn = 2)) / 8 AS gap_mean, date_diff('day', max(dt) FILTER (rn = 3), max(dt) FILTER (rn = 2)) AS gap_last,
 date_diff('day', max(dt) FILTER (rn = 10), max(dt) FILTER (rn = 2)) AS span_days, isodow(max(dt) FILTER (rn = 2)) - 1 AS weekday_last FROM inputs9 GROUP BY bank, customer_id"""
PAD = ("SELECT bank, customer_id, length, {0} FROM (SELECT c.bank, x.length, i AS slot, c.customer_id, v.code, v.nxt FROM {1} x(length), range(1, 10) t(i), (SELECT DISTINCT bank, customer_id, length FROM win) c "
       "LEFT JOIN (SELECT bank, customer_id, length, pos, code, lead(code) OVER (PARTITION BY bank, customer_id, length ORDER BY pos) AS nxt FROM win) v ON v.bank = c.bank AND v.customer_id = c.customer_id AND v.length = c.length AND v.pos = i + c.length - 9 WHERE c.length = x.length) GROUP BY bank, customer_id, length")

ORACLES = {
    "flagship_baselines": q(f"""SELECT model, n::BIGINT AS n, {cols(('acc', 'macro_f1', *F1S))} FROM ({metrics('SELECT m.* FROM cpred m', 'model')})""",
        cpair="SELECT code AS prev, nxt FROM (SELECT customer_id, code, lead(code) OVER (PARTITION BY customer_id ORDER BY pos) AS nxt FROM win WHERE bank = 'bank_a' AND length = 9 AND customer_id IN (SELECT customer_id FROM cohort WHERE bank = 'bank_a')) WHERE nxt IS NOT NULL",
        cmk="SELECT a.k AS prev, b.k AS nxt, 1 + (SELECT count(*) FROM cpair q WHERE q.prev = a.k AND q.nxt = b.k) AS n FROM range(4) a(k), range(4) b(k)",
        cbest="SELECT prev, nxt FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n DESC, nxt) AS k FROM cmk) WHERE k = 1",
        cpred="SELECT 'averaging' AS model, truth, modal AS yhat FROM cohort WHERE bank = 'bank_a' UNION ALL SELECT 'last-category', truth, lastc FROM cohort WHERE bank = 'bank_a' UNION ALL SELECT 'markov1', truth, nxt FROM cohort JOIN cbest ON prev = lastc WHERE bank = 'bank_a'"),
    "score_baselines": q(f"SELECT bank AS split, model, length::BIGINT AS length, customer_id, truth::BIGINT AS y, yhat::BIGINT AS yhat, coalesce({PTEXT}, '') AS p FROM lpred WHERE model IN ('averaging', 'last-category', 'markov1')"),
    "random_and_proportional": q("SELECT bank AS split, model, 0::BIGINT AS length, customer_id, truth::BIGINT AS y, yhat::BIGINT AS yhat, '' AS p FROM fpred"),
    "averaging_ties_lowest": q(f"SELECT bank, customer_id, length::BIGINT AS length, ({argmax('n0', 'n1', 'n2', 'n3')})::BIGINT AS code FROM w"),
    "last_category": q("SELECT bank, customer_id, lastc::BIGINT AS code, truth::BIGINT AS target FROM w WHERE length = 9"),
    "markov_fit": q(f"SELECT prev::BIGINT AS prev, nxt::BIGINT AS next, n, {r('p')} AS p FROM mk"),
    "sequence_features": q("SELECT bank, customer_id, " + ", ".join(
        f"n{k} AS count_{s}, {r(f'sh{k}')} AS share_{s}, (CASE WHEN n{k} > 0 THEN r{k} - 2 ELSE 9 END)::BIGINT AS since_{s}, (lastc = {k})::BIGINT AS last_is_{s}, (second = {k})::BIGINT AS second_last_is_{s}" for k, s in enumerate(SHORT))
        + ", switches FROM nine JOIN second9 USING (bank, customer_id)", nine=FIXED9, second9=SECOND),
    "full_features": q(f"SELECT bank, customer_id, {cols(('amount_mean', 'amount_median', 'amount_max', 'amount_last', 'amount_total', 'gap_mean'))}, gap_last::BIGINT AS gap_last, span_days::BIGINT AS span_days, weekday_last::BIGINT AS weekday_last, age::BIGINT AS age, gender, marital_status, education, occupation, income_group FROM full9 JOIN demo USING (customer_id)", inputs9=INPUTS, full9=FULL),
    "one_hot": q("SELECT d.customer_id, max(age)::BIGINT AS age, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (i IS NOT NULL), '') AS hot FROM (SELECT customer_id, age, unnest(['gender', 'marital_status', 'education', 'occupation', 'income_group']) AS variable, "
        "unnest([gender, marital_status, education, occupation, income_group]) AS level FROM demo) d LEFT JOIN levels_ l ON l.variable = d.variable AND l.level = d.level GROUP BY d.customer_id",
        levels_="SELECT *, row_number() OVER (ORDER BY md5(variable || ':' || level)) - 1 AS i FROM (SELECT DISTINCT unnest(['gender', 'marital_status', 'education', 'occupation', 'income_group']) AS variable, unnest([gender, marital_status, education, occupation, income_group]) AS level "
                "FROM demo WHERE customer_id % 2 = 0 AND occupation <> 'retired')"),
    "logistic_model": q("SELECT kind, c, weights, (SELECT count(*) FROM assignment WHERE split = 'train') AS n_train, TRUE AS at_minimum, TRUE AS better_than_nothing FROM (VALUES ('seq'), ('full')) k(kind), "
        "(VALUES (0.01::DOUBLE), (0.1::DOUBLE), (1::DOUBLE), (10::DOUBLE)) c(c), (VALUES ('none'), ('balanced')) w(weights)"),
    "grid_select": q("SELECT kind, 8::BIGINT AS settings, (SELECT count(*) FROM assignment WHERE split = 'val') AS n_val, TRUE AS first_of_the_best, TRUE AS score_is_a_share FROM (VALUES ('seq'), ('full')) k(kind)"),
    "gbdt_model": q("SELECT split, 'gbdt-' || kind AS model, count(*) AS n, count(*) AS n_probabilities, count(*) AS n_argmax, 24::BIGINT AS settings, TRUE AS first_of_the_best, TRUE AS not_above_the_class_shares "
        "FROM assignment, (VALUES ('seq'), ('full')) k(kind) WHERE split <> 'train' GROUP BY split, kind"),
    "class_weights": q(" UNION ALL ".join(f"SELECT bank, '{kind}' AS kind, k AS target, n, {r(f)} AS weight FROM tcount" for kind, f in
        (("none", "1"), ("inverse", "1 / greatest(n, 1) / sum(1 / greatest(n, 1)) OVER (PARTITION BY bank) * 4"), ("balanced", "sum(n) OVER (PARTITION BY bank) / (4 * greatest(n, 1))"))),
        tcount="SELECT b.bank, k, (SELECT count(*) FROM w WHERE w.bank = b.bank AND length = 9 AND truth = k) AS n FROM (VALUES ('bank_a'), ('bank_b')) b(bank), range(4) t(k)"),
    "padded_sequence": q("SELECT bank, customer_id, length::BIGINT AS length, shifted, tokens, next_codes FROM padded", padded=PAD.format(
        "string_agg(coalesce(code + 1, 0)::VARCHAR, ',' ORDER BY slot) AS shifted, string_agg(coalesce(code, 4)::VARCHAR, ',' ORDER BY slot) AS tokens, string_agg((CASE WHEN code IS NULL THEN -100 ELSE nxt END)::VARCHAR, ',' ORDER BY slot) AS next_codes", "(VALUES (4), (14))")),
    "score_in_batches": q(f"SELECT customer_id, {class_name(argmax('p0', 'p1', 'p2', 'p3'))} AS prediction, {PTEXT} AS p FROM freqw WHERE bank = 'bank_a' AND length = 9"),
    "prediction_inventory": q("SELECT model, coalesce(length, 0)::BIGINT AS length, count(*) AS customers, CASE WHEN length IS NULL THEN model || '.csv' ELSE model || '_last' || length || '.csv' END AS file FROM pred WHERE bank = 'bank_a' GROUP BY model, length"),
    "label_scoring_table": q(f"SELECT customer_id, {class_name(argmax('p0', 'p1', 'p2', 'p3'))} AS prediction, {PTEXT} AS p FROM soft",
        soft="SELECT customer_id, " + ", ".join(f"p{k} * p{k} / (p0 * p0 + p1 * p1 + p2 * p2 + p3 * p3) AS p{k}" for k in range(4)) + " FROM noisyw WHERE bank = 'bank_a' AND length = 9"),
    "clean_answers": q(f"SELECT customer_id, coalesce({class_name('yhat')}, 'n/a') AS prediction, yhat < 4 AS is_category FROM gen WHERE bank = 'bank_a'"),
    "invalid_answers": q(f"SELECT bank AS split, 'random-gen' AS model, count(*) AS n, count(*) FILTER (yhat = 4) AS not_a_category, {r('100 * avg((yhat = 4)::INT)')} AS share_pct FROM gen GROUP BY bank"),
    "generation_agreement": q(f"SELECT 'bank_a' AS split, 'random' AS model, 0::BIGINT AS length, count(*) AS n, count(*) FILTER (g.yhat = 4) AS not_a_category, {r('100 * avg((g.yhat = f.yhat)::INT)')} AS agreement_pct FROM gen g JOIN fpred f USING (bank, customer_id) WHERE bank = 'bank_a' AND model = 'random-seed2'"),
    "scorer_agreement": q(f"SELECT count(*) AS n, {r('avg((a.yhat = b.yhat)::INT)')} AS argmax_agreement, {r('max(greatest(abs(a.p0 - b.p0), abs(a.p1 - b.p1), abs(a.p2 - b.p2), abs(a.p3 - b.p3)))')} AS max_abs_prob_diff FROM lpred a JOIN lpred b USING (bank, customer_id, length) WHERE bank = 'bank_a' AND length = 9 AND a.model = 'noisy' AND b.model = 'freq'"),
    "align_models": q("SELECT a.customer_id, a.truth::BIGINT AS y, a.yhat::BIGINT AS yhat_0, b.yhat::BIGINT AS yhat_1, c.yhat::BIGINT AS yhat_2 FROM lpred a JOIN lpred b USING (bank, length, customer_id) JOIN fpred c USING (bank, customer_id) WHERE bank = 'bank_a' AND a.length = 9 AND a.model = 'averaging' AND b.model = 'markov1' AND c.model = 'random'"),
    "common_population": q("SELECT customer_id FROM w WHERE bank = 'bank_a' AND length = 14"),
    "fixed_population": q(f"SELECT model, length::BIGINT AS length, n::BIGINT AS n, {cols(OVERALL + F1S)} FROM ({metrics('SELECT * FROM lpred WHERE bank = ' + chr(39) + 'bank_a' + chr(39) + ' AND customer_id IN (SELECT customer_id FROM w WHERE bank = ' + chr(39) + 'bank_a' + chr(39) + ' AND length = 14)', 'model, length')})"),
    "population_check": q("SELECT length::BIGINT AS length, count(DISTINCT model) AS models, count(DISTINCT customer_id) AS customers, length <> 4 AS same FROM lpred WHERE bank = 'bank_a' GROUP BY length"),
    "confusion_matrix": q(f"""SELECT split, model, length, {class_name('t')} AS truth, coalesce({class_name('p')}, 'not a category') AS answer, count(*) FILTER (truth = t AND yhat = p) AS n FROM
        (SELECT bank AS split, model, coalesce(length, 0)::BIGINT AS length, truth, yhat FROM pred UNION ALL SELECT bank, 'random-gen', 0, truth, yhat FROM gen WHERE bank = 'bank_a'), range(4) a(t), range(5) b(p) GROUP BY split, model, length, t, p"""),
    "classification_metrics": q(f"SELECT split, model, length, n::BIGINT AS n, {cols(ALL)} FROM ({metrics('SELECT bank AS split, model, coalesce(length, 0)::BIGINT AS length, truth, yhat FROM pred', 'split, model, length')})"),
    "selection_score": q(" UNION ALL ".join(f"SELECT bank AS split, model, length::BIGINT AS length, '{m}' AS metric, {r(m)} AS score FROM ({metrics('SELECT * FROM lpred', 'bank, model, length')})" for m in ("macro_f1", "f1_w"))),
    "select_best": q(f"SELECT length, model, {r('macro_f1')} AS score FROM (SELECT length::BIGINT AS length, model, macro_f1, row_number() OVER (PARTITION BY length ORDER BY macro_f1 DESC, CASE model WHEN 'averaging' THEN 0 WHEN 'last-category' THEN 1 WHEN 'markov1' THEN 2 ELSE 3 END) AS k FROM ({metrics('SELECT * FROM lpred WHERE bank = ' + chr(39) + 'bank_b' + chr(39), 'model, length')})) WHERE k = 1"),
    "probability_metrics": q(f"SELECT CASE bank WHEN 'bank_a' THEN model ELSE model || '-b' END AS model, length::BIGINT AS length, {cols(PNAMES)} FROM ({probability_metrics('TRUE')})"),
    "model_summary": q(f"SELECT m.model, m.length, m.n::BIGINT AS n, {cols(ALL)}, {cols(PNAMES)} FROM ({metrics('SELECT model, coalesce(length, 0)::BIGINT AS length, truth, yhat FROM pred WHERE bank = ' + chr(39) + 'bank_a' + chr(39), 'model, length')}) m LEFT JOIN (SELECT * FROM ({probability_metrics('TRUE')}) WHERE bank = 'bank_a') b ON m.model = b.model AND m.length = b.length"),
    "seed_summary": q(f"SELECT {BASE} AS base, length, count(*) AS seeds, min(n)::BIGINT AS n, " + ", ".join(f"{r(f'avg({m})')} AS {m}_mean, {r(f'stddev_samp({m})')} AS {m}_sd" for m in ("acc", "macro_f1", "f1_clothing"))
        + f" FROM ({metrics('SELECT model, coalesce(length, 0)::BIGINT AS length, truth, yhat FROM pred WHERE bank = ' + chr(39) + 'bank_a' + chr(39), 'model, length')}) GROUP BY {BASE}, length"),
    "shift_table": q(f"SELECT {BASE} AS base, count(*) FILTER (bank = 'bank_a') AS seeds_in_bank, count(*) FILTER (bank = 'bank_b') AS seeds_cross_bank, " + ", ".join(
        f"{r(f'avg({m}) FILTER (bank = {chr(39)}bank_a{chr(39)})')} AS {m}_in_bank, {r(f'avg({m}) FILTER (bank = {chr(39)}bank_b{chr(39)})')} AS {m}_cross_bank, {r(f'avg({m}) FILTER (bank = {chr(39)}bank_a{chr(39)}) - avg({m}) FILTER (bank = {chr(39)}bank_b{chr(39)})')} AS {m}_drop" for m in ("acc", "f1_w", "macro_f1", *F1S))
        + f" FROM ({metrics('SELECT bank, model, truth, yhat FROM lpred WHERE length = 9', 'bank, model')}) GROUP BY {BASE}"),
    "subgroup_metrics": q(f"SELECT model, variable, level, n::BIGINT AS n, {cols(('acc', 'macro_f1', 'r_clothing', 'f1_clothing'))} FROM ({metrics('SELECT model, truth, yhat, unnest([' + chr(39) + 'gender' + chr(39) + ', ' + chr(39) + 'age_band' + chr(39) + ']) AS variable, unnest([gender, ' + AGE_BAND + ']) AS level FROM lpred JOIN demo USING (customer_id) WHERE bank = ' + chr(39) + 'bank_a' + chr(39) + ' AND length = 9', 'model, variable, level')})"),
    "slice_metrics": q(f"SELECT split, variable, level, {BASE} AS base, count(*) AS seeds, min(n)::BIGINT AS n, " + ", ".join(f"{r(f'avg({m})')} AS {m}_mean" for m in ("acc", "f1_w", "macro_f1", "f1_clothing"))
        + f" FROM ({metrics(SLICE_ROWS, 'split, variable, level, model')}) GROUP BY split, variable, level, {BASE}"),
    "slice_shares": q(f"SELECT split, variable, level, count(*) AS n, {r('100 * count(*) / sum(count(*)) OVER (PARTITION BY split, variable)')} AS share FROM (SELECT bank AS split, unnest(['span', 'distinct']) AS variable, unnest([{SPAN_BAND}, classes::VARCHAR]) AS level FROM w WHERE length = 9) GROUP BY split, variable, level"),
    "reliability_table": q(f"SELECT bank AS split, model, length::BIGINT AS length, bin::BIGINT AS bin, {r('avg(conf)')} AS confidence, {r('avg((yhat = truth)::INT)')} AS accuracy, count(*) AS n FROM (SELECT *, {PBIN('conf')} AS bin FROM (SELECT *, greatest(p0, p1, p2, p3) AS conf FROM lpred WHERE p0 IS NOT NULL)) GROUP BY bank, model, length, bin"),
    "class_reliability": q(f"SELECT bank AS split, model, length::BIGINT AS length, bin::BIGINT AS bin, {r('sq / n')} AS mean_probability, {r('so / n')} AS observed_share, n FROM ({CLASS_BINS}) WHERE length IS NOT NULL AND k = 0"),
    "class_calibration": q(f"SELECT bank AS split, model, length::BIGINT AS length, {cols(CAL_NAMES)}, {r('brier - (reliability - resolution + uncertainty)')} AS remainder FROM ({CAL}) WHERE length IS NOT NULL"),
    "cost_threshold": q(f"SELECT bank AS split, model, length::BIGINT AS length, {r('t')} AS threshold, {r('cost')} AS cost, {r('tp / greatest(positives, 1)')} AS recall, {r('tp / greatest(flagged, 1)')} AS precision FROM ({CHOSEN})"),
    "operating_point": q(f"""SELECT model, length::BIGINT AS length, {r('max(t)')} AS threshold, {r('count(*) FILTER (p0 >= t AND truth = 0) / count(*) FILTER (truth = 0)')} AS recall, {r('count(*) FILTER (p0 >= t AND truth = 0) / nullif(count(*) FILTER (p0 >= t), 0)')} AS precision,
        {r('100 * avg((p0 >= t)::INT)')} AS flagged_pct, {r('100 * avg((truth = 0)::INT)')} AS positives_pct, {r('count(*) FILTER (yhat = 0 AND truth = 0) / count(*) FILTER (truth = 0)')} AS argmax_recall,
        {r('count(*) FILTER (yhat = 0 AND truth = 0) / nullif(count(*) FILTER (yhat = 0), 0)')} AS argmax_precision, {r('100 * avg((yhat = 0)::INT)')} AS argmax_flagged_pct
        FROM lpred JOIN (SELECT model, length, t FROM ({CHOSEN}) WHERE bank = 'bank_a') USING (model, length) WHERE bank = 'bank_b' GROUP BY model, length"""),
    "poisson_bootstrap": q("SELECT length::BIGINT AS length, model, draw::BIGINT AS draw, " + ", ".join(f"coalesce(sum(weight) FILTER (truth = {t} AND yhat = {a}), 0)::BIGINT AS c{t}{a}" for t in range(4) for a in range(5))
        + f" FROM ({drawn_rows(SIX, 'length, model', SIX_NAMES)}) GROUP BY length, model, draw"),
    "metric_intervals": q(f"SELECT length::BIGINT AS length, model, metric, {r('quantile_cont(value, 0.025)')} AS low, {r('quantile_cont(value, 0.975)')} AS high FROM (SELECT length, model, {unpivot(ALL)} FROM ({SIX_DRAWS})) GROUP BY length, model, metric"),
    "bootstrap_law": q(f"SELECT bank AS split, length::BIGINT AS length, model, truth::BIGINT AS truth, yhat::BIGINT AS answer, {r('c')} AS expected_mean, {r('c * (1 - c / n)')} AS expected_var, TRUE AS mean_ok, TRUE AS var_ok FROM "
        f"(SELECT bank, length, model, truth, yhat, count(*) AS c, sum(count(*)) OVER (PARTITION BY bank, length, model) AS n FROM lpred WHERE model IN {SIX_NAMES} GROUP BY bank, length, model, truth, yhat)"),
    "seed_mean": q(f"SELECT length::BIGINT AS length, base AS model, seeds, {r('n')} AS n, {cols(ALL)} FROM ({SEED_POINTS(metrics(SIX, 'length, model'), 'length')})"),
    "paired_comparison": q(f"SELECT length::BIGINT AS length, a, b, {CMP} FROM ({compared(metrics(SIX, 'length, model'), 'SELECT * FROM draws_m', 'length', pairs(('coin', 'averaging'), ('coin', 'markov1'), ('averaging', 'averaging')), ALL)})", draws_m=SIX_DRAWS),
    "mcnemar_exact": q(f"SELECT bank AS split, length::BIGINT AS length, a, b, only_a, only_b, {r('mcnemar_p + 1e-9')} AS mcnemar_p FROM ({mcnemar('SELECT * FROM lpred', 'bank, length', pairs(('coin', 'averaging'), ('coin', 'last-category'), ('coin', 'markov1'), ('coin', 'coin')))})"),
    "holm": q(f"SELECT length::BIGINT AS length, a, b, {r('mcnemar_p + 1e-9')} AS mcnemar_p, {r('p_holm + 1e-9')} AS p_holm FROM ({holm(mcnemar(SIX, 'length', pairs(*[(a, b) for a in ('coin', 'coin-seed2') for b in ('averaging', 'last-category', 'markov1')])), 'mcnemar_p', 'length, a')})"),
    "significance_table": q(f"SELECT c.length::BIGINT AS length, c.a, c.b, {CMP}, {r('p_holm')} AS p_holm, only_a, only_b, {r('mcnemar_p + 1e-9')} AS mcnemar_p, {r('mcnemar_p_holm + 1e-9')} AS mcnemar_p_holm, (SELECT count(DISTINCT s.customer_id) FROM ({SIG_ROWS}) s WHERE s.length = c.length) AS N, c.a || ' against 5 baselines (averaging, last-category, markov1, proportional, random) at length ' || c.length || ', one family per metric' AS family FROM ({holm(compared(metrics(SIG_ROWS, 'length, model'), "SELECT * FROM draws_m", 'length', SIG_PAIRS, TESTED), 'p', 'length, a, metric')}) c "
        f"JOIN ({holm(mcnemar(SIG_ROWS, 'length', SIG_PAIRS), 'mcnemar_p', 'length, a', 'mcnemar_p_holm')}) m ON c.length = m.length AND c.a = m.a AND c.b = m.b", draws_m=drawn(SIG_ROWS, "length, model", SIG_NAMES)),
    "families": q(f"SELECT c.length::BIGINT AS length, c.a, c.b, {CMP}, {r('p_holm')} AS p_holm, {r('s.n')} AS n, s.seeds AS b_seeds, 3::BIGINT AS a_seeds, 'coin against 3 comparators (averaging, last-category, markov1) at length ' || c.length || ', one family per metric' AS family FROM ("
        + holm(compared(as_model(SEED_POINTS(metrics(SIX, 'length, model'), 'length')), "SELECT * FROM draws_m", 'length', pairs(('coin', 'averaging'), ('coin', 'last-category'), ('coin', 'markov1')), FAM), 'p', 'length, a, metric')
        + f") c JOIN ({SEED_POINTS(metrics(SIX, 'length, model'), 'length')}) s ON s.length = c.length AND s.base = c.b", draws_m=as_model(SEED_POINTS(drawn(SIX, "length, model"), "length, draw"))),
    "choose_comparator": q(f"SELECT model, {r('macro_f1')} AS score FROM ({metrics(A + ' AND length = 9', 'model')}) WHERE model IN ('averaging', 'last-category', 'markov1') ORDER BY macro_f1 DESC LIMIT 1"),
    "primary_endpoint": primary("TRUE"),
    "primary_endpoint_without_ties": primary("customer_id NOT IN (SELECT customer_id FROM lastday l WHERE l.bank = 'bank_b' AND on_last >= 2)"),
    "pair_table": q(f"SELECT c.pair, c.at_ AS length, {CMP}, s.n::BIGINT AS n, only_a, only_b, {r('mcnemar_p + 1e-9')} AS mcnemar_p FROM ({compared(PPOINTS, 'SELECT * FROM draws_m', 'pair, at_', pairs(('a', 'b')), PM)}) c JOIN ({PPOINTS}) s ON s.pair = c.pair AND s.at_ = c.at_ AND s.model = 'a' "
        f"LEFT JOIN (SELECT * FROM ({mcnemar('SELECT * FROM prow', 'pair, at_', pairs(('a0', 'b0')))}) WHERE pair NOT LIKE '%,%') m ON m.pair = c.pair AND m.at_ = c.at_", draws_m=PDRAWS, **PAIR),
    "factorial_effects": q(f"SELECT e.metric, e.effect, {r('max(e.v)')} AS estimate, {r('quantile_cont(d.v, 0.025)')} AS low, {r('quantile_cont(d.v, 0.975)')} AS high FROM ({effects(metrics('SELECT * FROM fact', 'length, model'), '')}) e JOIN ({effects('SELECT * FROM draws_m', 'draw, ')}) d ON d.effect = e.effect AND d.metric = e.metric GROUP BY e.metric, e.effect", fact=FACT, draws_m=drawn("SELECT * FROM fact", "length, model")),
    "run_cost": f"""SELECT coalesce(t.model, s.model) AS model, runs, {r('hours_mean')} AS hours_mean, {r('hours_min')} AS hours_min, {r('hours_max')} AS hours_max, {r('peak_gb')} AS peak_gb, steps,
        scored_runs, n, {r('seconds_mean')} AS seconds_mean, {r('ms')} AS ms_per_customer, scorer, passes_per_prompt FROM
        (SELECT 'm' || c_nationkey AS model, count(*) AS runs, avg(abs(c_acctbal) / 100) AS hours_mean, min(abs(c_acctbal) / 100) AS hours_min, max(abs(c_acctbal) / 100) AS hours_max,
            max(c_custkey % 32)::DOUBLE AS peak_gb, arg_min(c_custkey * 10, 'm' || c_nationkey || '-seed' || c_custkey)::BIGINT AS steps FROM customer GROUP BY 1) t FULL JOIN
        (SELECT model, count(*) AS scored_runs, arg_min(n, run)::BIGINT AS n, avg(seconds) AS seconds_mean, avg(1000 * seconds / n) AS ms, arg_min(scorer, run) AS scorer,
            arg_min(CASE scorer WHEN 'first' THEN 1 WHEN 'sequence' THEN 4 ELSE -1 END, run) AS p, nullif(p, -1)::BIGINT AS passes_per_prompt FROM
          (SELECT 'm' || (o_custkey % 30) AS model, 'm' || (o_custkey % 30) || '-seed' || o_orderkey AS run, CASE o_orderkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'sequence' ELSE 'other' END AS scorer,
            o_orderkey % 100 + 1 AS n, o_totalprice / 1000 AS seconds FROM orders) GROUP BY 1) s ON t.model = s.model""",
}
