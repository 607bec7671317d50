"""DuckDB SQL with the results of the ledger queries."""

from __future__ import annotations

import re

from siltrace.jobs.queries import DELAYS, GRID, N_WALKS, SMURF, STEPS, THRESHOLDS, W
from siltrace.operators.profiles import ROLES, STATS, WINDOWS

CTES: dict[str, str] = {
    "ledger": """SELECT *, CASE WHEN is_sar THEN kind END AS pattern_type, CASE WHEN is_sar THEN kind || '_' || user_id % 10 END AS pattern_id FROM (
  SELECT 'TXN' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS txn_id, 'ACC' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS sender_id,
    'ACC' || lpad(json_extract_string(props, '$.k'), 7, '0') AS receiver_id, round(value * 4000) / 100 AS amount, CAST(round(value * 4000) AS BIGINT) AS c,
    ts AS timestamp, event_type = 'error' AND value >= 150 AS is_sar, CAST(ts AS DATE) AS date, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
    CAST(floor(epoch(ts)) AS BIGINT) AS sec, user_id, ['smurfing', 'layering', 'fan_out_fan_in', 'round_tripping'][event_id % 4 + 1] AS kind
  FROM events WHERE user_id <> CAST(json_extract_string(props, '$.k') AS BIGINT))""",
    "sides": "SELECT sender_id AS account_id, receiver_id AS counterparty, 'sent' AS role, * FROM ledger UNION ALL SELECT receiver_id, sender_id, 'received', * FROM ledger",
    "accounts": """SELECT account_id, CASE WHEN n % 5 = 0 THEN 'external' ELSE 'internal' END AS account_type,
  CASE WHEN n % 10 < 7 THEN 'retail' WHEN n % 10 < 9 THEN 'small_business' ELSE 'high_volume_merchant' END AS persona
  FROM (SELECT DISTINCT account_id, CAST(substr(account_id, 4) AS BIGINT) AS n FROM sides)""",
    "directed": """SELECT ledger.*, CASE WHEN s.account_type = 'internal' AND r.account_type = 'internal' THEN 'internal' WHEN s.account_type = 'internal' THEN 'outbound'
  WHEN r.account_type = 'internal' THEN 'inbound' ELSE 'external' END AS direction
  FROM ledger LEFT JOIN accounts s ON s.account_id = sender_id LEFT JOIN accounts r ON r.account_id = receiver_id""",
    "spike": """SELECT sender_id AS account_id, date, day FROM (SELECT *, sum(t) OVER w AS s, count(*) OVER w AS n FROM (SELECT sender_id, date, day, sum(c) AS t FROM ledger GROUP BY ALL)
  WINDOW w AS (PARTITION BY sender_id ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE n > 0 AND t * n > s * 5.0""",
    "velocity": "SELECT account_id, date FROM sides GROUP BY ALL HAVING count(DISTINCT counterparty) > 5",
    "hits": """SELECT sender_id AS account_id, date, 'large_single_txn' AS rule_name, 0 AS k FROM ledger WHERE amount > 9000
  UNION ALL SELECT sender_id, date, 'round_amount_near_threshold', 1 FROM ledger WHERE amount BETWEEN 8500 AND 9999
  UNION ALL SELECT account_id, date, 'high_daily_velocity', 2 FROM velocity UNION ALL SELECT account_id, date, 'sudden_volume_spike', 3 FROM spike""",
    "sardays": "SELECT DISTINCT account_id, date FROM sides WHERE is_sar",
    "alerts": """SELECT h.*, s.date IS NOT NULL AS any_true_positive FROM (SELECT account_id, date, CAST(date_diff('day', DATE '2024-01-01', date) AS INTEGER) AS day, list(rule_name ORDER BY k) AS triggered_rules FROM hits GROUP BY ALL) h
  LEFT JOIN sardays s USING (account_id, date)""",
    "dsides": "SELECT sender_id AS account_id, receiver_id AS counterparty, 'sent' AS role, * FROM directed UNION ALL SELECT receiver_id, sender_id, 'received', * FROM directed",
    "accday": """SELECT a.account_id, a.date, a.day, coalesce(sum(c) FILTER (WHERE role = 'sent'), 0) / 100 AS total_sent, coalesce(sum(c) FILTER (WHERE role = 'received'), 0) / 100 AS total_received,
  nullif(count(txn_id), 0) AS n_txns, string_agg(DISTINCT counterparty, ',' ORDER BY counterparty) AS counterparties, coalesce(bool_or(is_sar), false) AS label, CAST(coalesce(sum(c), 0) AS BIGINT) AS total
  FROM alerts a LEFT JOIN dsides s ON s.account_id = a.account_id AND s.date = a.date GROUP BY ALL""",
    "scored": "SELECT account_id, date, day, label, total % 1000 / 1000.0::DOUBLE AS score FROM accday",
    "illicit": "SELECT DISTINCT account_id FROM accday WHERE label",
    "inc": "SELECT account_id AS node, counterparty AS nbr, role = 'sent' AS out, day, sum(c) AS c FROM sides GROUP BY ALL",
    "involved": "SELECT DISTINCT pattern_id, pattern_type, account_id, CASE WHEN role = 'received' THEN 'collector' ELSE 'mule' END AS role FROM sides WHERE is_sar",
    "patdays": "SELECT DISTINCT pattern_id, pattern_type, account_id, date FROM sides WHERE is_sar",
    "closed": "SELECT max(timestamp) - INTERVAL 1 DAY AS mark FROM ledger",
}
_NEEDS = {
    "sides": "ledger", "accounts": "sides", "directed": "accounts", "spike": "ledger", "velocity": "sides", "hits": "spike velocity", "sardays": "sides", "alerts": "hits sardays", "dsides": "directed",
    "accday": "alerts dsides", "scored": "accday", "illicit": "accday", "inc": "sides", "involved": "sides", "patdays": "sides", "closed": "ledger",
}


def sql(needs: str, select: str, extra: str = "", recursive: bool = False) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, "").split():
            add(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        add(n)
    with_ = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    text = f"WITH {'RECURSIVE ' if recursive else ''}{with_}{',' + extra if extra else ''}\n{select}"
    return re.sub(r'(?<![\w".])at(?!\w)', '"at"', text)  # a reserved word where it stands alone


def _degrees(targets: str, name: str = "deg") -> str:
    """CTEs: ``<name>`` with the measures of each (node, at, w) of ``targets``."""
    return f"""{name} AS MATERIALIZED (SELECT t.node, t.at, t.w, count(DISTINCT nbr) FILTER (WHERE NOT out) AS in_degree, count(DISTINCT nbr) FILTER (WHERE out) AS out_degree,
  coalesce(sum(c) FILTER (WHERE NOT out), 0) / 100 AS in_weight, coalesce(sum(c) FILTER (WHERE out), 0) / 100 AS out_weight
  FROM {targets} t LEFT JOIN inc e ON e.node = t.node AND e.day BETWEEN t.at - t.w AND t.at GROUP BY ALL)"""


_TARGETS = f"tg AS (SELECT DISTINCT account_id AS node, day AS at, {W} AS w FROM alerts)"
_M = ("in_degree", "out_degree", "in_weight", "out_weight")
_MEAN = {m: f"avg({m})" if "degree" in m else f"avg(CAST(round({m} * 100) AS BIGINT)) / 100" for m in _M}


def _features(targets: str) -> str:
    return f"""nb AS MATERIALIZED (SELECT DISTINCT t.node, t.at, t.w, e.nbr FROM {targets} t JOIN inc e ON e.node = t.node AND e.day BETWEEN t.at - t.w AND t.at),
ask AS MATERIALIZED (SELECT node, at, w FROM {targets} UNION SELECT nbr, at, w FROM nb), {_degrees("ask")},
ft AS MATERIALIZED (SELECT t.node AS account_id, t.at AS day, t.w, {", ".join(f"d.{m}" for m in _M)}, {", ".join(f"x.nbr_{m}_{s}" for m in _M for s in ("mean", "min", "max"))} FROM {targets} t JOIN deg d USING (node, at, w)
  LEFT JOIN (SELECT nb.node, nb.at, nb.w, {", ".join(f"{_MEAN[m] if s == 'mean' else f'{s}({m})'} AS nbr_{m}_{s}" for m in _M for s in ("mean", "min", "max"))} FROM nb JOIN deg ON deg.node = nb.nbr AND deg.at = nb.at AND deg.w = nb.w GROUP BY ALL) x USING (node, at, w))"""


def _walks(bad: str = "illicit", n: int = N_WALKS, steps: int = STEPS) -> str:
    return f"""{_TARGETS}, nbl AS MATERIALIZED (SELECT node, at, list_sort(list(DISTINCT nbr)) AS l FROM (SELECT e.node, d.at, e.nbr FROM inc e JOIN (SELECT DISTINCT at FROM tg) d ON e.day BETWEEN d.at - {W} AND d.at) GROUP BY ALL),
wk AS (SELECT node AS account_id, at AS day, walk, 0 AS step, node AS cur, false AS hit FROM tg, (SELECT unnest(range({n})) AS walk)
  UNION ALL SELECT account_id, day, walk, step, nxt, nxt <> account_id AND nxt IN (SELECT account_id FROM {bad}) FROM (
    SELECT account_id, day, walk, step + 1 AS step, l[CAST(('0x' || substr(md5('42|' || account_id || '|' || day || '|' || walk || '|' || (step + 1)), 1, 8))::BIGINT % len(l) AS BIGINT) + 1] AS nxt
    FROM wk JOIN nbl ON nbl.node = cur AND nbl.at = day WHERE NOT hit AND step < {steps})),
hit AS MATERIALIZED (SELECT account_id, day, walk, step AS length, cur AS hit FROM wk WHERE hit)"""


def _summary(prefix: str = "gw", n: int = N_WALKS) -> str:
    return f"""gwt AS MATERIALIZED (SELECT node AS account_id, at AS day, min(length) AS {prefix}_min, max(length) AS {prefix}_max, avg(length) AS {prefix}_mean, median(length) AS {prefix}_median, stddev_pop(length) AS {prefix}_std,
  quantile_cont(length, 0.25) AS {prefix}_p25, quantile_cont(length, 0.75) AS {prefix}_p75, count(length) / {n} AS {prefix}_hit_rate, count(DISTINCT hit) AS {prefix}_n_distinct FROM tg LEFT JOIN hit h ON h.account_id = node AND h.day = at GROUP BY ALL)"""


_LAST = f"ls AS MATERIALIZED (SELECT * FROM ledger WHERE day BETWEEN (SELECT max(day) FROM ledger) - {W} AND (SELECT max(day) FROM ledger))"
_BFS = f"""{_LAST}, adj AS (SELECT sender_id AS a, receiver_id AS b FROM ls UNION SELECT receiver_id, sender_id FROM ls),
bf AS (SELECT account_id, 0 AS distance FROM illicit UNION SELECT b, distance + 1 FROM bf JOIN adj ON a = account_id WHERE distance < 8), ds AS (SELECT account_id, min(distance) AS distance FROM bf GROUP BY 1)"""
_ROC = """sc AS (SELECT label, score FROM {rows}), pt AS MATERIALIZED (SELECT score, p, n, sum(n) OVER w / sum(n) OVER () AS fpr, sum(p) OVER w / sum(p) OVER () AS tpr FROM (
  SELECT score, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n FROM sc GROUP BY score) WINDOW w AS (ORDER BY score DESC)),
pts AS (SELECT score, fpr, tpr FROM pt UNION ALL SELECT NULL, 0, 0)"""
_RECALL = """(SELECT CASE WHEN b IS NULL OR a.f = 0.2 THEN a.t ELSE a.t + (0.2::DOUBLE - a.f) * (b.t - a.t) / (b.f - a.f) END FROM (
  SELECT max({{'f': fpr, 't': tpr}}) FILTER (WHERE fpr <= 0.2) AS a, min({{'f': fpr, 't': tpr}}) FILTER (WHERE fpr > 0.2) AS b FROM {pts}))"""


def _profile(final: bool) -> str:
    names = "".join(f"""
    , sum(s) OVER w{k} / 100 AS sum_{k}, sum(n) OVER w{k} AS count_{k}, min(lo) OVER w{k} / 100 AS min_{k}, max(hi) OVER w{k} / 100 AS max_{k}
    , CASE WHEN sum(n) OVER w{k} > 0 THEN sum(s) OVER w{k} / sum(n) OVER w{k} / 100 END AS mean_{k}""" for k in WINDOWS)
    frames = ", ".join(f"w{k} AS (PARTITION BY account_id, role ORDER BY day RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for k, n in WINDOWS.items())
    base = f"""tr AS MATERIALIZED (SELECT * FROM (SELECT account_id, role, day, t {names} FROM (
    SELECT account_id, role, day, sum(s) AS s, sum(n) AS n, min(lo) AS lo, max(hi) AS hi, bool_or(t) AS t FROM (
      SELECT account_id, role, day, c AS s, 1 AS n, c AS lo, c AS hi, false AS t FROM sides WHERE account_id IN (SELECT account_id FROM alerts)
      UNION ALL SELECT account_id, role, day, 0, 0, NULL, NULL, true FROM alerts, (SELECT unnest(['sent', 'received']) AS role)) GROUP BY ALL)
    WINDOW {frames}) WHERE t)"""
    cols = [f"{s}_{k}" for k in WINDOWS for s in STATS]
    if not final:
        return sql("alerts", f"SELECT account_id, role, day, {', '.join(f'CAST({c} AS BIGINT) AS {c}' if c.startswith('count') else c for c in cols)} FROM tr", base)
    pivot = ", ".join(f"max({c}) FILTER (WHERE role = '{r}') AS {r}_{c}" for r in ROLES for c in cols)
    first, *longer = WINDOWS
    more = [f"{r}_{s}_{first} / nullif({r}_{s}_{k}, 0) AS {r}_{s}_ratio_{first}_{k}, CAST({r}_{s}_{first} - {r}_{s}_{k} AS {'BIGINT' if s == 'count' else 'DOUBLE'}) AS {r}_{s}_diff_{first}_{k}" for r in ROLES for s in STATS for k in longer]
    more += [f"{r}_sum_{first} / nullif({r}_mean_{k}, 0) AS {r}_burst_ratio_{k}" for r in ROLES for k in longer]
    own = ", ".join(f"CAST({r}_{c} AS BIGINT) AS {r}_{c}" if c.startswith("count") else f"{r}_{c}" for r in ROLES for c in cols)
    return sql("accday", f"SELECT account_id, date, day, label, {own}, {', '.join(more)} FROM accday JOIN pv USING (account_id, day)", f"{base}, pv AS MATERIALIZED (SELECT account_id, day, {pivot} FROM tr GROUP BY ALL)")


_HOP = "b.sender_id = {a}.at AND b.sec - {a}.last BETWEEN {lo} AND {hi} AND b.c * 1000 BETWEEN {a}.lc * 900 AND {a}.lc * 970"
_CHAINS = f"""mv AS (SELECT * FROM ledger WHERE sender_id <> receiver_id),
ch AS (SELECT [txn_id] AS txns, [sender_id, receiver_id] AS accs, c AS fc, c AS lc, sec AS last, receiver_id AS at, 1 AS hops FROM mv
  UNION ALL SELECT list_append(ch.txns, b.txn_id), list_append(ch.accs, b.receiver_id), ch.fc, b.c, b.sec, b.receiver_id, ch.hops + 1
  FROM ch JOIN mv b ON {_HOP.format(a="ch", lo=3600, hi=172800)} AND NOT list_contains(ch.accs, b.receiver_id) WHERE ch.hops < 5)"""
_LAYER = """ly AS (SELECT * FROM ch WHERE hops BETWEEN 2 AND 5 AND NOT (hops < 5 AND txns IN (SELECT txns[1:hops - 1] FROM ch WHERE hops > 1 UNION SELECT txns[2:hops] FROM ch WHERE hops > 1)))"""
_TRIPS = f"""rt AS (SELECT list_append(ch.txns, b.txn_id) AS txns, ch.accs, len(ch.accs) AS n, ch.fc, b.c AS bc FROM ch JOIN mv b ON {_HOP.format(a="ch", lo=3 * 86400, hi=21 * 86400)} AND b.receiver_id = ch.accs[1] WHERE ch.hops <= 3)"""
_SMURF = f"""pay AS (SELECT * FROM ledger WHERE sender_id <> receiver_id AND c BETWEEN {round(SMURF["low"] * 100)} AND {round(SMURF["high"] * 100)}),
pool AS (SELECT a.txn_id, a.receiver_id AS at, a.sec AS last, count(DISTINCT b.sender_id) AS n, CAST(sum(b.c) AS BIGINT) AS lc FROM pay a JOIN pay b ON b.receiver_id = a.receiver_id AND b.sec BETWEEN a.sec - 345600 AND a.sec GROUP BY ALL HAVING count(DISTINCT b.sender_id) >= {SMURF["min_mules"]}),
sm AS (SELECT p.at AS collector, b.receiver_id AS destination, p.n AS n_mules, p.lc / 100 AS pool, b.c / 100 AS forward_amount, p.txn_id AS last_payment_txn, b.txn_id AS forward_txn
  FROM pool p JOIN ledger b ON b.sender_id = p.at AND b.sender_id <> b.receiver_id AND b.sec - p.last BETWEEN 86400 AND 172800 AND b.c * 1000 BETWEEN p.lc * {round(SMURF["forward"][0] * 1000)} AND p.lc * {round(SMURF["forward"][1] * 1000)})"""


_FANS = """fm AS (SELECT * FROM ledger WHERE sender_id <> receiver_id),
lg AS MATERIALIZED (SELECT a.txn_id, a.sender_id AS s, a.receiver_id AS mid, a.sec AS t1, b.receiver_id AS dst FROM fm a JOIN fm b ON b.sender_id = a.receiver_id AND b.sec - a.sec BETWEEN 3600 AND 172800 AND b.c * 1000 BETWEEN a.c * 900 AND a.c * 970 AND b.receiver_id <> a.sender_id),
fa AS MATERIALIZED (SELECT a.s, a.txn_id AS anchor, l.mid, l.dst FROM (SELECT DISTINCT txn_id, s, t1 FROM lg) a JOIN lg l ON l.s = a.s AND l.t1 BETWEEN a.t1 AND a.t1 + 345600),
fq AS (SELECT s, anchor FROM fa GROUP BY ALL HAVING count(DISTINCT mid) >= 2 AND count(DISTINCT dst) <= 3)"""
_FAIR = f"""fg AS MATERIALIZED (SELECT DISTINCT account_id, coalesce(label, false) AS suspicious FROM scored, (SELECT max(day) AS m FROM scored) WHERE NOT coalesce(label, false) OR day > m - {W}),
tg AS MATERIALIZED (SELECT DISTINCT account_id AS node, (SELECT max(day) FROM scored) AS at FROM fg),
nbl AS MATERIALIZED (SELECT node, at, list_sort(list(DISTINCT nbr)) AS l FROM (SELECT e.node, d.at, e.nbr FROM inc e JOIN (SELECT DISTINCT at FROM tg) d ON e.day BETWEEN d.at - {W} AND d.at) GROUP BY ALL)"""


def _hybrid(delay: int) -> str:
    return f"h{delay} AS MATERIALIZED (SELECT DISTINCT account_id FROM scored, (SELECT max(date) AS m FROM scored) WHERE (label AND date < m - {delay}) OR (date >= m - {delay} AND score > 0.8))"


def _fair(key: str) -> str:
    """Walks from the fair groups towards the set h<key>, and medians by group in med<key>."""
    walks = _walks(f"h{key}")
    text = f"{walks[walks.index('wk AS ('):]}, {_summary()}, med AS (SELECT median(gw_hit_rate) FILTER (WHERE suspicious) AS suspicious, median(gw_hit_rate) FILTER (WHERE NOT suspicious) AS legit FROM gwt JOIN fg USING (account_id))"
    return re.sub(r"\b(wk|hit|gwt|med)\b", rf"\g<1>{key}", text)


def _sweep() -> str:
    cells = []
    for s in GRID:
        for t in GRID:
            rows = f"(SELECT label, CAST(in_degree + out_degree AS DOUBLE) AS score FROM kn WHERE w = CASE WHEN label THEN {s} ELSE {t} END)"
            pts = f"""(SELECT sum(n) OVER w / sum(n) OVER () AS fpr, sum(p) OVER w / sum(p) OVER () AS tpr FROM (SELECT score, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n FROM {rows} GROUP BY score) WINDOW w AS (ORDER BY score DESC) UNION ALL SELECT 0, 0)"""
            cells.append(f"SELECT {s} AS tws, {t} AS twl, {_RECALL.format(pts=pts)} AS recall")
    return f"""tg AS (SELECT account_id AS node, day AS at, w, any_true_positive AS label FROM alerts, (SELECT unnest({GRID}) AS w)), {_degrees("(SELECT node, at, w FROM tg)")},
kn AS MATERIALIZED (SELECT tg.label, tg.w, in_degree, out_degree FROM tg JOIN deg USING (node, at, w)), cells AS MATERIALIZED ({" UNION ALL ".join(cells)})"""


_MATRIX = f"SELECT tws, {', '.join(f'max(recall) FILTER (WHERE twl = {t}) AS twl_{t}' for t in GRID)} FROM cells GROUP BY tws"
_CLOSED = "CAST(date AS TIMESTAMP) + INTERVAL 1 DAY <= date_trunc('day', (SELECT mark FROM closed))"
_CROSS = ("large_single_txn", "round_amount_near_threshold", "high_daily_velocity", "sudden_volume_spike")


def oracle_sql() -> dict[str, str]:
    near = f"{_TARGETS}, {_features('tg')}"
    acct = "account_id, date"
    return {
        "l1_read_ledger": sql("ledger", "SELECT txn_id, sender_id, receiver_id, amount, is_sar, pattern_id FROM ledger"),
        "l2_normalise": sql("ledger", "SELECT txn_id, false AS is_sar, CAST(NULL AS VARCHAR) AS pattern_type, CAST(NULL AS VARCHAR) AS pattern_id FROM ledger"),
        "l3_union_ledgers": sql("ledger", "SELECT is_sar, pattern_type, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents FROM ledger GROUP BY ALL"),
        "l4_days": sql("ledger", "SELECT txn_id, date, day FROM ledger"),
        "l5_directions": sql("directed", "SELECT txn_id, direction FROM directed"),
        "l6_both_sides": sql("sides", "SELECT account_id, counterparty, role, txn_id FROM sides"),
        "l7_pattern_account_days": sql("patdays", "SELECT pattern_id, pattern_type, account_id, date FROM patdays"),
        "l8_stage_tables": sql("accday", f"""SELECT {acct}, total_sent, total_received, n_txns, replace(counterparties, ',', '|') AS counterparties, s AS direction_summary, label FROM accday JOIN (
          SELECT account_id, date, '{{' || string_agg('"' || direction || '":' || n, ',' ORDER BY direction) || '}}' AS s FROM (SELECT account_id, date, direction, count(*) AS n FROM dsides GROUP BY ALL) GROUP BY ALL) USING (account_id, date)"""),
        "l9_sweep_matrix_csv": sql("alerts inc", _MATRIX, _sweep()),
        "l10_until": sql("ledger", "SELECT txn_id FROM ledger WHERE timestamp < TIMESTAMP '2024-01-16'"),
        "r1_large_single_txn": sql("hits", f"SELECT {acct}, rule_name FROM hits WHERE k = 0"),
        "r2_round_amount": sql("hits", f"SELECT {acct}, rule_name FROM hits WHERE k = 1"),
        "r3_high_daily_velocity": sql("hits", f"SELECT {acct}, rule_name FROM hits WHERE k = 2"),
        "r3_approximate_velocity": sql("sides", "SELECT a.account_id, a.day, count(DISTINCT s.counterparty) AS n FROM (SELECT DISTINCT account_id, day FROM sides) a JOIN sides s ON s.account_id = a.account_id AND s.day BETWEEN a.day - 6 AND a.day GROUP BY ALL HAVING count(DISTINCT s.counterparty) > 20"),
        "r4_sudden_volume_spike": sql("hits", f"SELECT {acct}, rule_name FROM hits WHERE k = 3"),
        "r5_run_rule_engine": sql("alerts", f"SELECT {acct}, array_to_string(triggered_rules, ',') AS triggered_rules, any_true_positive FROM alerts"),
        "r6_sar_account_days": sql("sardays", f"SELECT {acct} FROM sardays"),
        "r7_custom_rules": sql("sardays", f"""SELECT h.*, s.date IS NOT NULL AS any_true_positive FROM (SELECT {acct}, string_agg(r, ',' ORDER BY k) AS triggered_rules FROM (
          SELECT sender_id AS account_id, date, 'tiny' AS r, 0 AS k FROM ledger WHERE amount > 4000 UNION ALL SELECT account_id, date, 'busy', 1 FROM sides GROUP BY account_id, date HAVING count(DISTINCT counterparty) > 8) GROUP BY ALL) h LEFT JOIN sardays s USING (account_id, date)"""),
        "a1_account_days": sql("accday", f"SELECT {acct}, total_sent, total_received, n_txns, counterparties, label FROM accday"),
        "a2_direction_summary": sql("accday", f"SELECT {acct}, string_agg(direction || '=' || n, ',' ORDER BY direction) AS direction_summary FROM (SELECT a.account_id, a.date, direction, count(*) AS n FROM accday a JOIN dsides s ON s.account_id = a.account_id AND s.date = a.date GROUP BY ALL) GROUP BY ALL"),
        "a3_illicit_accounts": sql("illicit", "SELECT account_id FROM illicit"),
        "p1_target_ledger": sql("alerts", "SELECT account_id, role, txn_id FROM sides WHERE account_id IN (SELECT account_id FROM alerts)"),
        "p2_daily_totals": sql("alerts", "SELECT account_id, role, day, CAST(sum(c) AS BIGINT) AS s, count(*) AS n, min(c) AS lo, max(c) AS hi FROM sides WHERE account_id IN (SELECT account_id FROM alerts) GROUP BY ALL"),
        "p3_trailing_windows": _profile(False),
        "p4_p6_profile_features": _profile(True),
        "p7_no_lookahead": sql("alerts", f"SELECT {acct} FROM alerts WHERE false"),
        "p8_chosen_features": sql("ledger", """SELECT feature, importance, rank FROM (SELECT *, row_number() OVER o AS rank, sum(importance) OVER (o ROWS UNBOUNDED PRECEDING) AS run, sum(importance) OVER () AS al FROM (
          SELECT sender_id AS feature, greatest(CAST(sum(c) AS BIGINT) / 100 - 20000.0::DOUBLE, 0) AS importance FROM ledger GROUP BY 1) WINDOW o AS (ORDER BY importance DESC, feature))
          QUALIFY al = 0 OR rank <= sum(CASE WHEN run / al < 0.9 THEN 1 ELSE 0 END) OVER () + 1"""),
        "g1_snapshot": sql("alerts", f"SELECT at, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents FROM (SELECT DISTINCT day AS at FROM alerts) JOIN ledger ON ledger.day BETWEEN at - {W} AND at GROUP BY at"),
        "g2_neighbours": sql("alerts inc", "SELECT node, at, string_agg(nbr, ',' ORDER BY nbr) AS neighbours FROM nb GROUP BY ALL", near),
        "g3_g4_degrees": sql("alerts inc", "SELECT * FROM deg", f"{_TARGETS}, {_degrees('tg')}"),
        "g5_live_edges": sql("ledger", f"SELECT day, CAST(sum(n) OVER (ORDER BY day RANGE BETWEEN {W} PRECEDING AND CURRENT ROW) AS BIGINT) AS n_edges FROM (SELECT day, count(*) AS n FROM ledger GROUP BY day)"),
        "g6_degree_features": sql("alerts inc", "SELECT * FROM ft", near),
        "g7_dual_window_degrees": sql("alerts inc", "SELECT * FROM ft", f"tg AS (SELECT DISTINCT account_id AS node, day AS at, CASE WHEN any_true_positive THEN 3 ELSE 14 END AS w FROM alerts), {_features('tg')}"),
        "g8_degree_histogram": sql("sides", "SELECT degree, count(*) AS accounts FROM (SELECT account_id, count(DISTINCT counterparty) AS degree FROM sides GROUP BY 1) GROUP BY 1"),
        "g9_hop_distances": sql("illicit", "SELECT account_id, distance FROM (SELECT a AS account_id FROM adj UNION SELECT account_id FROM illicit) LEFT JOIN ds USING (account_id)", _BFS, True),
        "g10_sar_components": sql("sides", "SELECT component, count(*) AS size FROM (SELECT a, min(b) AS component FROM rc GROUP BY a) GROUP BY 1", "rc AS (SELECT account_id AS a, account_id AS b FROM sides WHERE is_sar UNION SELECT rc.a, s.counterparty FROM rc JOIN sides s ON s.account_id = rc.b AND s.is_sar)", True),
        "g11_chain_order": sql("ledger", """SELECT pattern_id, string_agg(a, ',' ORDER BY k, a) AS accounts FROM (SELECT pattern_id, a, min(k) AS k FROM (SELECT pattern_id, receiver_id AS a, n AS k FROM o UNION ALL SELECT pattern_id, sender_id, 0 FROM o WHERE n = 1) GROUP BY ALL) GROUP BY 1""",
            "o AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY timestamp, txn_id) AS n FROM ledger WHERE is_sar)"),
        "w1_random_walks": sql("illicit inc", "SELECT account_id, day, walk, length, hit FROM hit", _walks(), True),
        "w1_day_walks": sql("illicit inc", "SELECT account_id, day, walk, length, hit FROM hit", _walks(), True),
        "w1_full_walks": sql("illicit inc", "SELECT * FROM gwt", f"{_walks(n=50, steps=20)}, {_summary(n=50)}", True),
        "w2_w4_walk_features": sql("illicit inc", "SELECT * FROM gwt", f"{_walks()}, {_summary()}", True),
        "w3_illicit_starts": sql("illicit", "SELECT DISTINCT account_id, day, 0 AS gw_min, 0 AS gw_max, 0.0::DOUBLE AS gw_mean, 0.0::DOUBLE AS gw_median, 0.0::DOUBLE AS gw_std, 0.0::DOUBLE AS gw_p25, 0.0::DOUBLE AS gw_p75, 1.0::DOUBLE AS gw_hit_rate, 1::BIGINT AS gw_n_distinct FROM alerts WHERE account_id IN (SELECT account_id FROM illicit)"),
        "w5_delay_aware_walks": sql("scored inc", "SELECT * FROM gwt", f"hy AS MATERIALIZED (SELECT DISTINCT account_id FROM scored, (SELECT max(date) AS m FROM scored) WHERE (label AND date < m - 7) OR (date >= m - 7 AND score > 0.8)), {_walks('hy')}, {_summary('gwd')}", True),
        "w6_separation": sql("illicit scored inc", "SELECT h.*, h.suspicious - h.legit AS separation, r.suspicious - r.legit AS reference, (h.suspicious - h.legit) / nullif(r.suspicious - r.legit, 0) AS share FROM med7 h, medt r", f"{_FAIR}, ht AS (SELECT account_id FROM illicit), {_hybrid(7)}, {_fair('t')}, {_fair('7')}", True),
        "w7_by_distance": sql("illicit inc", "SELECT *, median_hit_rate <= lag(median_hit_rate) OVER (ORDER BY distance) AS falls FROM (SELECT distance, count(*) AS accounts, median(gw_hit_rate) AS median_hit_rate, median(gw_mean) AS median_length FROM gwt JOIN pk USING (account_id) GROUP BY 1)",
            f"{_BFS}, pk AS MATERIALIZED (SELECT * FROM ds WHERE distance BETWEEN 1 AND 4 QUALIFY row_number() OVER (PARTITION BY distance ORDER BY md5(account_id), account_id) <= 15), {_walks().replace(_TARGETS, 'tg AS (SELECT account_id AS node, (SELECT max(day) FROM ledger) AS at FROM pk)')}, {_summary()}", True),
        "y1_recent": sql("scored", f"SELECT {acct}, score FROM scored WHERE date >= (SELECT max(date) - 7 FROM scored)"),
        "y2_pseudo_labels": sql("scored", f"SELECT {acct}, score > 0.25 AS pseudo_label FROM scored WHERE date >= (SELECT max(date) - 7 FROM scored)"),
        "y3_hybrid_set": sql("scored", "SELECT DISTINCT account_id FROM scored, (SELECT max(date) AS m FROM scored) WHERE (label AND date < m - 7) OR (date >= m - 7 AND score > 0.8)"),
        "y4_alignment": sql("scored", "SELECT delay, threshold, count(*) AS n_recent, count(*) FILTER (WHERE score > threshold) AS n_pseudo, count(*) FILTER (WHERE label) AS n_real, count(*) FILTER (WHERE label AND score > threshold) / nullif(count(*) FILTER (WHERE score > threshold), 0) AS precision, count(*) FILTER (WHERE label AND score > threshold) / nullif(count(*) FILTER (WHERE label), 0) AS recall FROM scored, (SELECT max(date) AS m FROM scored), (SELECT unnest([3, 7, 14]) AS delay), (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS threshold) WHERE date >= m - CAST(delay AS INTEGER) GROUP BY ALL"),
        "y5_hybrid_growth": sql("scored inc", f"""SELECT delay, hybrid_size, recent_real, suspicious, legit, suspicious - legit AS separation FROM (
          SELECT delay, count(DISTINCT account_id) FILTER (WHERE (label AND date < m - CAST(delay AS INTEGER)) OR (date >= m - CAST(delay AS INTEGER) AND score > 0.8)) AS hybrid_size, count(*) FILTER (WHERE label AND date >= m - CAST(delay AS INTEGER)) AS recent_real
          FROM scored, (SELECT max(date) AS m FROM scored), (SELECT unnest({DELAYS}) AS delay) GROUP BY 1) JOIN ({" UNION ALL ".join(f"SELECT {d} AS delay, * FROM med{d}" for d in DELAYS)}) USING (delay)""",
            f"{_FAIR}, {', '.join(f'{_hybrid(d)}, {_fair(str(d))}' for d in DELAYS)}", True),
        "y5_degradation": sql("illicit scored inc", """SELECT c.*, c.suspicious - c.legit AS separation, r.suspicious - r.legit AS reference, (c.suspicious - c.legit) / nullif(r.suspicious - r.legit, 0) AS share FROM cells c, cells r WHERE c.delay > 0 AND r.delay = 0""",
            f"""{_FAIR}, pth AS (SELECT node AS account_id, at AS day, walk, 0 AS step, node AS cur FROM tg, (SELECT unnest(range({N_WALKS})) AS walk)
  UNION ALL SELECT account_id, day, walk, step + 1, l[CAST(('0x' || substr(md5('42|' || account_id || '|' || day || '|' || walk || '|' || (step + 1)), 1, 8))::BIGINT % len(l) AS BIGINT) + 1] FROM pth JOIN nbl ON nbl.node = cur AND nbl.at = day WHERE step < {STEPS}),
grid AS (SELECT d.delay, t.threshold FROM (SELECT unnest({DELAYS}) AS delay) d, (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold) t UNION ALL SELECT 0, 0.0::DOUBLE),
sets AS (SELECT DISTINCT delay, threshold, account_id FROM scored, (SELECT max(date) AS m FROM scored), grid WHERE delay > 0 AND ((label AND date < m - CAST(delay AS INTEGER)) OR (date >= m - CAST(delay AS INTEGER) AND score > threshold)) UNION ALL SELECT 0, 0.0::DOUBLE, account_id FROM illicit),
rate AS (SELECT delay, threshold, p.account_id, count(DISTINCT walk) / {N_WALKS} AS rate FROM pth p JOIN sets s ON s.account_id = cur WHERE cur <> p.account_id GROUP BY ALL),
cells AS MATERIALIZED (SELECT delay, threshold, median(coalesce(rate, 0)) FILTER (WHERE suspicious) AS suspicious, median(coalesce(rate, 0)) FILTER (WHERE NOT suspicious) AS legit FROM (SELECT * FROM grid, fg) LEFT JOIN rate USING (delay, threshold, account_id) GROUP BY ALL)""", True),
        "m1_temporal_split": sql("scored", f"SELECT {acct}, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY date, account_id) AS r, round_even(count(*) OVER () * 0.6::DOUBLE, 0) AS a, round_even(count(*) OVER () * 0.1::DOUBLE, 0) AS b FROM scored)"),
        "m2_median_split": sql("scored", "SELECT CASE WHEN day <= (SELECT median(day) FROM scored) THEN 'early' ELSE 'late' END AS part, count(*) AS n, min(day) AS first, max(day) AS last FROM scored GROUP BY 1"),
        "m4_balanced_weights": sql("scored", "SELECT label, (SELECT count(*) FROM scored) / (2 * count(*)) AS weight FROM scored GROUP BY 1"),
        "m7_roc_points": sql("scored", "SELECT score, fpr, tpr FROM pts", _ROC.format(rows="scored")),
        "m8_recall_at_fpr": sql("scored", f"SELECT {_RECALL.format(pts='pts')} AS recall", _ROC.format(rows="scored")),
        "m9_roc_auc": sql("scored", "SELECT sum((fpr - pf) * (tpr + pt)) / 2 AS auc FROM (SELECT fpr, tpr, lag(fpr, 1, 0) OVER o AS pf, lag(tpr, 1, 0) OVER o AS pt FROM pts WHERE score IS NOT NULL WINDOW o AS (ORDER BY score DESC))", _ROC.format(rows="scored")),
        "m10_assembled": sql("accday inc illicit", f"""SELECT a.account_id, a.day, a.label, CAST(coalesce((SELECT sum(c) FROM sides s WHERE s.account_id = a.account_id AND s.role = 'sent' AND s.day BETWEEN a.day - 6 AND a.day), 0) AS BIGINT) / 100 AS sent_sum_1w,
          (SELECT count(*) FROM sides s WHERE s.account_id = a.account_id AND s.role = 'received' AND s.day = a.day) AS received_count_1d, in_degree, nbr_in_degree_mean, gw_hit_rate, gw_n_distinct AS gwd_n_distinct FROM accday a JOIN ft USING (account_id, day) JOIN gwt USING (account_id, day)""", f"{_walks()}, {_summary()}, {_features('tg')}", True),
        "m15_dataset_summary": sql("accday", "SELECT (SELECT count(*) FROM ledger) AS txns, (SELECT count(*) FROM ledger WHERE is_sar) AS sar_txns, (SELECT count(*) FROM accounts) AS accounts, count(*) AS account_days, count(*) FILTER (WHERE label) AS positives FROM accday"),
        "m15_split_summary": sql("scored", "SELECT CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'validation' ELSE 'test' END AS split, count(*) AS rows, count(*) FILTER (WHERE label) AS positives FROM (SELECT *, row_number() OVER (ORDER BY date, account_id) AS r, round_even(count(*) OVER () * 0.6::DOUBLE, 0) AS a, round_even(count(*) OVER () * 0.1::DOUBLE, 0) AS b FROM scored) GROUP BY 1"),
        "m14_sweep_matrix": sql("alerts inc", _MATRIX, _sweep()),
        "m14_best_cell": sql("alerts inc", "SELECT tws, twl, recall FROM cells ORDER BY recall DESC, tws, twl LIMIT 1", _sweep()),
        "m17_log_loss": sql("scored", "SELECT avg(CASE WHEN label THEN -ln(p) ELSE -ln(1 - p) END) AS log_loss FROM (SELECT label, greatest(least(score, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE) AS p FROM scored)"),
        "q1_alert_quality": sql("alerts", "SELECT count(*) AS alerts, count(*) FILTER (WHERE any_true_positive) AS true_positives, 1 - count(*) FILTER (WHERE any_true_positive) / count(*) AS false_positive_rate FROM alerts"),
        "q2_rule_volume": sql("hits", "SELECT rule_name, count(DISTINCT (account_id, date)) AS alerts, count(DISTINCT account_id) AS accounts FROM hits GROUP BY 1"),
        "q3_rules_per_alert": sql("alerts", "SELECT CAST(len(triggered_rules) AS INTEGER) AS n_rules, count(*) AS alerts FROM alerts GROUP BY 1"),
        "q4_pattern_coverage": sql("patdays alerts", "SELECT pattern_type, count(*) AS patterns, avg(CAST(caught AS INTEGER)) AS share_caught FROM (SELECT pattern_type, pattern_id, bool_or(a.date IS NOT NULL) AS caught FROM patdays p LEFT JOIN alerts a USING (account_id, date) GROUP BY ALL) GROUP BY 1"),
        "q4_missed_patterns": sql("patdays", "SELECT l.pattern_type, l.pattern_id, CAST(count(*) AS INTEGER) AS n, min(amount) AS least FROM ledger l WHERE is_sar AND l.pattern_id NOT IN (SELECT p.pattern_id FROM patdays p JOIN ledger b ON b.sender_id = p.account_id AND b.date = p.date WHERE b.amount > 20000) GROUP BY ALL"),
        "q5_rule_crosstab": sql("patdays alerts", f"SELECT pattern_type, {', '.join(f'''count(*) FILTER (WHERE r = '{r}') AS {r}''' for r in _CROSS)} FROM (SELECT pattern_type, unnest(triggered_rules) AS r FROM patdays JOIN alerts USING (account_id, date)) GROUP BY 1"),
        "q6_rules_on_role": sql("patdays alerts involved", "SELECT r AS rule_name, count(*) AS count FROM (SELECT unnest(triggered_rules) AS r FROM alerts WHERE (account_id, date) IN (SELECT (account_id, date) FROM patdays JOIN involved USING (pattern_id, account_id) WHERE role = 'collector' AND involved.pattern_type = 'smurfing')) GROUP BY 1"),
        "q7_sole_triggers": sql("alerts", "SELECT s.account_id, s.date, s.txn_id, s.role, s.amount, o.rule_name FROM (SELECT account_id, date, triggered_rules[1] AS rule_name FROM alerts WHERE len(triggered_rules) = 1 AND NOT any_true_positive QUALIFY row_number() OVER (PARTITION BY triggered_rules[1] ORDER BY md5('42|' || account_id || '|' || date)) = 1) o JOIN sides s USING (account_id, date)"),
        "q8_suspicious_share": sql("accounts", "SELECT count(*) AS accounts, (SELECT count(DISTINCT account_id) FROM sides WHERE is_sar) AS suspicious, (SELECT count(DISTINCT account_id) FROM sides WHERE is_sar) / count(*) AS share FROM accounts"),
        "q8_patterns_by_type": sql("ledger", "SELECT pattern_type, count(DISTINCT pattern_id) AS patterns FROM ledger WHERE is_sar GROUP BY 1"),
        "q8_shared_accounts": sql("involved", "SELECT account_id, count(DISTINCT pattern_id) AS patterns FROM involved GROUP BY 1 HAVING count(DISTINCT pattern_id) > 1"),
        "q9_amount_histogram": sql("accounts", "SELECT *, n / (sum(n) OVER (PARTITION BY persona) * 0.5::DOUBLE) AS density FROM (SELECT persona, bin, count(*) AS n FROM (SELECT persona, CAST(greatest(0, least(11, floor(log10(amount) / 0.5::DOUBLE))) AS INTEGER) AS bin FROM ledger JOIN accounts ON account_id = sender_id WHERE amount > 0) GROUP BY ALL)"),
        "q10_activity_by_persona": sql("accounts", "SELECT persona, avg(n) AS mean_sent, avg(d) AS mean_degree, median(d) AS median_degree, max(d) AS max_degree FROM (SELECT account_id, persona, (SELECT count(*) FROM ledger WHERE sender_id = a.account_id) AS n, (SELECT count(DISTINCT counterparty) FROM sides s WHERE s.account_id = a.account_id) AS d FROM accounts a) GROUP BY 1"),
        "q11_degree_medians": sql("alerts inc involved accounts", "SELECT grp, count(*) AS n, median(in_degree) AS in_degree, median(out_degree) AS out_degree FROM deg JOIN (SELECT a.account_id, coalesce(r, CASE WHEN persona <> 'high_volume_merchant' THEN 'legit' END) AS grp FROM accounts a LEFT JOIN (SELECT account_id, min(role) AS r FROM involved GROUP BY 1) USING (account_id)) g ON g.account_id = node WHERE grp IS NOT NULL GROUP BY 1", f"{_TARGETS}, {_degrees('tg')}"),
        "q12_stratified_sample": sql("scored", f"SELECT {acct}, label FROM scored QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42|' || account_id || '|' || date)) <= 25"),
        "q13_repeatability": sql("alerts", f"SELECT {acct} FROM alerts WHERE false"),
        "t1_smurfing": sql("ledger", "SELECT * FROM sm", _SMURF),
        "t2_layering": sql("ledger", "SELECT array_to_string(txns, ',') AS txns, array_to_string(accs, ',') AS accounts, CAST(len(accs) AS INTEGER) AS n_accounts, fc / 100 AS first_amount, lc / 100 AS last_amount FROM ly", f"{_CHAINS}, {_LAYER}", True),
        "t3_fan_out_fan_in": sql("ledger", "SELECT a.s AS source, a.txn_id AS anchor_txn, count(DISTINCT l.mid) AS n_intermediates, count(DISTINCT l.dst) AS n_destinations, max(l.t2) AS last_ts FROM (SELECT DISTINCT txn_id, s, t1 FROM lg) a JOIN lg l ON l.s = a.s AND l.t1 BETWEEN a.t1 AND a.t1 + 345600 GROUP BY ALL HAVING count(DISTINCT l.mid) >= 2 AND count(DISTINCT l.dst) <= 3",
            "mv AS (SELECT * FROM ledger WHERE sender_id <> receiver_id), lg AS MATERIALIZED (SELECT a.txn_id, a.sender_id AS s, a.receiver_id AS mid, a.sec AS t1, b.receiver_id AS dst, b.sec AS t2 FROM mv a JOIN mv b ON b.sender_id = a.receiver_id AND b.sec - a.sec BETWEEN 3600 AND 172800 AND b.c * 1000 BETWEEN a.c * 900 AND a.c * 970 AND b.receiver_id <> a.sender_id)"),
        "t4_round_trips": sql("ledger", "SELECT array_to_string(txns, ',') AS txns, array_to_string(accs, ',') AS accounts, CAST(n AS INTEGER) AS n_accounts, fc / 100 AS amount_out, bc / 100 AS amount_back FROM rt", f"{_CHAINS}, {_TRIPS}", True),
        "t5_pattern_roles": sql("ledger", """SELECT pattern_type, role, count(DISTINCT p) AS patterns, count(DISTINCT a) AS accounts FROM (
          SELECT 'smurfing' AS pattern_type, last_payment_txn || forward_txn AS p, unnest([collector, destination]) AS a, unnest(['collector', 'destination']) AS role FROM sm
          UNION ALL SELECT 'smurfing', last_payment_txn || forward_txn, b.sender_id, 'mule' FROM sm JOIN pay a ON a.txn_id = last_payment_txn JOIN pay b ON b.receiver_id = a.receiver_id AND b.sec BETWEEN a.sec - 345600 AND a.sec
          UNION ALL SELECT 'fan_out_fan_in', anchor, unnest([s, mid, dst]), unnest(['source', 'intermediate', 'destination']) FROM fa JOIN fq USING (s, anchor)
          UNION ALL SELECT 'layering', array_to_string(txns, ','), unnest(accs), unnest([CASE WHEN i = 1 THEN 'origin' WHEN i = len(accs) THEN 'destination' ELSE 'intermediate' END FOR i IN range(1, len(accs) + 1)]) FROM ly
          UNION ALL SELECT 'round_tripping', array_to_string(txns, ','), unnest(accs), unnest([CASE WHEN i = 1 THEN 'origin' ELSE 'intermediate' END FOR i IN range(1, len(accs) + 1)]) FROM rt) GROUP BY ALL""", f"{_CHAINS}, {_LAYER}, {_TRIPS}, {_SMURF}, {_FANS}", True),
        "s1_transaction_alerts": sql("hits", f"SELECT {acct}, rule_name FROM hits WHERE k < 2"),
        "s2_velocity_stream": sql("velocity closed", f"SELECT {acct}, 'high_daily_velocity' AS rule_name FROM velocity WHERE {_CLOSED}"),
        "s3_spike_stream": sql("spike closed", f"SELECT {acct}, 'sudden_volume_spike' AS rule_name FROM spike WHERE {_CLOSED}"),
        "s4_sliding_degrees_stream": sql("inc closed", f"SELECT node AS account_id, at AS day, in_degree, out_degree, in_weight, out_weight FROM deg WHERE CAST(DATE '2024-01-01' + at AS TIMESTAMP) + INTERVAL 1 DAY <= date_trunc('day', (SELECT mark FROM closed))", f"tg AS (SELECT DISTINCT account_id AS node, day AS at, {W} AS w FROM sides), {_degrees('tg')}"),
        "s5_late_rows": sql("ledger", "SELECT txn_id, day < 5 AND ends_with(txn_id, '7') AS late FROM ledger"),
    }
