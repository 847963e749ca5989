"""SQL that DuckDB runs on the same tables, for every registered query that SQL can express."""

from __future__ import annotations

from tickcast.functions import instruments as I  # noqa: E741

_BARS = """
e AS (SELECT event_type AS contract, time_bucket(INTERVAL '15 minutes', ts) AS time, ts, event_id, value FROM events),
bars AS (SELECT contract, time, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
                last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM e GROUP BY contract, time),
inv AS (SELECT event_type AS contract, ts, event_id, CAST(floor(value) AS INT) AS inventory FROM events),
sig AS (SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS cutoff FROM (
    SELECT contract, ts, event_id, inventory, CAST(inventory - lag(inventory) OVER (PARTITION BY contract ORDER BY ts, event_id) AS DOUBLE) AS signal FROM inv) WHERE signal <> 0)"""


def _chain(training: str = "SELECT contract, TIMESTAMP '9999-01-01' AS cutoff, * EXCLUDE (contract) FROM bars", tau: int = 5, tick: float | str = 1.0, alpha: float = 0.5, method: str = "smoothed") -> str:
    """Common table expressions of a fit, one model for each (contract, cutoff) of ``training``."""
    prob = f"(n_seen + {alpha}) / denominator" if method == "smoothed" else "n_seen / denominator"
    denominator = f"n_total + {alpha} * (max_ell + 1)" if method == "smoothed" else "CAST(n_total AS DOUBLE)"
    base = f"{alpha} / denominator" if method == "smoothed" else "0.0"
    dense = "CASE WHEN num_bins <= 1000 AND max_ell >= 0 THEN range(0, max_ell + 1) ELSE [0] END" if method == "smoothed" else "[0]"
    ew = "sum({0} * pow(2, bar_seq / 10.0)) OVER u / sum(pow(2, bar_seq / 10.0)) OVER u"
    return f"""{_BARS},
tr AS ({training}),
days AS (SELECT contract, cutoff, CAST(time AS DATE) AS date, count(*) AS n_bars FROM tr GROUP BY ALL),
daily AS (SELECT *, n_bars >= expected * 0.9 AS is_kept FROM (SELECT *, quantile_cont(n_bars, 0.5) OVER (PARTITION BY contract, cutoff) AS expected FROM days)),
kept AS (SELECT tr.* FROM tr JOIN daily d ON tr.contract = d.contract AND tr.cutoff = d.cutoff AND CAST(tr.time AS DATE) = d.date AND d.is_kept),
gaps AS (SELECT *, CASE WHEN time - lag(time) OVER w <= INTERVAL 4 HOURS THEN 0 ELSE 1 END AS new FROM kept WINDOW w AS (PARTITION BY contract, cutoff ORDER BY time)),
sess AS (SELECT *, CAST(sum(new) OVER (PARTITION BY contract, cutoff ORDER BY time) AS INT) AS session_id FROM gaps),
num AS (SELECT *, row_number() OVER (PARTITION BY contract, cutoff, session_id ORDER BY time) AS rn FROM sess),
tau AS (SELECT contract, cutoff, session_id, CAST((rn - 1) // {tau} AS INT) AS bar_idx, min(time) AS time, arg_min(open, rn) AS open, max(high) AS high, min(low) AS low,
               arg_max(close, rn) AS close, sum(volume) AS volume, 1.0 AS completeness FROM num GROUP BY contract, cutoff, session_id, (rn - 1) // {tau} HAVING count(*) = {tau}),
ranged AS (SELECT *, row_number() OVER (PARTITION BY contract, cutoff ORDER BY time) - 1 AS bar_seq, CAST(round_even((high - low) / {tick}, 0) AS BIGINT) AS r,
                  CAST(round_even((high - open) / {tick}, 0) AS BIGINT) AS r_up, CAST(round_even((open - low) / {tick}, 0) AS BIGINT) AS r_dn FROM tau),
dx AS (SELECT *, coalesce(open - lag(open) OVER (PARTITION BY contract, cutoff ORDER BY bar_seq), 0.0) AS delta_x FROM ranged),
ew AS (SELECT *, coalesce({ew.format("volume")}, 0.0) AS v_raw, coalesce({ew.format("r")}, 0.0) AS s_raw, coalesce({ew.format("delta_x")}, 0.0) AS d_raw
       FROM dx WINDOW u AS (PARTITION BY contract, cutoff ORDER BY bar_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
feats AS (SELECT *, round(v_raw, 9) AS v_ewma, round(s_raw, 9) AS sigma_ewma, round(d_raw, 9) AS delta_x_ewma FROM ew),
burn AS (SELECT contract, cutoff, count(*) AS n_bars, CASE WHEN 150 >= count(*) THEN count(*) // 2 ELSE 150 END AS j_s FROM feats GROUP BY ALL),
b0 AS (SELECT f.contract, f.cutoff, any_value(n_bars) AS n_bars, CAST(any_value(j_s) AS BIGINT) AS j_s, round(quantile_cont(v_ewma, 1.0::DOUBLE / 3), 9) AS v1, round(quantile_cont(v_ewma, 2.0::DOUBLE / 3), 9) AS v2,
              round(quantile_cont(sigma_ewma, 1.0::DOUBLE / 3), 9) AS s1, round(quantile_cont(sigma_ewma, 2.0::DOUBLE / 3), 9) AS s2, round(quantile_cont(delta_x_ewma, 0.5), 9) AS d1
       FROM feats f JOIN burn b ON f.contract = b.contract AND f.cutoff = b.cutoff WHERE bar_seq >= j_s GROUP BY f.contract, f.cutoff),
bounds AS (SELECT *, CASE WHEN v1 = v2 OR s1 = s2 THEN 'degenerate_bins' ELSE 'ok' END AS status FROM b0),
st AS (SELECT f.*, j_s, 1 + (v_ewma > v1)::INT + (v_ewma > v2)::INT AS m, 1 + (sigma_ewma > s1)::INT + (sigma_ewma > s2)::INT AS n, 1 + (delta_x_ewma > d1)::INT AS k
       FROM feats f JOIN bounds b ON f.contract = b.contract AND f.cutoff = b.cutoff AND status = 'ok'),
used AS (SELECT * FROM st WHERE bar_seq >= j_s),
freq AS (SELECT contract, cutoff, m, n, k, direction, ell, count(*) AS n_seen FROM (
    SELECT contract, cutoff, m, n, k, 'range' AS direction, r AS ell FROM used UNION ALL SELECT contract, cutoff, m, n, k, 'range_up', r_up FROM used
    UNION ALL SELECT contract, cutoff, m, n, k, 'range_dn', r_dn FROM used) GROUP BY ALL),
tot AS (SELECT *, {base} AS base_prob FROM (SELECT *, max_ell + 1 AS num_bins, {denominator} AS denominator FROM (
    SELECT contract, cutoff, m, n, k, direction, CAST(sum(n_seen) AS BIGINT) AS n_total, max(ell) AS max_ell FROM freq GROUP BY ALL))),
lev AS (SELECT contract, cutoff, m, n, k, direction, CAST(unnest({dense}) AS BIGINT) AS ell FROM tot UNION SELECT contract, cutoff, m, n, k, direction, ell FROM freq),
pmf AS (SELECT l.*, {prob} AS prob, base_prob, num_bins, max_ell, n_total FROM (
    SELECT l.*, coalesce(f.n_seen, 0) AS n_seen FROM lev l LEFT JOIN freq f USING (contract, cutoff, m, n, k, direction, ell)) l JOIN tot t USING (contract, cutoff, m, n, k, direction)),
every AS (SELECT contract, cutoff, m, n, k, direction, base_prob, CAST(unnest(range(0, max_ell + 1)) AS BIGINT) AS ell FROM tot WHERE direction <> 'range'),
cdf AS (SELECT contract, cutoff, m, n, k, direction, ell, sum(p) OVER (PARTITION BY contract, cutoff, m, n, k, direction ORDER BY ell DESC) AS cum_prob FROM (
    SELECT v.*, coalesce(p.prob, v.base_prob) AS p FROM every v LEFT JOIN pmf p USING (contract, cutoff, m, n, k, direction, ell)))"""


_A = "(1 - pow(2, -0.1))"
_LIVE = f"""
lv0 AS (SELECT *, row_number() OVER w - 1 AS j, close - lag(close) OVER w AS diff, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM bars WINDOW w AS (PARTITION BY contract ORDER BY time)),
lv AS (SELECT contract, time, close,
    sum(CASE WHEN j = 0 THEN volume ELSE {_A} * volume END * pow(2, j / 10.0)) OVER u * pow(2, -j / 10.0) AS volume_ewma,
    CASE WHEN j > 0 THEN sqrt(sum(CASE WHEN j = 1 THEN ret * ret WHEN j > 1 THEN {_A} * ret * ret END * pow(2, j / 10.0)) OVER u * pow(2, -j / 10.0)) END AS volatility_ewma,
    CASE WHEN j > 0 THEN sum(CASE WHEN j = 1 THEN diff WHEN j > 1 THEN 2.0 / 21 * diff END * exp(-j * ln(19.0 / 21))) OVER u * exp(j * ln(19.0 / 21)) END AS ewma_delta_x
    FROM lv0 WINDOW u AS (PARTITION BY contract ORDER BY j)),
rd AS (SELECT contract, time, round(volume_ewma, 9) AS a, round(volatility_ewma, 9) AS b, round(ewma_delta_x, 9) AS c FROM lv),
ls AS (SELECT r.contract, cutoff, time, 1 + coalesce(a >= v1, false)::INT + coalesce(a >= v2, false)::INT AS m, 1 + coalesce(b >= s1, false)::INT + coalesce(b >= s2, false)::INT AS n,
              1 + coalesce(c >= d1, false)::INT AS k FROM rd r JOIN bounds d ON r.contract = d.contract)"""
_UNTIL = "SELECT contract, TIMESTAMP '9999-01-01' AS cutoff, * EXCLUDE (contract) FROM bars WHERE time <= TIMESTAMP '2024-01-12 00:00:00'"
_EACH = "SELECT b.contract, c.cutoff, b.* EXCLUDE (contract) FROM bars b JOIN (SELECT DISTINCT contract, cutoff FROM sig) c ON b.contract = c.contract AND b.time <= c.cutoff"
_KEY = "contract, m, n, k, direction, ell"


#: Tick size of an event type's symbol, as the query takes it from the table of symbols and an override.
_TICK = f"(CASE length(contract) % 3 WHEN 0 THEN {I.TICK_SIZES['ES']} WHEN 1 THEN {I.TICK_SIZES['VG']} ELSE 1.0 END)"


#: Name and tick size of an event type's contract file.
_HASH = "((2 * length(contract) + ascii(contract)) % 7)"
_FILE = f"(['GC', 'NQ', 'VG'][{_HASH} % 3 + 1] || substr('FGHJKMN', {_HASH} + 1, 1) || '24.csv')"
_FILE_TICK = f"(CASE {_HASH} % 3 WHEN 0 THEN {I.TICK_SIZES['GC']} WHEN 1 THEN {I.TICK_SIZES['NQ']} ELSE {I.TICK_SIZES['VG']} END)"


def _placement(chain: str, tick: str) -> str:
    """The backtest over one model for each (contract, cutoff)."""
    return f"""WITH {chain}, {_LIVE},
            s1 AS (SELECT s.*, CASE WHEN signal > 0 THEN 'range_dn' ELSE 'range_up' END AS direction, l.close, round(l.volume_ewma, 9) AS a, round(l.volatility_ewma, 9) AS b, round(l.ewma_delta_x, 9) AS c
                   FROM sig s ASOF LEFT JOIN lv l ON s.contract = l.contract AND s.ts > l.time),
            s2 AS (SELECT s.*, CASE WHEN close IS NULL THEN 'no_prior_bar' WHEN d.status IS NULL THEN 'no_bars' ELSE d.status END AS st0, d.status,
                   CASE WHEN d.status = 'ok' THEN 1 + coalesce(a >= v1, false)::INT + coalesce(a >= v2, false)::INT END AS m, CASE WHEN d.status = 'ok' THEN 1 + coalesce(b >= s1, false)::INT + coalesce(b >= s2, false)::INT END AS n,
                   CASE WHEN d.status = 'ok' THEN 1 + coalesce(c >= d1, false)::INT END AS k FROM s1 s LEFT JOIN bounds d ON s.contract = d.contract AND s.cutoff = d.cutoff),
            pr AS (SELECT s.contract, s.event_id, l AS ell, coalesce(cum_prob, 0.0) AS p FROM s2 s, range(0, 10) t(l) LEFT JOIN cdf c ON c.contract = s.contract AND c.cutoff = s.cutoff AND c.m = s.m AND c.n = s.n AND c.k = s.k AND c.direction = s.direction AND c.ell = l),
            fl AS (SELECT contract, event_id, min(ell) FILTER (WHERE p < 0.6) AS f, list(p ORDER BY ell) AS ps FROM pr GROUP BY ALL)
            SELECT s.contract, s.event_id, signal, direction, m, n, k, CASE WHEN st0 = 'ok' THEN CAST(coalesce(f, 9) AS INT) END AS level, CASE WHEN st0 = 'ok' THEN CAST(CASE WHEN f IS NULL THEN 9 WHEN f = 0 THEN 0 ELSE f - 1 END AS INT) END AS accepted_level,
                   CASE WHEN st0 = 'ok' THEN round(CAST(CASE WHEN f IS NULL THEN ps[10] WHEN f = 0 THEN 0.0 ELSE ps[f] END AS DOUBLE), 6) END AS accepted_prob,
                   CASE WHEN st0 = 'ok' THEN round(CASE WHEN direction = 'range_dn' THEN close - coalesce(f, 9) * {tick} ELSE close + coalesce(f, 9) * {tick} END, 6) END AS opti_price, st0 AS status
            FROM s2 s JOIN fl ON s.contract = fl.contract AND s.event_id = fl.event_id"""


def _names() -> str:
    """Contract paths made of orders, as the query makes them."""
    symbols = "['ES', 'NQ', 'CL', 'HO', 'VG', 'S', '6E', 'XX', 'es', 'BP', 'JY', 'GC', 'foo', 'RX']"
    ticks = ", ".join(f"('{s}', {v!r}::DOUBLE)" for s, v in I.TICK_SIZES.items())
    markets = ", ".join(f"('{s}', '{v}')" for s, v in I.MARKETS.items())
    return f"""
nm0 AS (SELECT o_orderkey, {symbols}[o_orderkey % 14 + 1] AS name, ['F', 'H', 'M', 'U', 'Z', 'A'][(o_orderkey // 7) % 6 + 1] AS mon, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS yy FROM orders),
nm AS (SELECT o_orderkey, name, 'data/m/' || name || mon || yy || '.csv' AS path, name || mon || yy || '.csv' AS base FROM nm0),
parts AS (SELECT *, nullif(regexp_extract(base, '{I.CONTRACT}', 1), '') AS symbol, nullif(regexp_extract(base, '{I.CONTRACT}', 2), '') AS month_code, nullif(regexp_extract(base, '{I.CONTRACT}', 3), '') AS y FROM nm),
ticks(sym, tick_size) AS (VALUES {ticks}), markets(route_symbol, market) AS (VALUES {markets})"""


def oracle_sql() -> dict[str, str]:
    c, names, own = _chain(), _names(), _chain(tick=_TICK)
    ticks_of = f"""WITH {_BARS}, g AS (SELECT DISTINCT contract, 'o' AS s, open AS p FROM bars UNION SELECT contract, 'h', high FROM bars UNION SELECT contract, 'l', low FROM bars UNION SELECT contract, 'c', close FROM bars),
            d AS (SELECT contract, round(p - lag(p) OVER (PARTITION BY contract, s ORDER BY p), 9) AS step FROM g) SELECT contract, round(min(step), 6) AS tick_size FROM d WHERE step > 0 GROUP BY contract"""
    raw, sparse = _chain(method="raw"), _chain(tick=0.1)
    until = _chain(_UNTIL)
    live_until = _LIVE.replace("FROM bars WINDOW", "FROM bars WHERE time <= TIMESTAMP '2024-01-12 00:00:00' WINDOW")
    asked = "asked AS (SELECT DISTINCT contract, m, n, CAST(bar_seq % 3 + 1 AS INT) AS k, 'range_dn' AS direction, r % 400 + bar_seq % 20 - 5 AS ell FROM st)"
    level = """a2 AS (SELECT * FROM ls, (VALUES ('range_up'), ('range_dn')) d(direction)),
        pr AS (SELECT a.contract, a.time, a.direction, l AS ell, coalesce(cum_prob, 0.0) AS p FROM a2 a, range(0, 10) t(l) LEFT JOIN cdf c ON c.contract = a.contract AND c.m = a.m AND c.n = a.n AND c.k = a.k AND c.direction = a.direction AND c.ell = l),
        fl AS (SELECT contract, time, direction, min(ell) FILTER (WHERE p < 0.97) AS f, list(p ORDER BY ell) AS ps FROM pr GROUP BY ALL),
        pl AS (SELECT contract, time, direction, CAST(coalesce(f, 9) AS INT) AS level, CAST(CASE WHEN f IS NULL THEN 9 WHEN f = 0 THEN 0 ELSE f - 1 END AS INT) AS accepted_level,
                      CASE WHEN f IS NULL THEN ps[10] WHEN f = 0 THEN 0.0 ELSE ps[f] END AS accepted_prob FROM fl)"""
    report = """rep AS (SELECT t.contract, t.n_rows, coalesce(b.n_bars, 0) AS n_bars, b.j_s, h.o AS states_observed, h.p AS states_possible, true AS is_valid, true AS probe_ok, coalesce(b.status, 'no_bars') AS status
        FROM (SELECT contract, count(*) AS n_rows FROM bars GROUP BY ALL) t LEFT JOIN bounds b ON t.contract = b.contract
        LEFT JOIN (SELECT contract, count(*) AS o, CAST(18 AS BIGINT) AS p FROM (SELECT DISTINCT contract, m, n, k FROM used) GROUP BY ALL) h ON t.contract = h.contract)"""
    spoilt = f"""{_BARS}, m AS (SELECT *, (minute(time) + hour(time)) % 7 AS m FROM bars),
            f AS (SELECT 'm' AS market, contract || '.csv' AS contract, CASE m WHEN 1 THEN 'unparsable' WHEN 2 THEN 'missing_value' WHEN 3 THEN 'repeated_time' ELSE 'taken' END AS reason, volume FROM m
                  UNION ALL SELECT 'm', contract || '.csv', 'taken', 0.0 FROM m WHERE m = 3
                  UNION ALL SELECT 'short', contract || '.csv', 'missing_column', NULL FROM m UNION ALL SELECT 'short', contract || '.csv', 'missing_column', NULL FROM m WHERE m = 3)"""
    return {
        "load_bars": f"WITH {_BARS} SELECT contract, time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars",
        "discover_files": "SELECT event_type AS market, CAST(1 AS BIGINT) AS n_files FROM events GROUP BY event_type",
        "model_roundtrip": f"WITH {c} SELECT {_KEY}, round(cum_prob, 6) AS cum_prob FROM cdf",
        "tick_size_lookup": f"WITH {names} SELECT o_orderkey, name, tick_size FROM nm LEFT JOIN ticks ON upper(name) = sym",
        "parse_symbol": f"WITH {names} SELECT o_orderkey, path, symbol, tick_size, CASE WHEN symbol IS NULL THEN 'no_match' WHEN tick_size IS NULL THEN 'unknown_symbol' ELSE 'ok' END AS parse_status FROM parts LEFT JOIN ticks ON symbol = sym",
        "contract_details": f"WITH {names} SELECT o_orderkey, symbol, month_code, CASE WHEN month_code IS NOT NULL THEN CAST(strpos('{I.MONTH_CODES}', month_code) AS INT) END AS month, CAST(y AS INT) AS year, symbol || month_code || y AS contract_code, tick_size FROM parts LEFT JOIN ticks ON symbol = sym",
        "tick_override": f"WITH {names} SELECT o_orderkey, name, CASE upper(name) WHEN 'ES' THEN 0.5 WHEN 'XX' THEN 2.0 ELSE tick_size END AS tick_size FROM nm LEFT JOIN ticks ON upper(name) = sym",
        "signal_route": f"WITH {names} SELECT o_orderkey, base AS main_contract_clean, substr(base, 1, 2) AS route_symbol, market FROM nm LEFT JOIN markets ON substr(base, 1, 2) = route_symbol",
        "train_cutoff": f"WITH {_BARS} SELECT contract, count(*) AS n_all, nullif(count(*) FILTER (WHERE time <= TIMESTAMP '2024-01-12'), 0) AS n_kept, max(time) FILTER (WHERE time <= TIMESTAMP '2024-01-12') AS last_time FROM bars GROUP BY contract",
        "daily_completeness": f"WITH {c} SELECT contract, date, n_bars, round(expected, 6) AS expected, is_kept FROM daily",
        "sparse_days": f"WITH {c} SELECT contract, time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM kept",
        "gap_sessions": """WITH u AS (SELECT user_id AS contract, ts AS time FROM events GROUP BY ALL), g AS (SELECT *, CASE WHEN time - lag(time) OVER w <= INTERVAL 4 HOURS THEN 0 ELSE 1 END AS new FROM u WINDOW w AS (PARTITION BY contract ORDER BY time)),
            s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY contract ORDER BY time) AS INT) AS session_id FROM g) SELECT contract, session_id, count(*) AS n_rows, min(time) AS first_time, max(time) AS last_time FROM s GROUP BY ALL""",
        "tau_bars": f"WITH {c} SELECT contract, session_id, bar_idx, time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, CAST(completeness AS DOUBLE) AS completeness FROM tau",
        "tick_ranges": f"WITH {c} SELECT contract, time, bar_seq, r, r_up, r_dn FROM ranged",
        "range_quality": f"""WITH {c}, q AS (SELECT contract, CAST(sum(n_bars) AS BIGINT) AS n_rows, count(*) AS n_days, count(*) FILTER (WHERE NOT is_kept) AS n_sparse_days, CAST(sum(CASE WHEN is_kept THEN n_bars ELSE 0 END) AS BIGINT) AS n_kept_rows FROM daily GROUP BY contract),
            p AS (SELECT contract, count(*) AS n_bars, count(*) FILTER (WHERE abs(r - (r_up + r_dn)) > 1) AS n_discrepant FROM ranged GROUP BY contract) SELECT q.*, coalesce(n_bars, 0) AS n_bars, coalesce(n_discrepant, 0) AS n_discrepant FROM q LEFT JOIN p ON q.contract = p.contract""",
        "burn_in": f"WITH {c} SELECT contract, n_bars, CAST(j_s AS BIGINT) AS j_s FROM burn",
        "ewma_shifted": f"WITH {c} SELECT contract, bar_seq, round(v_raw, 6) AS v_ewma FROM ew",
        "ewm_std": f"""WITH {c}, d AS (SELECT contract, bar_seq, pow(lag(volume) OVER (PARTITION BY contract ORDER BY bar_seq) - v_raw, 2) AS d FROM ew)
            SELECT contract, bar_seq, round(CASE WHEN bar_seq = 0 THEN 0.0 ELSE sqrt(sum(coalesce(d, 0) * pow(2, bar_seq / 10.0)) OVER u * pow(2, -bar_seq / 10.0) / ((1 - pow(2, -bar_seq / 10.0)) / (1 - pow(2, -0.1)))) END, 6) AS v_std
            FROM d WINDOW u AS (PARTITION BY contract ORDER BY bar_seq)""",
        "ewma_features": f"WITH {c} SELECT contract, bar_seq, round(v_raw, 6) AS v_ewma, round(s_raw, 6) AS sigma_ewma, round(delta_x, 6) AS delta_x, round(d_raw, 6) AS delta_x_ewma FROM ew",
        "live_volume": f"WITH {c}, {_LIVE} SELECT contract, time, round(volume_ewma, 6) AS volume_ewma FROM lv",
        "live_volatility": f"WITH {c}, {_LIVE} SELECT contract, time, round(volatility_ewma, 6) AS volatility_ewma FROM lv",
        "live_delta": f"WITH {c}, {_LIVE} SELECT contract, time, round(ewma_delta_x, 6) AS ewma_delta_x FROM lv",
        "state_boundaries": f"WITH {c} SELECT contract, n_bars, j_s, round(v1, 6) AS v1, round(v2, 6) AS v2, round(s1, 6) AS s1, round(s2, 6) AS s2, round(d1, 6) AS d1, status FROM bounds",
        "assign_states": f"WITH {c} SELECT contract, bar_seq, m, n, k FROM st",
        "state_histogram": f"WITH {c}, h AS (SELECT contract, m, n, k, count(*) AS x FROM used GROUP BY ALL) SELECT contract, count(*) AS states_observed, CAST(18 AS BIGINT) AS states_possible, min(x) AS least_samples, max(x) AS most_samples FROM h GROUP BY contract",
        "range_frequency": f"WITH {c} SELECT {_KEY}, n_seen FROM freq",
        "pmf_raw": f"WITH {raw} SELECT {_KEY}, round(prob, 6) AS prob, CAST(round(base_prob, 6) AS DOUBLE) AS base_prob, num_bins FROM pmf",
        "pmf_smoothed": f"WITH {c} SELECT {_KEY}, round(prob, 6) AS prob, round(base_prob, 6) AS base_prob, num_bins FROM pmf",
        "pmf_smoothed_sparse": f"WITH {sparse} SELECT {_KEY}, round(prob, 6) AS prob, round(base_prob, 6) AS base_prob, num_bins FROM pmf",
        "reverse_cdf": f"WITH {c} SELECT {_KEY}, round(cum_prob, 6) AS cum_prob FROM cdf",
        "reverse_cdf_sparse": f"WITH {sparse} SELECT {_KEY}, round(cum_prob, 9) AS cum_prob FROM cdf",
        "state_statistics": f"WITH {c} SELECT contract, m, n, k, max(n_total) AS sample_count, max(ell) FILTER (WHERE direction = 'range') AS max_range, max(ell) FILTER (WHERE direction = 'range_up') AS max_range_up, max(ell) FILTER (WHERE direction = 'range_dn') AS max_range_dn FROM pmf GROUP BY contract, m, n, k",
        "validate_model": f"""WITH {c}, s AS (SELECT contract, m, n, k, direction, sum(prob) + greatest(any_value(num_bins) - count(*), 0) * any_value(base_prob) AS total FROM pmf GROUP BY contract, m, n, k, direction),
            t AS (SELECT contract, count(*) AS n_distributions, count(*) FILTER (WHERE abs(total - 1) > 1.1e-5) AS bad_sums FROM s GROUP BY contract),
            w AS (SELECT contract, cum_prob, lead(cum_prob) OVER (PARTITION BY contract, m, n, k, direction ORDER BY ell) AS nx FROM cdf), x AS (SELECT contract, count(*) FILTER (WHERE nx > cum_prob) AS bad_steps FROM w GROUP BY contract)
            SELECT t.*, bad_steps, bad_sums = 0 AND bad_steps = 0 AS is_valid FROM t JOIN x ON t.contract = x.contract""",
        "model_report": f"WITH {c}, {report} SELECT * FROM rep",
        "market_report": f"WITH {_chain(tau=4)}, {report} SELECT * FROM rep",
        "fit_models": f"""WITH {c}, h AS (SELECT contract, m, n, k, count(*) AS x FROM used GROUP BY ALL), g AS (SELECT contract, count(*) AS states_observed, min(x) AS least_samples, max(x) AS most_samples FROM h GROUP BY contract),
            f AS (SELECT contract, sum(cum_prob) AS fill_at_1 FROM cdf WHERE ell = 1 GROUP BY contract)
            SELECT b.contract, n_bars, j_s, status, states_observed, least_samples, most_samples, round(fill_at_1, 6) AS fill_at_1 FROM bounds b LEFT JOIN g ON b.contract = g.contract LEFT JOIN f ON b.contract = f.contract""",
        "fit_with_cutoff": f"WITH {_chain(_UNTIL)} SELECT {_KEY}, round(cum_prob, 6) AS cum_prob FROM cdf",
        "live_states": f"WITH {c}, {_LIVE} SELECT contract, time, m, n, k FROM ls",
        "query_pdf": f"""WITH {c}, {asked} SELECT a.*, round(CAST(coalesce(p.prob, CASE WHEN a.ell >= 0 AND a.ell <= t.max_ell + 10 THEN t.base_prob END, 0.0) AS DOUBLE), 6) AS prob, 'ok' AS query_status FROM asked a
            LEFT JOIN (SELECT contract, m, n, k, direction, max_ell, base_prob FROM tot) t USING (contract, m, n, k, direction) LEFT JOIN (SELECT {_KEY}, prob FROM pmf) p USING ({_KEY})""",
        "query_cdf": f"WITH {c}, {asked} SELECT a.*, round(CAST(coalesce(cum_prob, 0.0) AS DOUBLE), 6) AS cum_prob, 'ok' AS query_status FROM asked a LEFT JOIN (SELECT {_KEY}, cum_prob FROM cdf) p USING ({_KEY})",
        "query_cdf_sparse": f"""WITH {_chain(tick=0.0001)}, asked AS (SELECT DISTINCT contract, m, n, CAST(bar_seq % 3 + 1 AS INT) AS k, 'range_dn' AS direction, r_dn + (bar_seq % 5 - 2) * 5000 AS ell FROM st)
            SELECT a.*, 'ok' AS query_status, round(CAST(coalesce(CASE WHEN a.ell BETWEEN 0 AND t.max_ell THEN ((SELECT count(*) FROM used u WHERE u.contract = a.contract AND u.m = a.m AND u.n = a.n AND u.k = a.k AND u.r_dn >= a.ell)
                   + 0.5 * (t.max_ell - a.ell + 1)) / t.denominator END, 0.0) AS DOUBLE), 5) AS cum_prob FROM asked a LEFT JOIN (SELECT contract, m, n, k, direction, max_ell, denominator FROM tot) t USING (contract, m, n, k, direction)""",
        "bad_directions": f"""WITH {c}, a AS (SELECT DISTINCT contract, m, n, k, d AS direction, CAST(2 AS BIGINT) AS ell FROM tot, (VALUES ('range'), ('range_up'), ('range_dn'), ('sideways')) v(d))
            SELECT a.*, CASE WHEN a.direction <> 'sideways' THEN round(CAST(coalesce(p.prob, CASE WHEN a.ell <= t.max_ell + 10 THEN t.base_prob END, 0.0) AS DOUBLE), 6) END AS prob, CASE WHEN a.direction <> 'sideways' THEN 'ok' ELSE 'bad_direction' END AS pdf_status,
                   CASE WHEN a.direction IN ('range_up', 'range_dn') THEN round(CAST(coalesce(cum_prob, 0.0) AS DOUBLE), 6) END AS cum_prob, CASE WHEN a.direction IN ('range_up', 'range_dn') THEN 'ok' ELSE 'bad_direction' END AS cdf_status
            FROM a LEFT JOIN (SELECT contract, m, n, k, direction, max_ell, base_prob FROM tot) t USING (contract, m, n, k, direction) LEFT JOIN (SELECT {_KEY}, prob FROM pmf) p USING ({_KEY}) LEFT JOIN (SELECT {_KEY}, cum_prob FROM cdf) q USING ({_KEY})""",
        "model_issues": f"""WITH {c}, p2 AS (SELECT contract, m, n, k, direction, prob + CASE WHEN (m + n + k) % 3 = 0 AND ell = 1 THEN 0.25 ELSE 0 END AS prob, num_bins, base_prob FROM pmf),
            s AS (SELECT contract, m, n, k, direction, sum(prob) + greatest(any_value(num_bins) - count(*), 0) * any_value(base_prob) AS total FROM p2 GROUP BY contract, m, n, k, direction),
            c2 AS (SELECT contract, m, n, k, direction, ell, cum_prob + CASE WHEN (m + n + k) % 3 = 0 AND ell = 2 THEN 0.5 ELSE 0 END AS cum_prob FROM cdf),
            w AS (SELECT *, lead(cum_prob) OVER (PARTITION BY contract, m, n, k, direction ORDER BY ell) AS nx FROM c2)
            SELECT contract, m, n, k, direction, 'bad_sum' AS issue, CAST(NULL AS BIGINT) AS ell, round(CAST(total AS DOUBLE), 6) AS value FROM s WHERE abs(total - 1) > 1.1e-5
            UNION ALL SELECT contract, m, n, k, direction, 'bad_step', ell, round(CAST(nx - cum_prob AS DOUBLE), 6) FROM w WHERE nx > cum_prob""",
        "answer_at_cutoff": f"""WITH {until}, {live_until}, now AS (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY contract ORDER BY time DESC) = 1),
            a AS (SELECT contract, m, n, k, d AS direction, l AS ell FROM now, (VALUES ('range_up'), ('range_dn')) v(d), range(0, 10) t(l)),
            n AS (SELECT contract, m, n, k, max(n_total) AS sample_count FROM tot GROUP BY ALL)
            SELECT a.*, coalesce(sample_count, 0) AS sample_count, round(CAST(coalesce(cum_prob, 0.0) AS DOUBLE), 6) AS cum_prob FROM a JOIN (SELECT contract FROM bounds WHERE status = 'ok') b USING (contract)
            LEFT JOIN n USING (contract, m, n, k) LEFT JOIN (SELECT {_KEY}, cum_prob FROM cdf) q USING ({_KEY})""",
        "full_distribution": f"""WITH {c}, {_LIVE}, now AS (SELECT contract, m, n, k FROM ls QUALIFY row_number() OVER (PARTITION BY contract ORDER BY time DESC) = 1)
            SELECT contract, m, n, k, direction, ell, round(prob, 6) AS prob FROM pmf SEMI JOIN now USING (contract, m, n, k)""",
        "compare_methods": f"""WITH {_chain(alpha=1.0)}, a AS (SELECT *, unnest(range(0, 10)) AS ell FROM (SELECT DISTINCT contract, m, n, k, direction FROM freq))
            SELECT a.contract, a.m, a.n, a.k, a.direction, a.ell, round(CAST(coalesce(f.n_seen / t.n_total, 0.0) AS DOUBLE), 6) AS raw_prob,
                   round(CAST(coalesce(p.prob, CASE WHEN a.ell <= t.max_ell + 10 THEN t.base_prob END, 0.0) AS DOUBLE), 6) AS smoothed_prob
            FROM a JOIN (SELECT * EXCLUDE (cutoff) FROM tot) t USING (contract, m, n, k, direction) LEFT JOIN (SELECT * EXCLUDE (cutoff) FROM freq) f USING ({_KEY}) LEFT JOIN (SELECT {_KEY}, prob FROM pmf) p USING ({_KEY})""",
        "top_levels": f"""WITH {c}, r AS (SELECT {_KEY}, prob, row_number() OVER (PARTITION BY contract, m, n, k, direction ORDER BY ell) AS rk FROM pmf WHERE direction <> 'range')
            SELECT r.* EXCLUDE (rk, prob), round(prob, 6) AS prob, round(cum_prob, 6) AS cum_prob FROM r LEFT JOIN (SELECT {_KEY}, cum_prob FROM cdf) c USING ({_KEY}) WHERE rk <= 10""",
        "inventory_signals": f"WITH {_BARS} SELECT contract AS market, event_id, inventory, signal FROM sig",
        "infer_tick": ticks_of,
        "folder_ticks": f"SELECT contract AS market, tick_size FROM ({ticks_of})",
        "asof_prior_bar": f"WITH {_BARS} SELECT s.contract, event_id, b.time AS bar_time, round(b.close, 6) AS close FROM sig s ASOF LEFT JOIN bars b ON s.contract = b.contract AND s.ts > b.time",
        "cutoff_training_sets": f"WITH {_BARS}, t AS ({_EACH}) SELECT contract, cutoff, count(*) AS n_rows, max(time) AS last_time FROM t GROUP BY contract, cutoff",
        "placement_level": f"WITH {c}, {_LIVE}, {level} SELECT contract, time, direction, level, accepted_level, round(CAST(accepted_prob AS DOUBLE), 6) AS accepted_prob FROM pl",
        "placement_price": f"WITH {c}, {_LIVE}, {level} SELECT pl.contract, pl.time, direction, round(CASE WHEN direction = 'range_dn' THEN close - level * 0.25 ELSE close + level * 0.25 END, 6) AS opti_price FROM pl JOIN bars b ON pl.contract = b.contract AND pl.time = b.time",
        "placement_backtest": _placement(_chain(_EACH), "1"),
        "placement_by_symbol": f"SELECT contract, event_id, direction, m, n, k, level, accepted_prob, opti_price, status FROM ({_placement(_chain(_EACH, tick=_TICK), _TICK.replace('contract', 's.contract'))})",
        "fit_by_symbol": f"""WITH {own}, h AS (SELECT contract, count(*) AS states_observed FROM (SELECT DISTINCT contract, m, n, k FROM used) GROUP BY contract),
            p AS (SELECT contract, max(ell) AS max_ell, sum(prob) AS total FROM pmf GROUP BY contract)
            SELECT b.contract, n_bars, j_s, status, states_observed, max_ell, round(total, 6) AS total FROM bounds b LEFT JOIN h ON b.contract = h.contract LEFT JOIN p ON b.contract = p.contract""",
        "report_by_symbol": f"WITH {own}, {report} SELECT * FROM rep",
        "read_bar_files": f"WITH {_BARS} SELECT contract AS market, contract || '.csv' AS contract, time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars",
        "folder_placements": f"""SELECT event_id, {_FILE} AS main_contract_clean, signal, direction, level, opti_price, status FROM ({_placement(_chain(_EACH, tick=_FILE_TICK), _FILE_TICK.replace('contract', 's.contract'))})""",
        "rejected_rows": f"WITH {spoilt} SELECT market, contract, reason, count(*) AS n_rows, round(coalesce(sum(volume), 0.0), 6) AS volume FROM f GROUP BY market, contract, reason",
        "file_status": f"""WITH {spoilt}, g AS (SELECT market, contract, count(*) AS n_rows, count(*) FILTER (WHERE reason = 'taken') AS n_bars FROM f GROUP BY market, contract)
            SELECT *, n_rows - n_bars AS n_rejects, CASE WHEN market = 'short' THEN 'missing_column' WHEN n_rows > n_bars THEN 'some_rejected' ELSE 'ok' END AS status FROM g""",
        "two_runs": f"WITH {_BARS} SELECT contract AS market, contract || '.csv' AS contract, count(*) AS n_rows, round(sum(volume), 6) AS volume, min(time) AS first_time, max(time) AS last_time FROM bars GROUP BY ALL",
        "model_of_one_symbol": f"WITH {c} SELECT {_KEY}, round(cum_prob, 6) AS cum_prob, n_bars, j_s FROM cdf JOIN (SELECT contract, n_bars, j_s FROM bounds) b USING (contract) WHERE ell <= 9 AND contract = (SELECT min(event_type) FROM events)",
        "folder_signals": f"WITH {_BARS} SELECT 'AIAgent_' || contract || '.csv' AS filename, event_id, contract || '.csv' AS main_contract_clean, inventory, signal FROM sig",
        "stream_score": f"""WITH {c}, {_LIVE} SELECT l.contract, time, l.m, l.n, l.k, t.n_total IS NOT NULL AS state_exists, coalesce(t.n_total, 0) AS sample_count, max_range, max_range_up, max_range_dn, round(CAST(coalesce(cum_prob, 0.0) AS DOUBLE), 6) AS cum_prob, CAST(1 AS INT) AS model_version FROM ls l
            LEFT JOIN (SELECT contract, m, n, k, max(n_total) AS n_total, max(ell) FILTER (WHERE direction = 'range') AS max_range, max(ell) FILTER (WHERE direction = 'range_up') AS max_range_up, max(ell) FILTER (WHERE direction = 'range_dn') AS max_range_dn FROM pmf GROUP BY contract, m, n, k) t USING (contract, m, n, k) LEFT JOIN (SELECT contract, m, n, k, cum_prob FROM cdf WHERE direction = 'range_up' AND ell = 1) c USING (contract, m, n, k)""",
    }
