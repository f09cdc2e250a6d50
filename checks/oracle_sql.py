"""The catalog queries in plain SQL, written independently of the Spark plans.

Labels are found by joining every entry with every later bar, exponential averages by recursion
and the day-trade cap by walking the events one at a time, so agreement is not by construction.
"""

from __future__ import annotations

import math


def r6(x: str) -> str:
    """Six digits; the shift keeps halves of the sixth digit from hanging on last bits."""
    return f"CASE WHEN round({x} + 3.7e-9, 6) = 0 THEN 0.0 ELSE round({x} + 3.7e-9, 6) END"


def pick(keys: str, doubles: list[str] | str, source: str, tail: str = "") -> str:
    """SELECT keys and rounded doubles FROM source."""
    names = doubles.split() if isinstance(doubles, str) else doubles
    cols = [k for k in [keys] if k] + [f"{r6(n)} AS {n}" for n in names]
    return f"SELECT {', '.join(cols)} FROM {source} {tail}"


SECONDS = 300
WARMUP = 35

CTE: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: str, sql: str) -> None:
    CTE[name] = (needs.split(), sql)


def bars_from(seconds: int, symbol: str = "event_type") -> str:
    return f"""
    SELECT {symbol} AS symbol,
           make_timestamp((epoch_us(ts) // {seconds * 1_000_000}) * {seconds * 1_000_000}) AS ts,
           first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
           last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
    FROM events GROUP BY 1, 2"""


def positions(src: str) -> str:
    return f"""
    SELECT *, CAST(ts AS DATE) AS session_date,
           row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos,
           count(*) OVER (PARTITION BY symbol) AS n_bars,
           dense_rank() OVER (PARTITION BY symbol ORDER BY CAST(ts AS DATE)) - 1 AS day_rank
    FROM {src}"""


def daily(src: str) -> str:
    return f"""
    SELECT symbol, session_date, arg_max(close, ts) AS close, count(*) AS session_bars
    FROM {src} GROUP BY 1, 2"""


def daily_vol(src: str, n: int = 5) -> str:
    return f"""
    SELECT *, sigma_daily_5d * {math.sqrt(252.0)!r} AS vol_5d_ann FROM (
      SELECT *, CASE WHEN count(log_ret) OVER w = {n} THEN stddev_samp(log_ret) OVER w END AS sigma_daily_5d
      FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY session_date)) AS log_ret FROM {src})
      WINDOW w AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))"""


def labels(bars: str, vol: str, ref_stat: str, stride: int, horizon: int) -> str:
    """Brute force: the earliest later bar inside the horizon that reaches a barrier."""
    return f"""
    SELECT e.*, CASE WHEN t.pos IS NOT NULL AND x.low <= e.lower_barrier THEN 'stop_loss'
                WHEN t.pos IS NOT NULL THEN 'take_profit'
                WHEN v.pos IS NOT NULL THEN 'vertical' ELSE 'end_of_data' END AS barrier_outcome,
           coalesce(t.pos, v.pos, e.n_bars - 1) - e.entry_pos AS bars_forward
    FROM (
      SELECT *, entry_close * (1.0 + tp_move_effective) AS upper_barrier,
             entry_close * (1.0 - sl_move) AS lower_barrier
      FROM (
        SELECT *, greatest(0.02, vol_scale_ratio * 1.0) AS tp_move_effective, vol_scale_ratio * 0.9 AS sl_move
        FROM (
          SELECT b.symbol, b.ts AS entry_time, b.session_date, b.pos AS entry_pos, b.close AS entry_close,
                 b.n_bars, b.day_rank, d.vol_5d_ann AS sigma_ann_at_entry, r.sigma_ref,
                 greatest(0.25, least(4.0, d.vol_5d_ann / r.sigma_ref)) AS vol_scale_ratio
          FROM {bars} b JOIN {vol} d USING (symbol, session_date)
          JOIN (SELECT b2.symbol, {ref_stat}(d2.vol_5d_ann) AS sigma_ref FROM {bars} b2
                JOIN {vol} d2 USING (symbol, session_date) GROUP BY 1) r USING (symbol)
          WHERE b.pos % {stride} = 0 AND b.pos < b.n_bars - 1 AND d.vol_5d_ann IS NOT NULL))) e
    LEFT JOIN LATERAL (
      SELECT min(f.pos) AS pos FROM {bars} f
      WHERE f.symbol = e.symbol AND f.pos > e.entry_pos AND f.day_rank < e.day_rank + {horizon}
        AND (f.low <= e.lower_barrier OR f.high >= e.upper_barrier)) t ON TRUE
    LEFT JOIN {bars} x ON x.symbol = e.symbol AND x.pos = t.pos
    LEFT JOIN LATERAL (
      SELECT min(f.pos) AS pos FROM {bars} f
      WHERE f.symbol = e.symbol AND f.day_rank >= e.day_rank + {horizon}) v ON TRUE"""


cte("raw", "", bars_from(SECONDS))
cte("b", "raw", positions("raw"))
cte("daily", "b", daily("b"))
cte("dvol", "daily", daily_vol("daily"))
cte("bv", "b dvol", "SELECT b.symbol, b.ts, d.sigma_daily_5d, d.vol_5d_ann FROM b LEFT JOIN dvol d USING (symbol, session_date)")
cte("lab", "b dvol", labels("b", "dvol", "median", 2, 2))
cte("raw_h", "", bars_from(3600))
cte("b_h", "raw_h", positions("raw_h"))
cte("daily_h", "b_h", daily("b_h"))
cte("dvol_h", "daily_h", daily_vol("daily_h"))
cte("lab_h", "b_h dvol_h", labels("b_h", "dvol_h", "avg", 1, 1))
cte(
    "pred", "lab",
    """
    SELECT *, CASE WHEN proba_stop_loss >= proba_take_profit AND proba_stop_loss >= proba_vertical THEN 'stop_loss'
              WHEN proba_take_profit >= proba_vertical THEN 'take_profit' ELSE 'vertical' END AS y_pred,
           greatest(proba_stop_loss, proba_take_profit, proba_vertical) AS max_proba
    FROM (SELECT *, barrier_outcome AS y_true,
                 CASE WHEN session_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-22' THEN 'train' ELSE 'val' END AS split,
                 CAST(entry_pos * 53 % 97 + 1 AS DOUBLE) / (entry_pos * 53 % 97 + entry_pos * 37 % 101 + entry_pos * 29 % 89 + 3) AS proba_stop_loss,
                 CAST(entry_pos * 37 % 101 + 1 AS DOUBLE) / (entry_pos * 53 % 97 + entry_pos * 37 % 101 + entry_pos * 29 % 89 + 3) AS proba_take_profit,
                 CAST(entry_pos * 29 % 89 + 1 AS DOUBLE) / (entry_pos * 53 % 97 + entry_pos * 37 % 101 + entry_pos * 29 % 89 + 3) AS proba_vertical,
                 CAST(entry_pos * 41 % 83 + 1 AS DOUBLE) / 83.0 AS meta_proba
          FROM lab)
    WHERE session_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-31'""",
)
cte("val", "pred", "SELECT * FROM pred WHERE split = 'val'")

# Trade facts: every labelled prediction valued.
cte(
    "facts", "val b",
    """
    SELECT p.*, timed AND x.close IS NULL AS missing_exit,
           CASE WHEN y_true = 'take_profit' THEN tp_move_effective WHEN y_true = 'stop_loss' THEN -sl_move
                ELSE x.close / entry_close - 1.0 END AS pnl,
           CASE WHEN timed THEN x.session_date ELSE p.session_date END AS exit_session_date
    FROM (SELECT *, y_true IN ('vertical', 'end_of_data') AS timed FROM val) p
    LEFT JOIN b x ON x.symbol = p.symbol AND x.pos = p.entry_pos + p.bars_forward""",
)


def bd(d: str) -> str:
    """Weekday number of a date; weekends share Friday's."""
    days = f"date_diff('day', DATE '1970-01-05', {d})"
    return f"(({days} // 7) * 5 + least({days} % 7, 4))"


def greedy(signals: str, key: str, cap: int, window: int, order: str = "entry_time") -> str:
    """Walk the candidates of each group in time order, remembering accepted weekday numbers.

    `signals` yields {key}, entry_time, session_date, candidate and payload columns.
    """
    return f"""
    ordered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i FROM ({signals})),
    walk AS (
      SELECT {key}, i, candidate AND FALSE AS over_cap,
             CASE WHEN candidate AND isodow(session_date) < 6 THEN [{bd('session_date')}] ELSE CAST([] AS BIGINT[]) END AS held,
             session_date AS at
      FROM ordered WHERE i = 1
      UNION ALL
      SELECT {', '.join(f'o.{k.strip()}' for k in key.split(','))}, o.i,
             o.candidate AND len(list_filter(w.held, lambda h: h > {bd('o.session_date')} - {window})) >= {cap},
             CASE WHEN o.candidate AND isodow(o.session_date) < 6
                       AND len(list_filter(w.held, lambda h: h > {bd('o.session_date')} - {window})) < {cap}
                  THEN list_append(list_filter(w.held, lambda h: h > {bd('o.session_date')} - {window}), {bd('o.session_date')})
                  ELSE list_filter(w.held, lambda h: h > {bd('o.session_date')} - {window}) END,
             o.session_date
      FROM walk w JOIN ordered o ON {' AND '.join(f'o.{k.strip()} = w.{k.strip()}' for k in key.split(','))} AND o.i = w.i + 1),
    decided AS (SELECT o.*, w.over_cap FROM ordered o JOIN walk w USING ({key}, i))"""


def trade_ctes(signals: str, key: str) -> str:
    payload = f"""SELECT {key}, entry_time, session_date, y_true, y_pred, proba_take_profit, missing_exit, pnl,
        exit_session_date, NOT missing_exit AND exit_session_date = session_date AS candidate FROM ({signals})"""
    return greedy(payload, key, 3, 5) + f""",
    trades AS (
      SELECT {key}, entry_time, session_date, y_true, y_pred, proba_take_profit,
             NOT missing_exit AND NOT over_cap AS taken,
             CASE WHEN missing_exit THEN 'missing_ohlcv_exit' WHEN over_cap THEN 'day_trade_cap' END AS blocked_reason,
             CASE WHEN NOT missing_exit AND NOT over_cap THEN pnl END AS pnl_fraction,
             CASE WHEN NOT missing_exit THEN exit_session_date END AS exit_session_date
      FROM decided)"""


def summary_sql(signals: str, key: str, groups: str) -> str:
    """Trade summary per group; `groups` lists every group that must appear."""
    mix = ", ".join(
        f"count(*) FILTER (WHERE taken AND y_true = '{o}') AS n_taken_{o}"
        for o in ("take_profit", "stop_loss", "vertical", "end_of_data")
    )
    return trade_ctes(signals, key) + f""",
    curve AS (SELECT {key}, entry_time, sum(pnl_fraction) OVER (PARTITION BY {key} ORDER BY entry_time ROWS UNBOUNDED PRECEDING) AS cum
              FROM trades WHERE taken),
    dd AS (SELECT {key}, min(cum - peak) AS max_dd FROM (
             SELECT *, max(cum) OVER (PARTITION BY {key} ORDER BY entry_time ROWS UNBOUNDED PRECEDING) AS peak FROM curve) GROUP BY {key}),
    eco AS (SELECT {key}, count(*) AS n_signals, count(*) FILTER (WHERE taken) AS n_trades_taken,
                   count(*) FILTER (WHERE blocked_reason = 'day_trade_cap') AS n_trades_blocked_day_trade_cap,
                   count(*) FILTER (WHERE blocked_reason = 'missing_ohlcv_exit') AS n_trades_skipped_missing_label,
                   count(*) FILTER (WHERE y_true = 'take_profit') AS n_signal_take_profit, {mix},
                   sum(pnl_fraction) AS gross FROM trades GROUP BY {key}),
    tot AS (SELECT symbol, count(*) AS n_predictions, count(*) FILTER (WHERE y_true = 'take_profit') AS n_tp FROM val GROUP BY 1),
    summary AS (
      SELECT {', '.join(f'g.{k.strip()}' for k in key.split(','))}, n_predictions,
             coalesce(n_signals, 0) AS n_signals, coalesce(n_trades_taken, 0) AS n_trades_taken,
             coalesce(n_trades_blocked_day_trade_cap, 0) AS n_trades_blocked_day_trade_cap,
             coalesce(n_trades_skipped_missing_label, 0) AS n_trades_skipped_missing_label,
             coalesce(n_signal_take_profit, 0) AS n_signal_take_profit,
             coalesce(n_taken_take_profit, 0) AS n_taken_take_profit, coalesce(n_taken_stop_loss, 0) AS n_taken_stop_loss,
             coalesce(n_taken_vertical, 0) AS n_taken_vertical, coalesce(n_taken_end_of_data, 0) AS n_taken_end_of_data,
             coalesce(n_taken_take_profit / nullif(n_trades_taken, 0), 0.0) AS hit_rate_take_profit_on_taken,
             coalesce(gross, 0.0) AS gross_return_sum, coalesce(gross / nullif(n_trades_taken, 0), 0.0) AS gross_return_mean,
             coalesce(max_dd, 0.0) AS max_drawdown_cumulative_sum,
             coalesce(n_signal_take_profit / nullif(n_signals, 0), 0.0) AS precision_take_profit,
             coalesce(n_signal_take_profit / nullif(n_tp, 0), 0.0) AS recall_take_profit
      FROM ({groups}) g JOIN tot USING (symbol) LEFT JOIN eco USING ({key}) LEFT JOIN dd USING ({key}))"""


SUMMARY_COUNTS = (
    "n_predictions, n_signals, n_trades_taken, n_trades_blocked_day_trade_cap, n_trades_skipped_missing_label, "
    "n_signal_take_profit, n_taken_take_profit, n_taken_stop_loss, n_taken_vertical, n_taken_end_of_data"
)
SUMMARY_DOUBLES = (
    "hit_rate_take_profit_on_taken gross_return_sum gross_return_mean max_drawdown_cumulative_sum "
    "precision_take_profit recall_take_profit"
)
GRID_VALUES = ", ".join(repr(round(0.05 * i, 4)) for i in range(1, 20))
SWEEP_SIGNALS = f"SELECT f.*, t.threshold FROM facts f JOIN (SELECT unnest([{GRID_VALUES}]) AS threshold) t ON f.proba_take_profit >= t.threshold"
SWEEP_GROUPS = f"SELECT symbol, threshold FROM (SELECT DISTINCT symbol FROM val) CROSS JOIN (SELECT unnest([{GRID_VALUES}]) AS threshold)"
SWEEP = summary_sql(SWEEP_SIGNALS, "symbol, threshold", SWEEP_GROUPS)
POLICIES = ("argmax_take_profit", "proba_threshold_take_profit", "meta_label")
POLICY_SIGNALS = (
    "SELECT *, 'argmax_take_profit' AS policy FROM facts WHERE y_pred = 'take_profit' UNION ALL "
    "SELECT *, 'proba_threshold_take_profit' FROM facts WHERE proba_take_profit >= 0.35 UNION ALL "
    "SELECT *, 'meta_label' FROM facts WHERE proba_take_profit >= 0.35 AND meta_proba >= 0.5"
)
POLICY_GROUPS = f"SELECT symbol, policy FROM (SELECT DISTINCT symbol FROM val) CROSS JOIN (SELECT unnest([{', '.join(repr(p) for p in POLICIES)}]) AS policy)"

# Feature columns on all bars.
RET = "ln(close / lag(close) OVER o)"
cte(
    "fbase", "b",
    f"""
    SELECT *, lag(close, 5) OVER o AS c5, lag(close, 15) OVER o AS c15, {RET} AS ret,
           power(ln(high / greatest(low, 1e-12)), 2) / (4.0 * ln(2.0)) AS park,
           greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS tr,
           power(ln(high / greatest(low, 1e-12)), 2) AS sq,
           lag(high) OVER o AS ph, lag(low) OVER o AS pl,
           greatest(close - lag(close) OVER o, 0.0) AS gain, greatest(lag(close) OVER o - close, 0.0) AS loss,
           min(ts) OVER s AS open_ts, max(ts) OVER s AS end_ts,
           sum((high + low + close) / 3.0 * volume) OVER so AS cpv, sum(volume) OVER so AS cv
    FROM b
    WINDOW o AS (PARTITION BY symbol ORDER BY pos), s AS (PARTITION BY symbol, session_date),
           so AS (PARTITION BY symbol, session_date ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
)
cte(
    "fbase2", "fbase",
    """
    SELECT *, lag(ret) OVER o AS lret, ret * lag(ret) OVER o AS rl, sq + lag(sq) OVER o AS sq2,
           CASE WHEN ph IS NOT NULL THEN power(ln(greatest(high, ph) / greatest(least(low, pl), 1e-12)), 2) END AS gamma,
           abs(ret) / nullif(close * volume, 0.0) AS ill
    FROM fbase WINDOW o AS (PARTITION BY symbol ORDER BY pos)""",
)


def fr(agg: str, x: str, n: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END"


cte(
    "fframe", "fbase2",
    f"""
    SELECT *, {fr('stddev_samp', 'ret', 10)} AS rv10, {fr('stddev_samp', 'ret', 30)} AS rv30,
           {fr('avg', 'park', 10)} AS park10, {fr('avg', 'tr', 10)} AS atr10, {fr('median', 'volume', 12)} AS med12,
           {fr('median', 'volume', 10)} AS med10, {fr('avg', 'sq2', 10)} AS beta, {fr('avg', 'ret', 10)} AS mr,
           {fr('avg', 'lret', 10)} AS ml, {fr('avg', 'rl', 10)} AS mrl, {fr('avg', 'ill', 10)} AS ill10
    FROM fbase2""",
)
CSK = repr(3.0 - 2.0 * math.sqrt(2.0))
cte(
    "fcs", "fframe",
    f"SELECT *, exp(greatest((sqrt(2.0 * beta) - sqrt(greatest(beta, 0.0))) / {CSK} - sqrt(greatest(gamma / {CSK}, 0.0)), 0.0)) AS ea FROM fframe",
)
cte(
    "flong", "fbase2",
    f"""
    SELECT *, exp(greatest((sqrt(2.0 * beta) - sqrt(greatest(beta, 0.0))) / {CSK} - sqrt(greatest(gamma / {CSK}, 0.0)), 0.0)) AS ea2,
           rv_30m / greatest(rv_120m, 1e-12) + 0 * rv_120m AS rv_ratio_30_120m, sqrt(park60) AS parkinson_60m,
           atr60 / greatest(close, 1e-12) AS atr_norm_60m, 2.0 * (ea2 - 1.0) / (1.0 + ea2) + 0 * beta AS corwin_schultz_spread,
           2.0 * sqrt(greatest(-(mrl - mr * ml), 0.0)) + 0 * mrl AS roll_implied_spread,
           (close - open) / greatest(high - low, 1e-12) * (volume / greatest(med50, 1e-12) + 0 * med50) AS signed_volume_proxy,
           (high - greatest(open, close)) / greatest(high - low, 1e-12) AS upper_wick_pct,
           (least(open, close) - low) / greatest(high - low, 1e-12) AS lower_wick_pct
    FROM (SELECT *, {fr('stddev_samp', 'ret', 30)} AS rv_30m, {fr('stddev_samp', 'ret', 120)} AS rv_120m,
                 {fr('avg', 'park', 60)} AS park60, {fr('avg', 'tr', 60)} AS atr60, {fr('median', 'volume', 50)} AS med50,
                 {fr('avg', 'sq2', 50)} AS beta, {fr('avg', 'ret', 50)} AS mr, {fr('avg', 'lret', 50)} AS ml,
                 {fr('avg', 'rl', 50)} AS mrl, {fr('avg', 'ill', 40)} AS amihud_illiq
          FROM fbase2)""",
)
LONG = (
    "rv_30m rv_120m rv_ratio_30_120m parkinson_60m atr_norm_60m corwin_schultz_spread roll_implied_spread amihud_illiq "
    "signed_volume_proxy upper_wick_pct lower_wick_pct"
)
TWO_PI = repr(2.0 * math.pi)
PHASE = f"(epoch_us(ts) - epoch_us(open_ts)) / 60e6 / greatest((epoch_us(end_ts) - epoch_us(open_ts)) / 60e6, 1.0) * {TWO_PI}"
cte(
    "fbar", "fcs",
    f"""
    SELECT symbol, ts, session_date, pos,
           ln(greatest(close, 1e-12)) AS log_entry_close, (high - low) / greatest(close, 1e-12) AS intraday_range_pct,
           ln(1.0 + greatest(volume, 0.0)) AS log1p_volume,
           ln(close / c5) AS ret_5m, ln(close / c15) AS ret_15m,
           rv10 AS rv_10m, rv30 AS rv_30m, rv10 / greatest(rv30, 1e-12) + 0 * rv30 AS rv_ratio_10_30m,
           sqrt(park10) AS parkinson_10m, atr10 / greatest(close, 1e-12) AS atr_norm_10m,
           (epoch_us(ts) - epoch_us(open_ts)) / 60e6 AS minutes_since_open, (epoch_us(end_ts) - epoch_us(ts)) / 60e6 AS minutes_to_close,
           sin({PHASE}) AS sin_time, cos({PHASE}) AS cos_time,
           sin((isodow(session_date) - 1) / 5.0 * {TWO_PI}) AS sin_dow, cos((isodow(session_date) - 1) / 5.0 * {TWO_PI}) AS cos_dow,
           volume / greatest(med12, 1e-12) + 0 * med12 AS rel_volume, ln(greatest(volume / greatest(med12, 1e-12) + 0 * med12, 1e-12)) + 0 * med12 AS log_rel_volume,
           (close - cpv / greatest(cv, 1e-12)) / greatest(cpv / greatest(cv, 1e-12), 1e-12) AS vwap_session_dist_pct,
           (close - low) / greatest(high - low, 1e-12) AS close_loc_value, (close - open) / greatest(close, 1e-12) AS bar_body_pct,
           2.0 * (ea - 1.0) / (1.0 + ea) + 0 * beta AS corwin_schultz_spread,
           2.0 * sqrt(greatest(-(mrl - mr * ml), 0.0)) + 0 * mrl AS roll_implied_spread, ill10 AS amihud_illiq,
           (close - open) / greatest(high - low, 1e-12) * (volume / greatest(med10, 1e-12) + 0 * med10) AS signed_volume_proxy,
           (high - greatest(open, close)) / greatest(high - low, 1e-12) AS upper_wick_pct,
           (least(open, close) - low) / greatest(high - low, 1e-12) AS lower_wick_pct
    FROM fcs""",
)


def ema_walk(name: str, src: str, start: int, values: dict[str, tuple[str, float]]) -> str:
    """Recursive averages of several columns from position `start`: {out: (column, alpha)}."""
    first = ", ".join(f"{x} AS {o}" for o, (x, _) in values.items())
    step = ", ".join(f"{1 - a!r} * w.{o} + {a!r} * s.{x}" for o, (x, a) in values.items())
    return f"""
    {name} AS (
      SELECT symbol, pos, {first} FROM {src} WHERE pos = {start}
      UNION ALL
      SELECT s.symbol, s.pos, {step} FROM {name} w JOIN {src} s ON s.symbol = w.symbol AND s.pos = w.pos + 1)"""


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


EMA_CTES = (
    ema_walk("ewalk", "fbase", 0, {f"e{n}": ("close", span(n)) for n in (9, 12, 21, 26)})
    + ","
    + ema_walk("mwalk", "fbase", 1, {"ag": ("gain", 1.0 / 14), "al": ("loss", 1.0 / 14)})
    + ", macd AS (SELECT *, e12 - e26 AS line FROM ewalk WHERE pos >= 25),"
    + ema_walk("swalk", "macd", 25, {"sig": ("line", span(9))})
    + """,
    tech AS (
      SELECT b.symbol, b.ts, b.pos,
             CASE WHEN b.pos >= 8 THEN (close - w.e9) / greatest(w.e9, 1e-12) END AS ema_dist_9m,
             CASE WHEN b.pos >= 20 THEN (close - w.e21) / greatest(w.e21, 1e-12) END AS ema_dist_21m,
             CASE WHEN b.pos >= 14 THEN 1.0 - 1.0 / (1.0 + ag / greatest(al, 1e-12)) END AS rsi_14m,
             line AS macd_line, CASE WHEN b.pos >= 33 THEN sig END AS macd_signal, CASE WHEN b.pos >= 33 THEN line - sig END AS macd_hist
      FROM fbase b LEFT JOIN ewalk w USING (symbol, pos) LEFT JOIN mwalk USING (symbol, pos)
      LEFT JOIN macd m USING (symbol, pos) LEFT JOIN swalk s USING (symbol, pos))"""
)
cte("gbars", "b", "SELECT * REPLACE (CASE WHEN (epoch_us(ts) // 300000000) % 11 NOT IN (0, 3, 4) THEN close END AS close) FROM b")
cte(
    "gbase", "gbars",
    """
    SELECT *, CASE WHEN close < before THEN 0.0 ELSE close - before END AS gain, CASE WHEN close > before THEN 0.0 ELSE before - close END AS loss
    FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS before FROM gbars)""",
)


def gap_walk(name: str, src: str, values: dict[str, tuple[str, float, int]]) -> str:
    """Averages row by row with missing values: {out: (column, alpha, least number of values)}.

    For each average the walk carries its value, the rows since the last value, and the number of values seen.
    """
    first, step, shown = [], [], []
    for o, (x, a, least) in values.items():
        first.append(f"{x} AS y_{o}, 1 AS k_{o}, CASE WHEN {x} IS NULL THEN 0 ELSE 1 END AS n_{o}")
        q = f"power({1 - a!r}, w.k_{o})"
        step.append(
            f"CASE WHEN s.{x} IS NULL THEN w.y_{o} WHEN w.y_{o} IS NULL THEN s.{x} ELSE ({q} * w.y_{o} + {a!r} * s.{x}) / ({q} + {a!r}) END, "
            f"CASE WHEN s.{x} IS NULL THEN w.k_{o} + 1 ELSE 1 END, w.n_{o} + CASE WHEN s.{x} IS NULL THEN 0 ELSE 1 END"
        )
        shown.append(f"CASE WHEN n_{o} >= {least} THEN y_{o} END AS {o}")
    return f"""
    {name}_w AS (
      SELECT symbol, pos, {', '.join(first)} FROM {src} WHERE pos = 0
      UNION ALL
      SELECT s.symbol, s.pos, {', '.join(step)} FROM {name}_w w JOIN {src} s ON s.symbol = w.symbol AND s.pos = w.pos + 1),
    {name} AS (SELECT symbol, pos, {', '.join(shown)} FROM {name}_w)"""


GAP_CTES = (
    gap_walk("gw", "gbase", {f"e{n}": ("close", span(n), n) for n in (9, 12, 21, 26)} | {"ag": ("gain", 1.0 / 14, 14), "al": ("loss", 1.0 / 14, 14)})
    + ", gline AS (SELECT symbol, pos, e12 - e26 AS line FROM gw),"
    + gap_walk("gs", "gline", {"sig": ("line", span(9), 9)})
    + """,
    gtech AS (
      SELECT b.symbol, b.ts, (close - e9) / greatest(e9, 1e-12) AS ema_dist_9m, (close - e21) / greatest(e21, 1e-12) AS ema_dist_21m,
             CASE WHEN ag IS NOT NULL THEN 1.0 - 1.0 / (1.0 + ag / greatest(al, 1e-12)) END AS rsi_14m,
             line AS macd_line, sig AS macd_signal, line - sig AS macd_hist
      FROM gbase b JOIN gw USING (symbol, pos) JOIN gline USING (symbol, pos) JOIN gs USING (symbol, pos))"""
)
MARKET_CTES = """
    idx AS (SELECT ts, pos AS spy_pos, ln(close / greatest(lag(close, 5) OVER (ORDER BY pos), 1e-12)) AS spy_ret_5m FROM b WHERE symbol = 'view'),
    prox AS (SELECT session_date, lag(close, 1) OVER w / lag(close, 2) OVER w - 1.0 AS vix_chg_1d FROM daily WHERE symbol = 'signup' WINDOW w AS (ORDER BY session_date)),
    market AS (SELECT b.symbol, b.ts, CASE WHEN i.spy_pos >= 5 THEN i.spy_ret_5m END AS spy_ret_5m, p.vix_chg_1d FROM b LEFT JOIN idx i USING (ts) LEFT JOIN prox p USING (session_date))"""

FEATURES: dict[str, str] = {
    "log_entry_close": "log_entry_close",
    "intraday_range_pct": "intraday_range_pct",
    "log1p_volume": "log1p_volume",
    "returns_multi_horizon": "ret_5m ret_15m",
    "realized_vol_multi": "rv_10m rv_30m rv_ratio_10_30m",
    "range_vol_multi": "parkinson_10m atr_norm_10m",
    "session_time": "minutes_since_open minutes_to_close sin_time cos_time",
    "session_day_of_week": "sin_dow cos_dow",
    "volume_context": "rel_volume log_rel_volume",
    "vwap_distance": "vwap_session_dist_pct",
    "bar_microstructure": "close_loc_value bar_body_pct",
    "order_flow_proxies": "corwin_schultz_spread roll_implied_spread amihud_illiq signed_volume_proxy upper_wick_pct lower_wick_pct",
}
GEOMETRY = "sigma_ann_at_entry vol_scale_ratio tp_move_effective sl_move"
TECH = "ema_dist_9m ema_dist_21m rsi_14m macd_line macd_signal macd_hist"
MARKET = "spy_ret_5m vix_chg_1d"
BAR_GROUPS = " ".join(cols for g, cols in FEATURES.items() if g != "session_day_of_week")
ALL_FEATURES = f"{GEOMETRY} {BAR_GROUPS} {TECH} {MARKET}"
NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in ALL_FEATURES.split())
MATRIX_CTES = EMA_CTES + "," + MARKET_CTES + f""",
    matrix AS (
      SELECT * FROM (
        SELECT l.symbol, l.entry_time, l.session_date, l.entry_pos, l.barrier_outcome AS y,
               l.sigma_ann_at_entry, l.vol_scale_ratio, l.tp_move_effective, l.sl_move,
               {', '.join('f.' + c for c in BAR_GROUPS.split())}, {', '.join('t.' + c for c in TECH.split())}, m.spy_ret_5m, m.vix_chg_1d
        FROM lab l JOIN fbar f ON f.symbol = l.symbol AND f.ts = l.entry_time
        JOIN tech t ON t.symbol = l.symbol AND t.ts = l.entry_time
        JOIN market m ON m.symbol = l.symbol AND m.ts = l.entry_time WHERE l.entry_pos >= {WARMUP}) WHERE {NOT_NULL})"""
LIVE = " ".join(FEATURES[g] for g in ("returns_multi_horizon", "realized_vol_multi", "range_vol_multi", "vwap_distance")) + " " + TECH
#: the matrix columns in the order of the groups
MATRIX_ORDER = (
    "log_entry_close " + GEOMETRY + " " + " ".join(FEATURES[g] for g in (
        "intraday_range_pct", "log1p_volume", "returns_multi_horizon", "realized_vol_multi", "range_vol_multi", "session_time",
        "volume_context", "vwap_distance", "bar_microstructure",
    )) + " " + MARKET + " " + TECH + " " + FEATURES["order_flow_proxies"]
).split()
SPLIT = "CASE WHEN session_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-22' THEN 'train' ELSE 'val' END"
IN_SPLIT = "session_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-31'"

# Matrix rows with their split, without validation rows of classes that train lacks, and rows per class.
SUPPORT_CTES = MATRIX_CTES + f""",
    sm AS (SELECT *, {SPLIT} AS split FROM matrix WHERE {IN_SPLIT}),
    sk AS (SELECT * FROM sm WHERE y IN (SELECT y FROM sm WHERE split = 'train')),
    supports AS (
      SELECT s.split, c.y AS class, count(*) FILTER (WHERE k.y = c.y) AS support, count(*) AS n
      FROM (SELECT DISTINCT split FROM sk) s CROSS JOIN (SELECT DISTINCT y FROM sk WHERE split = 'train') c JOIN sk k USING (split) GROUP BY 1, 2)"""

# Weights on the training rows, by counting open labels at every position.
cte("tr", "lab", f"SELECT *, barrier_outcome AS y FROM lab WHERE session_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-22'")
cte("cover", "tr", "SELECT symbol, entry_time, unnest(range(entry_pos + 1, entry_pos + bars_forward + 1)) AS t FROM tr")
cte("conc", "cover", "SELECT symbol, t, count(*) AS c FROM cover GROUP BY 1, 2")
cte("uniq", "cover conc", "SELECT symbol, entry_time, avg(1.0 / c) AS uniqueness FROM cover JOIN conc USING (symbol, t) GROUP BY 1, 2")

# Run-log records made of events.
cte(
    "runs", "",
    """
    SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS logged_at_utc, printf('r%09d', event_id) AS run_id, upper(event_type) AS symbol,
           CASE WHEN event_id % 7 <> 0 THEN round(value / 1000.0, 6) END AS val_f1_macro,
           CASE WHEN event_id % 4 <> 0 THEN value END AS train_accuracy,
           CAST(json_extract(props, '$.k') AS BIGINT) AS k, printf('[%d,%d]', user_id, event_id) AS ids,
           CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS note, value, event_id
    FROM events""",
)


def report_ctes(src: str, key: str, classes: list[str] | None = None) -> str:
    ks = [k.strip() for k in key.split(",")]
    named = f"SELECT DISTINCT {key}, unnest([{', '.join(repr(c) for c in classes)}]) AS class FROM {src}" if classes else (
        f"SELECT {key}, y_true AS class FROM {src} UNION SELECT {key}, y_pred FROM {src}"
    )
    on = " AND ".join(f"p.{k} = n.{k}" for k in ks)
    nk = ", ".join(f"n.{k}" for k in ks)
    return f"""
    pc AS (
      SELECT {key}, class, coalesce(tp / nullif(pr, 0), 0.0) AS precision, coalesce(tp / nullif(su, 0), 0.0) AS recall,
             coalesce(2.0 * tp / nullif(pr + su, 0), 0.0) AS f1, su AS support, tp
      FROM (SELECT {nk}, n.class, count(*) FILTER (WHERE p.y_true = n.class AND p.y_pred = n.class) AS tp,
                   count(*) FILTER (WHERE p.y_pred = n.class) AS pr, count(*) FILTER (WHERE p.y_true = n.class) AS su
            FROM ({named}) n JOIN {src} p ON {on} GROUP BY {nk}, n.class))"""


UNIQ = "(SELECT symbol, entry_time, coalesce(uniqueness, 1.0) AS uniqueness, y FROM tr LEFT JOIN uniq USING (symbol, entry_time))"
USERS = "(SELECT CAST(user_id AS VARCHAR) AS symbol, '1min' AS interval, CAST(ts AS DATE) AS d FROM events)"
BOUNDS = f"(SELECT symbol, interval, min(d) AS stored_start, max(d) AS stored_end FROM {USERS} GROUP BY 1, 2)"
GAPS = f"""(SELECT symbol, interval, DATE '2023-12-20' AS range_start, stored_start - 1 AS range_end FROM {BOUNDS} WHERE stored_start > DATE '2023-12-24'
    UNION ALL SELECT symbol, interval, stored_end + 1, DATE '2024-02-10' FROM {BOUNDS} WHERE stored_end + 4 < DATE '2024-02-10')"""
BAR_COLS = "symbol, ts, session_date, n_ AS n_"
OHLCV = "open high low close volume"
LAB_KEYS = "symbol, entry_time, session_date, entry_pos, barrier_outcome, bars_forward"
LAB_DOUBLES = "entry_close sigma_ann_at_entry sigma_ref vol_scale_ratio tp_move_effective sl_move upper_barrier lower_barrier"
NEW = "SELECT symbol, ts, session_date, open, high, low, close + 1.0 AS close, volume FROM b WHERE session_date >= DATE '2024-01-15'"
STORED = "SELECT symbol, ts, session_date, open, high, low, close, volume FROM b WHERE session_date <= DATE '2024-01-19'"
BARS_5MIN = pick("symbol, ts, session_date", OHLCV, "b")

NORMALIZED = """
    SELECT symbol, ts, arg_max(p, event_id) AS p, arg_max(user_id, event_id) AS volume, max(event_id) AS last,
                 CASE WHEN max(event_id) % 10 = 0 THEN NULL ELSE arg_max(value, event_id) END AS open,
                 CASE WHEN max(event_id) % 10 = 0 THEN NULL ELSE arg_max(value, event_id) END AS high,
                 CASE WHEN max(event_id) % 10 = 0 THEN NULL ELSE arg_max(value, event_id) END AS low,
                 CASE WHEN max(event_id) % 10 = 0 THEN NULL ELSE arg_max(value, event_id) END AS close
          FROM (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, value, CAST(user_id AS DOUBLE) AS user_id, event_id, value AS p FROM events)
          GROUP BY 1, 2"""

#: one account for all symbols and one for two of them; signals of several symbols at one time are in the order of their names
PORTFOLIO = """
    SELECT account, symbol, entry_time, session_date, missing_exit, pnl, exit_session_date, NOT missing_exit AND exit_session_date = session_date AS candidate
    FROM facts JOIN (SELECT unnest(['all', 'two']) AS account) a ON account = 'all' OR symbol IN ('click', 'view') WHERE y_pred = 'take_profit'"""

#: name -> (CTEs, extra CTE text, final SELECT)
SPEC: dict[str, tuple[str, str, str]] = {
    "bars": ("b", "", BARS_5MIN),
    "stream_bars": ("b", "", BARS_5MIN),
    "normalized_bars": ("", "", pick("symbol, ts", OHLCV, f"({NORMALIZED})")),
    "store_round_trip": (
        "", "",
        pick("symbol, ts, CAST(ts AS DATE) AS session_date", OHLCV, f"""(
          SELECT * REPLACE (CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN close + 1.0 ELSE close END AS close) FROM ({NORMALIZED})
          WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-30')"""),
    ),
    "merged_bars": (
        "b", f"new AS ({NEW}), stored AS ({STORED})",
        pick("symbol, ts, session_date", OHLCV, "(SELECT * FROM new UNION ALL SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.symbol = s.symbol AND n.ts = s.ts))"),
    ),
    "refreshed_bars": (
        "b", f"new AS ({NEW}), stored AS ({STORED})",
        pick("symbol, ts, session_date", OHLCV, "(SELECT * FROM new UNION ALL SELECT * FROM stored WHERE session_date < DATE '2024-01-15')"),
    ),
    "bars_in_range": (
        "b", "",
        pick("symbol, ts, session_date", OHLCV, "b", "WHERE session_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-17' AND symbol IN ('click', 'view')"),
    ),
    "stored_bounds": ("", "", f"SELECT * FROM {BOUNDS}"),
    "missing_ranges": ("", "", f"SELECT * FROM {GAPS}"),
    "calendar_chunks": (
        "", "",
        f"""SELECT symbol, interval, range_start, range_end, CAST(c AS DATE) AS chunk_start, least(range_end, CAST(c AS DATE) + 6) AS chunk_end
        FROM (SELECT *, unnest(generate_series(range_start, range_end, INTERVAL 7 DAY)) AS c FROM {GAPS} WHERE range_end >= range_start)""",
    ),
    "exchange_sessions": (
        "", "",
        """SELECT event_type, CAST(ts AS DATE) AS session_date, count(*) AS n,
               count(*) FILTER (WHERE strftime(ts, '%H:%M') BETWEEN '09:30' AND '16:00') AS n_in_session,
               min(ts) + INTERVAL 5 HOUR AS first_utc, max(ts) + INTERVAL 5 HOUR AS last_utc
           FROM events GROUP BY 1, 2""",
    ),
    "daily_close": ("daily", "", pick("symbol, session_date", "close", "daily")),
    "daily_vol": ("dvol", "", pick("symbol, session_date", "close log_ret sigma_daily_5d vol_5d_ann", "dvol")),
    "bar_vol": ("bv", "", pick("symbol, ts", "sigma_daily_5d vol_5d_ann", "bv")),
    "trading_day_rank": ("b", "", "SELECT symbol, ts, session_date, day_rank, pos, n_bars FROM b"),
    "sigma_ref": (
        "bv", "",
        pick("symbol", "sigma_ref_median sigma_ref_mean", "(SELECT symbol, median(vol_5d_ann) AS sigma_ref_median, avg(vol_5d_ann) AS sigma_ref_mean FROM bv GROUP BY 1)"),
    ),
    "vol_summary": (
        "bv", "",
        pick('symbol, "count"', "mean std min p25 p50 p75 max", """(
          SELECT symbol, count(vol_5d_ann) AS "count", avg(vol_5d_ann) AS mean, stddev_samp(vol_5d_ann) AS std, min(vol_5d_ann) AS min,
                 quantile_cont(vol_5d_ann, 0.25) AS p25, quantile_cont(vol_5d_ann, 0.5) AS p50, quantile_cont(vol_5d_ann, 0.75) AS p75, max(vol_5d_ann) AS max
          FROM bv GROUP BY 1)"""),
    ),
    "vol_last_rows": (
        "b dvol", "",
        pick("symbol, ts, from_end", "close sigma_daily_5d vol_5d_ann", """(
          SELECT b.symbol, b.ts, b.close, d.sigma_daily_5d, d.vol_5d_ann, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts DESC) AS from_end
          FROM b LEFT JOIN dvol d USING (symbol, session_date))""", "WHERE from_end <= 8"),
    ),
    "triple_barrier": ("lab", "", pick(LAB_KEYS, LAB_DOUBLES, "lab")),
    "triple_barrier_hourly": ("lab_h", "", pick(LAB_KEYS, LAB_DOUBLES, "lab_h")),
    "label_mix": ("lab", "", "SELECT symbol, barrier_outcome, count(*) AS n FROM lab GROUP BY 1, 2"),
    "label_issues": (
        "", f"raw AS ({bars_from(SECONDS, 'CAST(user_id AS VARCHAR)')}), d AS (SELECT symbol, CAST(ts AS DATE) AS session_date, count(*) AS n, arg_max(close, ts) AS close FROM raw GROUP BY 1, 2),"
        " r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY session_date)) AS r FROM d),"
        " v AS (SELECT *, count(r) OVER (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS have FROM r)",
        """SELECT * FROM (SELECT symbol, CAST(sum(n) AS BIGINT) AS n_bars, count(*) FILTER (WHERE have = 20) AS n_vol,
             CASE WHEN sum(n) < 3 THEN 'fewer than 3 bars' WHEN count(*) FILTER (WHERE have = 20) = 0 THEN 'no finite volatility' END AS issue
           FROM v GROUP BY 1) WHERE issue IS NOT NULL""",
    ),
    **{
        f"feat_{g}": ("fbar", "", pick("symbol, ts", cols, "fbar", "WHERE isodow(ts) < 6" if g == "session_day_of_week" else ""))
        for g, cols in FEATURES.items()
    },
    "feat_long_frames": ("flong", "", pick("symbol, ts", LONG, "flong")),
    "feat_technical_gaps": ("gbase", GAP_CTES, pick("symbol, ts", TECH, "gtech")),
    "feat_label_geometry": ("lab", "", pick("symbol, entry_time AS ts", GEOMETRY, "lab")),
    "feat_technical_indicators": ("fbase", EMA_CTES, pick("symbol, ts", TECH, "tech")),
    "feat_market_context": ("b daily", MARKET_CTES, pick("symbol, ts", MARKET, "market")),
    "stream_scores": (
        "fbar dvol", EMA_CTES,
        pick("symbol, entry_time", LIVE, f"""(
          SELECT f.symbol, f.ts AS entry_time, {', '.join(LIVE.split())} FROM fbar f JOIN tech t USING (symbol, ts) JOIN dvol d ON d.symbol = f.symbol AND d.session_date = f.session_date
          WHERE f.pos >= {WARMUP} AND d.vol_5d_ann IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in LIVE.split())})"""),
    ),
    "feature_matrix": ("lab fbar daily", MATRIX_CTES, pick("symbol, entry_time, session_date, entry_pos, y", ALL_FEATURES, "matrix")),
    "split_balance": ("lab fbar daily", MATRIX_CTES, f"SELECT symbol, {SPLIT} AS split, y, count(*) AS n FROM matrix WHERE {IN_SPLIT} GROUP BY 1, 2, 3"),
    "known_class_rows": (
        "lab", f"s AS (SELECT barrier_outcome AS y, {SPLIT} AS split FROM lab WHERE {IN_SPLIT})",
        "SELECT split, y, count(*) AS n FROM s WHERE y IN (SELECT y FROM s WHERE split = 'train') GROUP BY 1, 2",
    ),
    "uniqueness_weights": ("tr uniq", "", pick("symbol, entry_time", "uniqueness", UNIQ)),
    "class_weights": (
        "tr", "",
        pick("symbol, y, n", "class_weight", """(SELECT symbol, y, n, CAST(sum(n) OVER w AS DOUBLE) / (count(*) OVER w * n) AS class_weight
          FROM (SELECT symbol, y, count(*) AS n FROM tr GROUP BY 1, 2) WINDOW w AS (PARTITION BY symbol))"""),
    ),
    "fit_weights": (
        "tr uniq", "cw AS (SELECT y, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS class_weight FROM (SELECT y, count(*) AS n FROM tr GROUP BY 1))",
        pick("symbol, entry_time", "uniqueness class_weight fit_weight", f"(SELECT symbol, entry_time, uniqueness, class_weight, uniqueness * class_weight AS fit_weight FROM {UNIQ} JOIN cw USING (y))"),
    ),
    "weight_summary": (
        "tr uniq", "",
        pick("symbol", "sample_weight_mean sample_weight_min", f"""(SELECT symbol, avg(w) AS sample_weight_mean, min(w) AS sample_weight_min FROM (
          SELECT symbol, uniqueness * CASE y WHEN 'take_profit' THEN 2.0 WHEN 'stop_loss' THEN 0.5 ELSE 1.0 END AS w FROM {UNIQ}) GROUP BY 1)"""),
    ),
    "daytrade_window": (
        "", "e AS (SELECT user_id, CAST(ts AS DATE) AS d FROM events), a AS (SELECT DISTINCT user_id, d AS as_of FROM e)",
        f"""SELECT a.user_id, a.as_of, count(e.d) AS n_in_window, count(e.d) < 10 AS can_add FROM a
        LEFT JOIN e ON e.user_id = a.user_id AND isodow(e.d) < 6 AND {bd('e.d')} <= {bd('a.as_of')} AND {bd('e.d')} > {bd('a.as_of')} - 5 GROUP BY 1, 2""",
    ),
    "daytrade_cap": (
        "", greedy("SELECT user_id, event_id, row_number() OVER (ORDER BY ts, event_id) AS entry_time, CAST(ts AS DATE) AS session_date, TRUE AS candidate FROM events", "user_id", 5, 5),
        "SELECT user_id, event_id, session_date, over_cap FROM decided",
    ),
    "weekday_windows": (
        "", "",
        f"""SELECT d, n_users, anchor, CAST(anchor - CASE isodow(anchor) WHEN 5 THEN 4 ELSE 6 END AS DATE) AS window_start, CAST({bd('d')} AS BIGINT) AS bd
        FROM (SELECT d, count(DISTINCT user_id) AS n_users, CAST(d - CAST(greatest(isodow(d) - 5, 0) AS INTEGER) AS DATE) AS anchor
              FROM (SELECT CAST(ts AS DATE) AS d, user_id FROM events) GROUP BY 1)""",
    ),
    "history_dates": (
        "", "e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), a AS (SELECT user_id, max(d) AS as_of FROM e GROUP BY 1)",
        f"""SELECT a.user_id, a.as_of, count(e.d) AS n_in_window, count(e.d) < 3 AS can_add FROM a
        LEFT JOIN e ON e.user_id = a.user_id AND isodow(e.d) < 6 AND {bd('e.d')} <= {bd('a.as_of')} AND {bd('e.d')} > {bd('a.as_of')} - 5 GROUP BY 1, 2""",
    ),
    "trades": (
        "facts", trade_ctes("SELECT * FROM facts WHERE y_pred = 'take_profit'", "symbol"),
        pick("symbol, entry_time, session_date, y_true, y_pred, taken, blocked_reason, exit_session_date", "proba_take_profit pnl_fraction", "trades"),
    ),
    "portfolio_cap": (
        "facts", greedy(PORTFOLIO, "account", 3, 5, "entry_time, symbol"),
        """SELECT account, symbol, entry_time, session_date, NOT missing_exit AND NOT over_cap AS taken,
                  CASE WHEN missing_exit THEN 'missing_ohlcv_exit' WHEN over_cap THEN 'day_trade_cap' END AS blocked_reason FROM decided""",
    ),
    "portfolio_summary": (
        "facts", greedy(PORTFOLIO, "account", 3, 5, "entry_time, symbol") + """,
        taken AS (SELECT *, sum(pnl) OVER w AS cum FROM decided WHERE NOT missing_exit AND NOT over_cap
                  WINDOW w AS (PARTITION BY account ORDER BY entry_time, symbol ROWS UNBOUNDED PRECEDING)),
        peaks AS (SELECT *, max(cum) OVER (PARTITION BY account ORDER BY entry_time, symbol ROWS UNBOUNDED PRECEDING) AS peak FROM taken)""",
        pick("account, n_signals, n_trades_taken, n_trades_blocked_day_trade_cap", "gross_return_sum max_drawdown_cumulative_sum", """(
          SELECT d.*, p.gross_return_sum, p.max_drawdown_cumulative_sum FROM (
            SELECT account, count(*) AS n_signals, count(*) FILTER (WHERE NOT missing_exit AND NOT over_cap) AS n_trades_taken,
                   count(*) FILTER (WHERE over_cap) AS n_trades_blocked_day_trade_cap FROM decided GROUP BY 1) d
          JOIN (SELECT account, sum(pnl) AS gross_return_sum, min(cum - peak) AS max_drawdown_cumulative_sum FROM peaks GROUP BY 1) p USING (account))"""),
    ),
    "trade_summary": (
        "facts", summary_sql("SELECT * FROM facts WHERE proba_take_profit >= 0.4", "symbol", "SELECT DISTINCT symbol FROM val"),
        pick(f"symbol, 'proba_threshold_take_profit' AS policy, CAST(0.4 AS DOUBLE) AS tp_threshold, {SUMMARY_COUNTS}", SUMMARY_DOUBLES, "summary"),
    ),
    "signal_quality": (
        "val", "",
        pick("symbol, n_predictions, n_val_take_profit, n_signal_take_profit", "precision_take_profit recall_take_profit", """(
          SELECT symbol, count(*) AS n_predictions, count(*) FILTER (WHERE y_true = 'take_profit') AS n_val_take_profit,
                 count(*) FILTER (WHERE y_true = 'take_profit' AND y_pred = 'take_profit') AS n_signal_take_profit,
                 count(*) FILTER (WHERE y_true = 'take_profit' AND y_pred = 'take_profit') / count(*) FILTER (WHERE y_pred = 'take_profit') AS precision_take_profit,
                 count(*) FILTER (WHERE y_true = 'take_profit' AND y_pred = 'take_profit') / count(*) FILTER (WHERE y_true = 'take_profit') AS recall_take_profit
          FROM val GROUP BY 1)"""),
    ),
    "threshold_sweep": ("facts", SWEEP, pick(f"symbol, {SUMMARY_COUNTS}", f"threshold {SUMMARY_DOUBLES}", "summary")),
    "suggested_threshold": (
        "facts", SWEEP,
        pick("symbol, n_signals", "threshold precision_take_profit recall_take_profit gross_return_sum", """(
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY precision_take_profit DESC, gross_return_sum DESC, n_signals DESC, threshold) AS rn
          FROM summary WHERE n_signals >= 5)""", "WHERE rn = 1"),
    ),
    "policy_compare": (
        "facts", summary_sql(POLICY_SIGNALS, "symbol, policy", POLICY_GROUPS),
        pick(f"symbol, policy, {SUMMARY_COUNTS}", SUMMARY_DOUBLES, "summary"),
    ),
    "confusion_report": (
        "val", "vv AS (SELECT * FROM val WHERE y_true <> 'end_of_data'), " + report_ctes("vv", "symbol", ["stop_loss", "take_profit", "vertical"])
        + """, av AS (SELECT symbol, CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS acc, avg(precision) AS pm, avg(recall) AS rm, avg(f1) AS fm,
               sum(precision * support) / sum(support) AS pw, sum(recall * support) / sum(support) AS rw, sum(f1 * support) / sum(support) AS fw FROM pc GROUP BY 1)""",
        pick("symbol, class, support", "precision recall f1", """(
          SELECT symbol, class, precision, recall, f1, support FROM pc
          UNION ALL SELECT symbol, 'accuracy', acc, acc, acc, n FROM av
          UNION ALL SELECT symbol, 'macro avg', pm, rm, fm, n FROM av
          UNION ALL SELECT symbol, 'weighted avg', pw, rw, fw, n FROM av)"""),
    ),
    "f1_scores": (
        "pred", report_ctes("pred", "symbol, split"),
        pick("symbol, split, n", "accuracy f1_macro f1_weighted", """(
          SELECT symbol, split, CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS accuracy, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted
          FROM pc GROUP BY 1, 2)"""),
    ),
    "meta_gate": (
        "pred", "",
        pick("symbol, split, n_gated, n_positive", "accuracy_gated precision_gated recall_gated", """(
          SELECT symbol, split, count(*) AS n_gated, count(*) FILTER (WHERE hit) AS n_positive,
                 count(*) FILTER (WHERE hit = act) / count(*) AS accuracy_gated,
                 coalesce(count(*) FILTER (WHERE hit AND act) / nullif(count(*) FILTER (WHERE act), 0), 0.0) AS precision_gated,
                 coalesce(count(*) FILTER (WHERE hit AND act) / nullif(count(*) FILTER (WHERE hit), 0), 0.0) AS recall_gated
          FROM (SELECT *, y_true = 'take_profit' AS hit, meta_proba > 0.5 AS act FROM pred WHERE proba_take_profit >= 0.35) GROUP BY 1, 2)"""),
    ),
    "leaked_rows": ("pred", "", "SELECT split, count(*) AS n FROM pred WHERE proba_take_profit >= 0.35 AND split <> 'train' GROUP BY 1"),
    "session_rollup": (
        "val", "",
        pick("symbol, session_date, pred_n, y_true_first, y_pred_mode", "max_proba_mean", """(
          SELECT v.symbol, v.session_date, count(*) AS pred_n, arg_min(y_true, entry_time) AS y_true_first, any_value(m.y_pred_mode) AS y_pred_mode, avg(max_proba) AS max_proba_mean
          FROM val v JOIN (SELECT symbol, session_date, y_pred AS y_pred_mode FROM (
             SELECT symbol, session_date, y_pred, row_number() OVER (PARTITION BY symbol, session_date ORDER BY count(*) DESC, y_pred) AS rn FROM val GROUP BY 1, 2, 3) WHERE rn = 1) m
          USING (symbol, session_date) GROUP BY 1, 2)"""),
    ),
}

SPEC |= {"stored_backtest": SPEC["trade_summary"], "stored_trades": SPEC["trades"], "stored_sweep": SPEC["threshold_sweep"]}
JOURNAL = """
    j AS (SELECT CAST(ts AS DATE) AS entry_date, event_id FROM events WHERE event_type = 'purchase' AND event_id % 5 <> 0),
    roll AS (SELECT v.session_date, count(*) AS pred_n, arg_min(y_true, entry_time) AS y_true_first, any_value(m.y_pred_mode) AS y_pred_mode, avg(max_proba) AS max_proba_mean
      FROM val v JOIN (SELECT session_date, y_pred AS y_pred_mode FROM (
        SELECT session_date, y_pred, row_number() OVER (PARTITION BY session_date ORDER BY count(*) DESC, y_pred) AS rn FROM val WHERE symbol = 'click' GROUP BY 1, 2) WHERE rn = 1) m
      USING (session_date) WHERE v.symbol = 'click' GROUP BY 1),
    jc AS (SELECT j.*, r.* REPLACE (coalesce(r.pred_n, 0) AS pred_n), coalesce(r.pred_n > 0, FALSE) AS model_matched FROM j LEFT JOIN roll r ON r.session_date = j.entry_date)"""
SPEC |= {
    "stored_journal": ("val", JOURNAL, pick("entry_date, event_id, session_date, pred_n, y_true_first, y_pred_mode, model_matched", "max_proba_mean", "jc")),
    "journal_compare": ("val", JOURNAL, pick("entry_date, event_id, session_date, pred_n, y_true_first, y_pred_mode, model_matched", "max_proba_mean", "jc")),
    "journal_matches": ("val", JOURNAL, "SELECT count(*) AS n_rows, count(*) FILTER (WHERE model_matched) AS n_matched FROM jc"),
    "runlog_flat": (
        "runs", "",
        pick('logged_at_utc, run_id, symbol, k AS "experiment_config.props.k", ids AS "experiment_config.ids", note AS "experiment_config.note"', "val_f1_macro train_accuracy", "runs"),
    ),
    "leaderboard": (
        "runs", "",
        pick("rank, run_id, symbol", "val_f1_macro", "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY val_f1_macro DESC, run_id) AS rank FROM runs WHERE val_f1_macro IS NOT NULL)", "WHERE rank <= 10"),
    ),
    "best_run": (
        "runs", "",
        pick("run_id, symbol", "val_f1_macro", "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY val_f1_macro DESC, run_id) AS rank FROM runs WHERE val_f1_macro IS NOT NULL)", "WHERE rank = 1"),
    ),
    "log_tail": (
        "runs", "",
        pick("logged_at_utc, run_id, symbol", "val_f1_macro", "(SELECT * FROM runs WHERE symbol = 'CLICK' ORDER BY logged_at_utc DESC LIMIT 5)"),
    ),
    "backfilled_trials": (
        "runs", "",
        pick("run_id, logged_at_utc", "train_accuracy", "(SELECT run_id, logged_at_utc, coalesce(train_accuracy, value * 2) AS train_accuracy FROM runs ORDER BY logged_at_utc DESC LIMIT 10)"),
    ),
    "run_report": (
        "val", "vv AS (SELECT *, strftime(session_date, '%Y%m%d') AS run_id FROM val), " + report_ctes("vv", "symbol, run_id")
        + """, m AS (SELECT symbol, run_id, CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS accuracy, avg(f1) AS f1_macro,
                    sum(f1 * support) / sum(support) AS f1_weighted, row_number() OVER (PARTITION BY symbol ORDER BY run_id DESC) AS age FROM pc GROUP BY 1, 2)""",
        pick("part, symbol, run_id, class, n", "a b c", """(
          SELECT 'per_class' AS part, pc.symbol, pc.run_id, class, precision AS a, recall AS b, f1 AS c, support AS n FROM pc JOIN m USING (symbol, run_id) WHERE age = 1
          UNION ALL SELECT 'metrics', symbol, run_id, '', accuracy, f1_macro, f1_weighted, n FROM m WHERE age = 1
          UNION ALL SELECT 'log_tail', symbol, run_id, '', accuracy, f1_macro, f1_weighted, n FROM m WHERE age <= 5)"""),
    ),
    "run_columns": (
        "pred", "",
        pick("run_id, symbol, split, n", "sum_proba_stop_loss sum_proba_take_profit sum_proba_vertical", """(
          SELECT run_id, symbol, split, count(*) AS n, sum(proba_stop_loss) AS sum_proba_stop_loss,
                 CASE WHEN run_id <> 'r1' THEN sum(proba_take_profit) END AS sum_proba_take_profit,
                 CASE WHEN run_id = 'r1' THEN sum(proba_vertical) END AS sum_proba_vertical
          FROM pred CROSS JOIN (SELECT unnest(['r1', 'r2', 'latest']) AS run_id) GROUP BY 1, 2, 3)"""),
    ),
    "train_logistic": ("lab fbar daily", SUPPORT_CTES, "SELECT split, class, support, n, CAST(n AS DOUBLE) AS proba_total, TRUE AS at_optimum FROM supports"),
    "train_boosted": ("lab fbar daily", SUPPORT_CTES, "SELECT split, class, support, n, CAST(n AS DOUBLE) AS proba_total FROM supports"),
    "meta_label": ("lab fbar daily", SUPPORT_CTES, "SELECT split, count(*) AS n_rows, count(*) AS n_same FROM sk GROUP BY 1"),
    "grid_train": (
        "lab fbar daily", SUPPORT_CTES,
        """SELECT CAST(c AS DOUBLE) AS "grid.model.logistic_c", s AS "grid.scaler", TRUE AS ok, 'g_logistic_c' || CASE WHEN c < 1 THEN '0p1' ELSE '1' END || '_scaler' || s AS experiment_name,
               (SELECT count(*) FROM sk WHERE split = 'train') AS train_n, (SELECT count(*) FROM sk WHERE split = 'val') AS val_n, '' AS error, 'none' AS sample_weight_method
           FROM (SELECT unnest([0.1, 1.0]) AS c) CROSS JOIN (SELECT unnest(['standard', 'robust']) AS s)""",
    ),
    "grid_dry_run": (
        "lab fbar daily", SUPPORT_CTES + """,
        t AS (SELECT count(*) FILTER (WHERE split = 'train') AS tr, count(*) FILTER (WHERE split = 'val') AS va, (SELECT count(*) FROM sm) - count(*) AS lost FROM sk),
        bal AS (SELECT split, string_agg(y || '=' || n, ',' ORDER BY y) AS text FROM (SELECT split, y, count(*) AS n FROM sm GROUP BY 1, 2) GROUP BY 1),
        c AS (SELECT c, m FROM (SELECT unnest([0.1, 1.0]) AS c) CROSS JOIN (SELECT unnest([1, 1000000000]) AS m))""",
        f"""SELECT CAST(c AS DOUBLE) AS "grid.model.logistic_c", CAST(m AS BIGINT) AS "grid.train.min_val_rows", va >= m AS ready,
               'g_logistic_c' || CASE WHEN c < 1 THEN '0p1' ELSE '1' END || '_min_val_rows' || m AS experiment_name,
               CASE WHEN va >= m THEN tr ELSE 0 END AS train_n, CASE WHEN va >= m THEN va ELSE 0 END AS val_n,
               'logistic_regression' AS model_type, 'none' AS sample_weight_method, CAST({len(MATRIX_ORDER)} AS BIGINT) AS n_feature_columns,
               '{','.join(MATRIX_ORDER)}' AS feature_columns,
               (SELECT text FROM bal WHERE split = 'train') AS train_balance, (SELECT text FROM bal WHERE split = 'val') AS val_balance,
               CASE WHEN va >= m THEN lost ELSE 0 END AS val_rows_dropped_unseen FROM t, c""",
    ),
}


def _closure(names: list[str]) -> list[str]:
    done: list[str] = []

    def visit(n: str) -> None:
        for d in CTE[n][0]:
            visit(d)
        if n not in done:
            done.append(n)

    for n in names:
        visit(n)
    return done


#: date columns per query; both sides hand dates over as ISO text
DATES = {
    "session_date": (
        "bars stream_bars merged_bars refreshed_bars bars_in_range store_round_trip exchange_sessions daily_close daily_vol trading_day_rank "
        "triple_barrier triple_barrier_hourly feature_matrix daytrade_cap portfolio_cap trades stored_trades session_rollup journal_compare stored_journal"
    ),
    "exit_session_date": "trades stored_trades",
    "entry_date": "journal_compare stored_journal",
    "stored_start": "stored_bounds",
    "stored_end": "stored_bounds",
    "range_start": "missing_ranges calendar_chunks",
    "range_end": "missing_ranges calendar_chunks",
    "chunk_start": "calendar_chunks",
    "chunk_end": "calendar_chunks",
    "as_of": "daytrade_window history_dates",
    "d": "weekday_windows",
    "anchor": "weekday_windows",
    "window_start": "weekday_windows",
}


def build(name: str) -> str:
    needs, extra, final = SPEC[name]
    dates = [c for c, where in DATES.items() if name in where.split()]
    if dates:
        final = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({final})"
    parts = [f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in _closure(needs.split())]
    if extra:
        parts.append(extra)
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + final


ORACLES: dict[str, str] = {name: build(name) for name in SPEC}
