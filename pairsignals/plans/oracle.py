"""Independent SQL (DuckDB dialect) for every registered query.

The statistics here are the plain two-pass textbook form - least squares,
residuals joined back, ``lag`` over each pair, second regression - so the
oracle shares no algebra with the engine's one-pass form. Tables are the
driver's views (``lineitem``, ``supplier``, ``events``).
"""

from __future__ import annotations

from pairsignals.config import AnalysisConfig
from pairsignals.functions.columns import round6_sql
from pairsignals.functions.critical import critical_value_sql
from pairsignals.plans import catalog as C


def r6(expr: str, alias: str) -> str:
    return f"{round6_sql(expr)} AS {alias}"


UNIVERSE = "(SELECT CAST(s_suppkey AS VARCHAR) AS ticker FROM supplier)"


def bars_cte(walk: bool = False, offset: float = 1500.0) -> str:
    raw = """bars_raw AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
         arg_min(l_extendedprice / l_quantity, struct_pack(o := l_orderkey, n := l_linenumber)) AS open,
         max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS close,
         CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM lineitem GROUP BY 1, 2)"""
    if not walk:
        return raw + ",\nbars AS (SELECT * FROM bars_raw)"
    return raw + f""",
bars AS (
  SELECT ticker, date, open, high, low,
         CAST(sum(CAST(close - {offset} AS DECIMAL(38,10))) OVER (PARTITION BY ticker ORDER BY date
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS close,
         volume
  FROM bars_raw)"""


def window_cte(cfg: AnalysisConfig) -> str:
    return f"""prof AS (SELECT ticker, count(*) AS n_bars, avg(volume) AS mean_volume FROM bars GROUP BY ticker),
elig AS (SELECT ticker FROM prof
         WHERE n_bars > {cfg.min_days} AND mean_volume > {cfg.min_mean_volume} AND NOT isnan(mean_volume)),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rk
           FROM bars b WHERE ticker IN (SELECT ticker FROM elig)),
win AS (SELECT ticker, rk - {cfg.begin_day + 1} AS i, date, coalesce(close, 'NaN'::DOUBLE) AS v, volume FROM ranked
        WHERE rk > {cfg.begin_day} AND rk <= {cfg.trim})"""


def aligned_cte(cfg: AnalysisConfig) -> str:
    if cfg.align == "rank":
        return """al AS (SELECT a.ticker AS sa, b.ticker AS sb, a.i AS i, a.date AS da, b.date AS db,
                 a.v AS av, b.v AS bv
          FROM win a JOIN win b ON a.i = b.i AND a.ticker <> b.ticker)"""
    return f"""al0 AS (SELECT a.ticker AS sa, b.ticker AS sb, a.date AS da, b.date AS db, a.v AS av, b.v AS bv,
                  count(*) OVER (PARTITION BY a.ticker, b.ticker) AS n_overlap
           FROM win a JOIN win b ON a.date = b.date AND a.ticker <> b.ticker),
al AS (SELECT sa, sb, row_number() OVER (PARTITION BY sa, sb ORDER BY da DESC) - 1 AS i,
              da, db, av, bv, n_overlap
       FROM al0 WHERE n_overlap >= {cfg.min_overlap})"""


def stats_cte(cfg: AnalysisConfig) -> str:
    lag_order = "i DESC" if cfg.forward else "i"
    return f"""ols AS (SELECT sa, sb, count(*) AS n,
               min(av) = max(av) AND NOT isnan(min(av)) AS fa,
               CASE WHEN min(bv) = max(bv) AND NOT isnan(min(bv)) THEN NULL
                    WHEN min(av) = max(av) AND NOT isnan(min(av)) THEN 0
                    ELSE regr_slope(av, bv) END AS beta,
               avg(av) AS ma, avg(bv) AS mb,
               CASE WHEN min(av) = max(av) AND NOT isnan(min(av)) THEN 0 ELSE var_pop(av) END AS va,
               CASE WHEN min(bv) = max(bv) AND NOT isnan(min(bv)) THEN 0 ELSE var_pop(bv) END AS vb,
               max(CASE WHEN i = 0 THEN da END) AS d0,
               max(CASE WHEN i = 0 THEN av END) AS a0, max(CASE WHEN i = 0 THEN bv END) AS b0
        FROM al GROUP BY sa, sb),
res AS (SELECT al.sa, al.sb, al.i,
               CASE WHEN o.fa AND o.beta IS NOT NULL THEN 0 ELSE al.av - (o.ma - o.beta * o.mb) - o.beta * al.bv END AS r
        FROM al JOIN ols o ON al.sa = o.sa AND al.sb = o.sb),
lg AS (SELECT sa, sb, i, r, lag(r) OVER (PARTITION BY sa, sb ORDER BY {lag_order}) AS x FROM res),
adf AS (SELECT sa, sb, CAST(regr_count(r - x, x) AS BIGINT) AS m, regr_sxx(r - x, x) AS sxx,
               regr_sxy(r - x, x) AS sxy, regr_syy(r - x, x) AS syy, var_pop(r) AS vr,
               max(CASE WHEN i = 0 THEN r END) AS r0
        FROM lg GROUP BY sa, sb),
g AS (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx END AS gam FROM adf),
vg AS (SELECT *, CASE WHEN sxx > 0 AND m > 2 AND syy - gam * sxy >= 0
                      THEN (syy - gam * sxy) / (m - 2) / sxx END AS var_g FROM g),
st AS (SELECT o.sa AS stock_a, o.sb AS stock_b, o.d0 AS date, o.a0 AS close_a, o.b0 AS close_b,
              o.n AS n_obs, o.ma, o.mb, o.ma - o.beta * o.mb AS alpha, o.beta, o.va, o.vb, v.vr, v.r0,
              v.m AS adf_m, CASE WHEN v.var_g > 0 THEN v.gam / sqrt(v.var_g) END AS adf_t
       FROM ols o JOIN vg v ON o.sa = v.sa AND o.sb = v.sb)"""


def verdict_cte(cfg: AnalysisConfig) -> str:
    sd = "va + beta * beta * vb" if cfg.spread == "cross" else "vr"
    return f"""cr AS (SELECT st.*, {critical_value_sql(cfg.crit_level, 'adf_m')} AS crit_value FROM st),
sp AS (SELECT cr.*, ma - beta * mb - alpha AS signal_mean,
              CASE WHEN beta IS NOT NULL THEN sqrt({sd}) END AS signal_sd FROM cr),
zz AS (SELECT sp.*, CASE WHEN signal_sd <> 0 THEN (r0 - signal_mean) / signal_sd END AS z_score FROM sp),
ver AS (SELECT zz.*,
               coalesce(adf_t < crit_value AND NOT isnan(adf_t), false) AS cointegrated,
               CASE WHEN coalesce(adf_t < crit_value AND NOT isnan(adf_t), false) THEN
                      CASE WHEN coalesce(abs(z_score) > {cfg.z_thresh} AND NOT isnan(z_score), false)
                           THEN 'tradeable' ELSE 'cointegrated' END
                    ELSE 'not_cointegrated' END AS verdict
        FROM zz)"""


def pipeline(cfg: AnalysisConfig, upto: str = "ver") -> str:
    parts = [bars_cte(cfg.series == "walk", cfg.walk_offset), window_cte(cfg)]
    if upto in ("al", "st", "ver", "res"):
        parts.append(aligned_cte(cfg))
    if upto in ("st", "ver", "res"):
        parts.append(stats_cte(cfg))
    if upto == "ver":
        parts.append(verdict_cte(cfg))
    return "WITH " + ",\n".join(parts) + "\n"


VERDICT_SELECT = ("stock_a, stock_b, date, " + r6("close_a", "close_a") + ", " + r6("close_b", "close_b")
                  + ", n_obs, " + r6("alpha", "alpha") + ", " + r6("beta", "beta") + ", "
                  + r6("adf_t", "adf_t") + ", " + r6("crit_value", "crit_value") + ", "
                  + r6("signal_mean", "signal_mean") + ", " + r6("signal_sd", "signal_sd") + ", "
                  + r6("z_score", "z_score") + ", verdict")

ANALYSIS_SELECT = ("stock_a, stock_b, date, " + r6("close_a", "close_a") + ", " + r6("close_b", "close_b")
                   + ", " + r6("z_score", "z_score") + ", " + r6("beta", "beta") + ", "
                   + r6("signal_mean", "signal_mean") + ", " + r6("signal_sd", "signal_sd"))

SIGNAL_SELECT = ("stock_a || '_' || stock_b AS key, " + ANALYSIS_SELECT
                 + ", CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,"
                   " CAST(day(date) AS INTEGER) AS day")

BAR_SELECT = ("ticker, date, " + ", ".join(r6(c, c) for c in ("open", "high", "low", "close", "volume")))

DOCS_CTE = """docs AS (
  SELECT ticker || '_' || strftime(date, '%Y-%m-%d') AS key,
         to_json(struct_pack(OPEN := open, HIGH := high, LOW := low, CLOSE := close, VOLUME := volume,
                             DATE := strftime(date, '%Y-%m-%d'), TICKER := ticker)) AS doc,
         ticker AS ticker_bin, CAST(year(date) AS INTEGER) AS year_int,
         CAST(month(date) AS INTEGER) AS month_int, CAST(day(date) AS INTEGER) AS day_int
  FROM bars)"""


def _d(d) -> str:
    return f"DATE '{d.isoformat()}'"


def build() -> dict[str, str]:
    S, F_ = C.STATS, C.FILTER
    plain = "WITH " + bars_cte() + "\n"
    refresh_from = C.AS_OF.date() - __import__("datetime").timedelta(days=C.OVERLAP_DAYS)
    q: dict[str, str] = {}
    q["universe_scan"] = ("SELECT CAST(s_suppkey AS BIGINT) AS pos, CAST(s_suppkey AS VARCHAR) AS ticker, "
                          "s_name AS name FROM supplier")
    q["universe_first_n"] = q["universe_scan"] + f" ORDER BY pos LIMIT {C.FIRST_N}"
    q["bars_scan_range"] = (plain + f"SELECT {BAR_SELECT} FROM bars WHERE date BETWEEN {_d(C.RANGE_START)} "
                            f"AND {_d(C.RANGE_END)} AND ticker IN {UNIVERSE}")
    q["series_profile"] = (plain + "SELECT ticker, count(*) AS n_bars, " + r6("avg(volume)", "mean_volume")
                           + " FROM bars GROUP BY ticker")
    q["filter_min_history"] = (plain + "SELECT ticker, count(*) AS n_bars FROM bars GROUP BY ticker "
                               f"HAVING count(*) > {F_.min_days}")
    q["filter_min_volume"] = (plain + "SELECT ticker, " + r6("avg(volume)", "mean_volume")
                              + f" FROM bars GROUP BY ticker HAVING avg(volume) > {F_.min_mean_volume} "
                                "AND NOT isnan(avg(volume))")
    q["series_ranked"] = (plain + "SELECT ticker, date, " + r6("close", "close")
                          + ", row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rk FROM bars")
    q["series_trimmed"] = (pipeline(F_, "win") + "SELECT ticker, date, " + r6("close", "close") + ", "
                           + r6("volume", "volume") + f", rk FROM ranked WHERE rk <= {F_.trim}")
    q["analysis_window"] = (pipeline(C.WINDOW_OFFSET, "win") + "SELECT ticker, i, date, "
                            + r6("v", "close") + ", " + r6("volume", "volume") + " FROM win")
    q["series_latest"] = (plain + "SELECT ticker, max(date) AS date, " + r6("arg_max(close, date)", "close")
                          + " FROM bars GROUP BY ticker")
    q["pairs_all"] = (pipeline(S, "win") + "SELECT a.ticker AS stock_a, b.ticker AS stock_b "
                      "FROM elig a JOIN elig b ON a.ticker <> b.ticker")
    chosen = " WHERE (sa, sb) IN (SELECT (stock_a, stock_b) FROM ver WHERE verdict = 'tradeable')"
    q["pairs_aligned_rank"] = (pipeline(S) + "SELECT sa AS stock_a, sb AS stock_b, i, da AS date_a, "
                               "db AS date_b, " + r6("av", "close_a") + ", " + r6("bv", "close_b") + " FROM al" + chosen)
    D = C.DATE_ALIGNED
    q["pairs_aligned_date"] = (pipeline(D) + "SELECT sa AS stock_a, sb AS stock_b, da AS date, "
                               + r6("av", "close_a") + ", " + r6("bv", "close_b") + ", n_overlap FROM al" + chosen)
    q["pair_ols"] = pipeline(S, "st") + "SELECT stock_a, stock_b, " + r6("alpha", "alpha") + ", " \
        + r6("beta", "beta") + " FROM st"
    # Chosen pairs first, then their residuals: no plan may form those of all pairs.
    kept = pipeline(S)
    for name in ("al", "ols", "ver"):
        kept = kept.replace(f"{name} AS (SELECT", f"{name} AS MATERIALIZED (SELECT", 1)
    resid = ("CASE WHEN o.fa AND o.beta IS NOT NULL THEN 0 ELSE al.av - (o.ma - o.beta * o.mb) - o.beta * al.bv END")
    q["pair_residuals"] = (kept + "SELECT t.stock_a, t.stock_b, al.i, " + r6(resid, "resid")
                           + " FROM (SELECT stock_a, stock_b FROM ver WHERE verdict = 'tradeable') t"
                             " JOIN ols o ON o.sa = t.stock_a AND o.sb = t.stock_b"
                             " JOIN al ON al.sa = t.stock_a AND al.sb = t.stock_b")
    q["pair_adf_t"] = pipeline(S, "st") + "SELECT stock_a, stock_b, adf_m, " + r6("adf_t", "adf_t") + " FROM st"
    q["adf_critical_values"] = (pipeline(D, "st") + "SELECT stock_a, stock_b, adf_m, "
                                + r6(critical_value_sql("1%", "adf_m"), "crit_1pct") + ", "
                                + r6(critical_value_sql("5%", "adf_m"), "crit_5pct") + ", "
                                + r6(critical_value_sql("10%", "adf_m"), "crit_10pct") + " FROM st")
    W = C.WALK_ALIGNED
    q["pair_cointegration"] = (pipeline(W) + "SELECT stock_a, stock_b, " + r6("alpha", "alpha") + ", "
                               + r6("beta", "beta") + ", " + r6("adf_t", "adf_t") + ", "
                               + r6("crit_value", "crit_value") + ", cointegrated FROM ver")
    q["pair_spread_cross"] = (pipeline(S) + "SELECT stock_a, stock_b, " + r6("signal_mean", "signal_mean")
                              + ", " + r6("signal_sd", "signal_sd") + " FROM ver")
    q["pair_spread_aligned"] = (pipeline(S.with_(spread="aligned")) + "SELECT stock_a, stock_b, "
                                + r6("signal_mean", "signal_mean") + ", " + r6("signal_sd", "signal_sd")
                                + " FROM ver")
    q["pair_zscore"] = pipeline(S) + "SELECT stock_a, stock_b, " + r6("z_score", "z_score") + " FROM ver"
    q["pair_verdicts"] = pipeline(S) + f"SELECT {VERDICT_SELECT} FROM ver"
    q["pair_verdicts_walk"] = pipeline(C.WALK_CROSS) + f"SELECT {VERDICT_SELECT} FROM ver"
    q["pair_verdicts_walk_aligned"] = pipeline(W) + f"SELECT {VERDICT_SELECT} FROM ver"
    q["pair_verdicts_date"] = pipeline(D) + f"SELECT {VERDICT_SELECT} FROM ver"
    price = " ".join(f"WHEN {n} THEN {p}" for n, p in C.PEGGED.items())
    q["pair_verdicts_pegged"] = pipeline(S).replace("bars AS (SELECT * FROM bars_raw)", f"""bars AS (
  SELECT b.ticker, date, open, high, low, coalesce(CASE s_nationkey {price} END, close) AS close, volume
  FROM bars_raw b LEFT JOIN supplier ON b.ticker = CAST(s_suppkey AS VARCHAR))""") + f"SELECT {VERDICT_SELECT} FROM ver"
    q["pairs_tradeable"] = pipeline(S) + f"SELECT {VERDICT_SELECT} FROM ver WHERE verdict = 'tradeable'"
    q["pair_analysis"] = pipeline(S) + f"SELECT {ANALYSIS_SELECT} FROM ver WHERE verdict = 'tradeable'"
    q["pair_analysis_walk"] = (pipeline(C.WALK_CROSS)
                               + f"SELECT {ANALYSIS_SELECT} FROM ver WHERE verdict = 'tradeable'")
    q["signals_table"] = pipeline(S) + f"SELECT {SIGNAL_SELECT} FROM ver WHERE verdict = 'tradeable'"
    q["signals_write_tradeable"] = q["signals_table"]
    q["signals_search"] = (f"SELECT * FROM ({q['signals_table']}) WHERE stock_a = '{C.SEARCH_STOCK}' "
                           f"AND year = {C.SEARCH_SIGNAL_YEAR}")
    q["kv_scan_all"] = "SELECT CAST(event_id AS VARCHAR) AS key, props AS value FROM events"
    q["kv_get"] = q["kv_get_stored"] = (f"SELECT CAST(event_id AS VARCHAR) AS key, CAST(props->>'k' AS BIGINT) AS k FROM events "
                   f"WHERE CAST(event_id AS VARCHAR) = '{C.ONE_KEY}'")
    q["kv_upsert"] = ("SELECT CAST(user_id AS VARCHAR) AS key, "
                      "arg_max(props, struct_pack(t := ts, e := event_id)) AS value FROM events GROUP BY user_id")
    dele = f"(SELECT event_id FROM events WHERE event_type = '{C.DELETE_EVENT_TYPE}')"
    q["kv_delete"] = ("SELECT CAST(event_id AS VARCHAR) AS key, props AS value FROM events "
                      f"WHERE event_id NOT IN {dele}")
    q["kv_delete_confirm"] = ("SELECT CAST(event_id AS VARCHAR) AS key, CASE WHEN coalesce(bool_or(ts < TIMESTAMP "
                              f"'{C.DELETE_BEFORE.isoformat(sep=' ')}'), false) THEN 'deleted' ELSE 'failed' END AS status "
                              f"FROM events WHERE event_type = '{C.DELETE_EVENT_TYPE}' GROUP BY event_id")
    q["kv_delete_all"] = "SELECT CAST(event_id AS VARCHAR) AS key FROM events"
    q["kv_truncate"] = "SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n_after FROM events"
    q["bars_documents"] = plain.rstrip() + ",\n" + DOCS_CTE + "\nSELECT * FROM docs"
    q["index_search_eq"] = (plain.rstrip() + ",\n" + DOCS_CTE
                            + f"\nSELECT key, doc FROM docs WHERE year_int = {C.SEARCH_YEAR}")
    lo, hi = C.SEARCH_MONTHS
    q["index_search_range"] = (plain.rstrip() + ",\n" + DOCS_CTE
                               + f"\nSELECT key, doc FROM docs WHERE month_int BETWEEN {lo} AND {hi}")
    q["scalar_calendar_key"] = (plain + "SELECT ticker || '_' || strftime(date, '%Y-%m-%d') AS key, "
                                "strftime(date, '%Y-%m-%d') AS date_iso, CAST(year(date) AS INTEGER) AS year, "
                                "CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, "
                                "make_date(CAST(year(date) AS INTEGER), CAST(month(date) AS INTEGER), "
                                "CAST(day(date) AS INTEGER)) AS date_rebuilt, "
                                f"CAST(date - INTERVAL {C.OVERLAP_DAYS} DAY AS DATE) AS date_minus_overlap "
                                "FROM bars")
    late = f"date >= {_d(refresh_from)}"
    raised = f"SELECT * REPLACE (close + CASE WHEN {late} THEN 1 ELSE 0 END AS close) FROM bars"
    q["bars_upsert"] = (plain + f"SELECT {BAR_SELECT}, CASE WHEN {late} THEN 2 ELSE 1 END::INTEGER AS batch "
                        f"FROM ({raised}) WHERE ticker IN {UNIVERSE}")
    q["bars_load_one_ticker"] = (plain + f"SELECT '{C.ONE_TICKER}' AS ticker, "
                                 f"(SELECT count(*) FROM bars WHERE ticker = '{C.ONE_TICKER}') AS n_rows")
    q["load_report"] = q["load_report_whole"] = (plain + "SELECT u.ticker, coalesce(c.n, 0) AS n_rows, "
                              "CASE WHEN coalesce(c.n, 0) > 0 THEN 'added' ELSE 'not_added' END AS status "
                              "FROM (SELECT CAST(s_suppkey AS VARCHAR) AS ticker FROM supplier "
                              "UNION ALL SELECT n_name FROM nation) u "
                              "LEFT JOIN (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker) c "
                              "ON u.ticker = c.ticker")
    broken = f"u.ticker IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey = {C.BROKEN_NATION})"
    q["load_report_files"] = (
        "SELECT ticker, CASE WHEN bad THEN 0 ELSE n_rows END AS n_rows, "
        "CASE WHEN bad THEN 'not_added' ELSE status END AS status, "
        "CASE WHEN bad THEN 'line ' || n_rows || ': close is not a number: ' || chr(39) || 'n/a' || chr(39) "
        "WHEN status = 'not_added' THEN 'no file' END AS reason "
        f"FROM (SELECT u.*, n_rows > 0 AND {broken} AS bad FROM ({q['load_report']}) u)")
    q["series_scan"] = q["series_scan_whole"] = (plain + "SELECT ticker, " + r6("close", "close") + ", " + r6("volume", "volume")
                              + f", date FROM bars WHERE ticker IN {UNIVERSE}")
    q["full_load_counts"] = q["full_load_counts_whole"] = (plain + f"SELECT ticker, count(*) AS n_rows FROM bars WHERE ticker IN {UNIVERSE} "
                                   "GROUP BY ticker")
    q["watermark_write"] = (plain + "SELECT 'update' AS key, CAST(max(date) AS TIMESTAMP) AS updated_at, "
                            "to_json(struct_pack(Year := CAST(year(max(date)) AS INTEGER), "
                            "Month := CAST(month(max(date)) AS INTEGER), Day := CAST(day(max(date)) AS INTEGER), "
                            "Hour := 0, Minute := 0)) AS value "
                            f"FROM bars WHERE ticker IN {UNIVERSE}")
    q["incremental_refresh"] = (plain + f"SELECT {BAR_SELECT} FROM bars WHERE date >= {_d(refresh_from)} "
                                f"AND ticker IN {UNIVERSE}")
    # The stored closes before the refresh, the corrected ones from its first day on.
    q["nightly_pipeline"] = q["signals_table"].replace(
        "bars AS (SELECT * FROM bars_raw)",
        f"bars AS ({raised.replace('FROM bars', 'FROM bars_raw')} WHERE ticker IN {UNIVERSE})")
    in_store = f"bars AS ({raised.replace('FROM bars', 'FROM bars_raw')} WHERE ticker IN {UNIVERSE})"
    whole = "bars AS (SELECT * FROM bars_raw)"
    q["stored_profile"] = q["series_profile"].replace("FROM bars GROUP", f"FROM bars WHERE ticker IN {UNIVERSE} GROUP")
    q["windows_stream"] = (plain + "SELECT ticker, rk, date, " + r6("close", "close") + ", " + r6("volume", "volume")
                           + f" FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rk "
                             f"FROM ({raised}) WHERE ticker IN {UNIVERSE}) WHERE rk <= {S.trim}")
    q["stored_window"] = q["analysis_window"].replace(whole, in_store)
    q["stored_series_signals"] = " UNION ALL ".join(
        f"SELECT *, '{name}' AS analysis FROM ({pipeline(c).replace(whole, in_store)} SELECT {SIGNAL_SELECT} "
        "FROM ver WHERE verdict = 'tradeable')" for name, c in (("cross", S), ("aligned", C.SHARED)))
    some = ("(SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey IN "
            f"({', '.join(map(str, C.CORRECTED_NATIONS))}))")
    q["signals_refreshed"] = q["signals_table"].replace(
        whole, f"bars AS (SELECT * REPLACE (close + CASE WHEN {late} AND ticker IN {some} THEN 1 ELSE 0 END AS close) "
               f"FROM bars_raw WHERE ticker IN {UNIVERSE})")
    q["incremental_refresh_stream"] = plain + f"SELECT {BAR_SELECT} FROM ({raised}) WHERE ticker IN {UNIVERSE}"
    return q


ORACLE_SQL: dict[str, str] = build()
