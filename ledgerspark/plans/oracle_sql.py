"""DuckDB SQL for the correctness gate: one statement per registered query,
over the driver's pre-registered tables. Written from the op definitions,
independently of the Spark code. Money is summed as bigint cents and
divided once, standard deviations are compared at 4 places, quotients are
left unrounded (the engines round ties differently)."""

from __future__ import annotations

from .. import schemas as S
from .. import texts as TX
from ..sources.adapters import EVENT_CATEGORY, EVENTS_AS_OF, LINEITEM_AS_OF

_CATS = "[" + ", ".join(f"'{c}'" for c in S.CATEGORIES) + "]"
_EV_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_CATEGORY) + " ELSE 'Other' END"

LI = f"""
txn AS (
  SELECT o.o_custkey AS user_id, CAST(l.l_shipdate AS DATE) AS date, l.l_extendedprice AS amount,
         list_extract({_CATS}, CAST(l.l_partkey % 16 AS INTEGER) + 1) AS category,
         s.s_name AS merchant, CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents,
         CAST(date_trunc('month', CAST(l.l_shipdate AS DATE)) AS DATE) AS ym
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey),
users AS (
  SELECT c_custkey AS user_id, CAST(60000.0 AS DOUBLE) + CAST(3.0 AS DOUBLE) * c_acctbal AS monthly_income
  FROM customer)"""

EV = f"""
txn AS (
  SELECT event_id AS id, user_id, CAST(ts AS DATE) AS date, value AS amount, {_EV_CASE} AS category,
         'M' || json_extract_string(props, '$.k') AS merchant, CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(date_trunc('month', CAST(ts AS DATE)) AS DATE) AS ym
  FROM events),
users AS (
  SELECT DISTINCT user_id, CAST(3000 + 10 * (user_id % 150) AS DOUBLE) AS monthly_income FROM events)"""

LI_Y, LI_M = LINEITEM_AS_OF.year, LINEITEM_AS_OF.month
LI_M0 = f"DATE '{LI_Y}-{LI_M:02d}-01'"
LI_M1 = "DATE '2001-07-01'"
EV_M0 = "DATE '2024-01-01'"


def _money(c="cents"):
    return f"(CAST(SUM({c}) AS DOUBLE) / 100.0)"


def _after(days: int, as_of) -> str:
    return f"date > DATE '{as_of}' - INTERVAL {days} DAY"


def _monthly(src: str) -> str:
    # D4 + D5 + D6 + E1-E4 over one adapter; `src` is LI or EV
    ratios = ",\n".join(
        f"    CAST(SUM(CASE WHEN category = '{c}' THEN cents ELSE 0 END) AS DOUBLE) / CAST(SUM(cents) AS DOUBLE) AS {S.ratio_column(c)}"
        for c in S.CATEGORIES
    )
    return f"""WITH {src},
m AS (
  SELECT user_id, ym AS year_month, SUM(cents) AS total_cents, {_money()} AS total_spending,
    COUNT(*) AS transaction_count, {_money()} / COUNT(*) AS avg_transaction,
    MAX(amount) AS max_transaction, stddev_samp(amount) AS std_transaction,
    COUNT(DISTINCT category) AS unique_categories, COUNT(DISTINCT merchant) AS unique_merchants,
{ratios}
  FROM txn GROUP BY user_id, ym),
f AS (
  SELECT m.*, u.monthly_income, m.total_spending / u.monthly_income AS spending_to_income,
    CAST(CASE WHEN m.total_spending > u.monthly_income * CAST(0.9 AS DOUBLE) THEN 1 ELSE 0 END AS BIGINT) AS is_overspend,
    lag(m.total_spending, 1) OVER w AS prev_month_spending,
    m.total_spending / lag(m.total_spending, 1) OVER w - 1.0 AS spending_change,
    (CAST(SUM(m.total_cents) OVER w3 AS DOUBLE) / 100.0) / COUNT(*) OVER w3 AS rolling_3m_avg,
    COALESCE(stddev_samp(m.total_spending) OVER w3, 0.0) AS rolling_3m_std
  FROM m JOIN users u USING (user_id)
  WINDOW w AS (PARTITION BY user_id ORDER BY year_month),
         w3 AS (PARTITION BY user_id ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


def _daily(src: str) -> str:
    parts = []
    for k in S.FORECAST_WINDOWS:
        frame = f"(PARTITION BY user_id ORDER BY ds ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"(CAST(SUM(y_cents) OVER {frame} AS DOUBLE) / 100.0) / COUNT(*) OVER {frame} AS rolling_mean_{k}")
        parts.append(f"round(COALESCE(stddev_samp(y) OVER {frame}, 0.0), 4) AS rolling_std_{k}")
    for lag in S.FORECAST_LAGS:
        parts.append(f"lag(y, {lag}) OVER (PARTITION BY user_id ORDER BY ds) AS lag_{lag}")
    cols = ",\n    ".join(parts)
    return f"""WITH {src},
d AS (SELECT user_id, date AS ds, SUM(cents) AS y_cents, {_money()} AS y FROM txn GROUP BY user_id, date)
SELECT user_id, ds, y,
    {cols},
    CAST(isodow(ds) - 1 AS BIGINT) AS day_of_week, CAST(dayofmonth(ds) AS BIGINT) AS day_of_month,
    CAST(month(ds) AS BIGINT) AS month
FROM d"""


_THR_VALUES = ", ".join(f"('{c}', CAST({t} AS DOUBLE), {i})" for i, (c, t) in enumerate(S.CATEGORY_THRESHOLDS))


def _j1(src: str, as_of) -> str:
    m0 = f"CAST(date_trunc('month', DATE '{as_of}') AS DATE)"
    return f"""WITH {src},
per AS (SELECT user_id, ym, category, SUM(cents) AS c FROM txn GROUP BY user_id, ym, category),
ch AS (SELECT user_id, COALESCE(MAX(CASE WHEN ym = {m0} THEN ym END), MAX(ym)) AS chosen FROM per GROUP BY user_id),
thr(category, threshold, pos) AS (VALUES {_THR_VALUES}),
j AS (
  SELECT per.user_id, per.category, thr.threshold, thr.pos, u.monthly_income,
         CAST(per.c AS DOUBLE) / 100.0 AS spent, (CAST(per.c AS DOUBLE) / 100.0) / u.monthly_income AS pct
  FROM per JOIN ch ON per.user_id = ch.user_id AND per.ym = ch.chosen
  JOIN thr ON per.category = thr.category JOIN users u ON per.user_id = u.user_id)
SELECT user_id, CAST(1 AS BIGINT) AS rule_no, CAST(pos AS BIGINT) AS pos, 'J1' AS rule_id, 'warning' AS type,
  CASE WHEN pct > threshold * CAST(1.5 AS DOUBLE) THEN 'high' ELSE 'medium' END AS priority,
  least(CAST(0.95 AS DOUBLE), CAST(0.7 AS DOUBLE) + (pct - threshold)) AS confidence,
  category, spent - monthly_income * threshold AS amount
FROM j WHERE pct > threshold"""


def _savings(src: str, as_of) -> str:
    rec = _after(90, as_of)
    return f"""WITH {src},
g AS (
  SELECT user_id,
    SUM(CASE WHEN {rec} THEN cents END) AS rc, COUNT(CASE WHEN {rec} THEN 1 END) AS rn,
    COUNT(DISTINCT CASE WHEN {rec} THEN ym END) AS rm, SUM(cents) AS ac, COUNT(DISTINCT ym) AS am
  FROM txn GROUP BY user_id),
s AS (
  SELECT g.user_id, u.monthly_income, rn > 0 AS used_recent,
    CASE WHEN rn > 0 THEN rm ELSE am END AS n_months,
    (CAST(CASE WHEN rn > 0 THEN rc ELSE ac END AS DOUBLE) / 100.0) / greatest(CASE WHEN rn > 0 THEN rm ELSE am END, 1) AS monthly_avg
  FROM g JOIN users u USING (user_id)),
sp AS (SELECT *, monthly_income - monthly_avg AS savings, (monthly_income - monthly_avg) / monthly_income AS savings_rate FROM s)"""


def _j4(src: str, as_of) -> str:
    return _savings(src, as_of) + f"""
SELECT user_id, CAST(4 AS BIGINT) AS rule_no, CAST(0 AS BIGINT) AS pos, 'J4a' AS rule_id, 'suggestion' AS type, 'low' AS priority,
  CAST(0.8 AS DOUBLE) AS confidence, 'Investments' AS category, savings * CAST(0.5 AS DOUBLE) AS amount
FROM sp WHERE savings_rate > CAST(0.2 AS DOUBLE)
UNION ALL
SELECT user_id, CAST(4 AS BIGINT), CAST(1 AS BIGINT), 'J4b', 'suggestion', 'low', CAST(0.7 AS DOUBLE), CAST(NULL AS VARCHAR),
  monthly_income * CAST(3.0 AS DOUBLE)
FROM sp WHERE savings > 0 AND savings_rate > CAST(0.1 AS DOUBLE)"""


def _anomaly_ctes(src: str) -> str:
    return f"""WITH {src},
st AS (SELECT user_id, category, ({_money()} / COUNT(*)) AS cat_mean, stddev_samp(amount) AS cat_std, COUNT(*) AS cat_count
       FROM txn GROUP BY user_id, category),
fa0 AS (SELECT user_id, category, MIN(date) AS fd FROM txn GROUP BY user_id, category),
fa1 AS (SELECT t.user_id, t.category, fa0.fd, MIN(t.id) AS fid FROM txn t
        JOIN fa0 ON t.user_id = fa0.user_id AND t.category = fa0.category AND t.date = fa0.fd
        GROUP BY t.user_id, t.category, fa0.fd),
fa AS (SELECT user_id, category, row_number() OVER (PARTITION BY user_id ORDER BY fd, fid) AS appearance FROM fa1),
hits AS (
  SELECT t.user_id, t.id, t.date, t.category, t.amount, st.cat_mean, fa.appearance
  FROM txn t JOIN st USING (user_id, category) JOIN fa USING (user_id, category)
  WHERE st.cat_count >= 5 AND st.cat_std <> 0 AND t.amount > st.cat_mean + 3.0 * st.cat_std),
j5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY appearance, date, id) - 1 AS pos FROM hits) WHERE pos < 5)"""


def _j6_ctes(src: str) -> str:
    return f"""WITH {src},
mt AS (SELECT user_id, ym, SUM(cents) AS c FROM txn GROUP BY user_id, ym),
l3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ym DESC) AS k FROM mt) WHERE k <= 3),
g6 AS (SELECT user_id, COUNT(*) AS n, MAX(CASE WHEN k = 3 THEN c END) AS fc, MAX(CASE WHEN k = 2 THEN c END) AS mc,
             MAX(CASE WHEN k = 1 THEN c END) AS lc FROM l3 GROUP BY user_id),
r AS (SELECT user_id, CAST(fc AS DOUBLE) / 100.0 AS first_total, CAST(mc AS DOUBLE) / 100.0 AS mid_total,
             CAST(lc AS DOUBLE) / 100.0 AS last_total, (fc < mc AND mc < lc) AS rising,
             (CAST(lc AS DOUBLE) / 100.0 - CAST(fc AS DOUBLE) / 100.0) / (CAST(fc AS DOUBLE) / 100.0) * 100 AS increase_pct
      FROM g6 WHERE n = 3)"""


def _rules_union(src: str, as_of) -> str:
    """Heuristic-mode rules (risk 0, forecast 0: J2 and J3 never fire)."""
    j1 = _j1(src, as_of).split("\nSELECT ", 1)
    j1_ctes = j1[0][len("WITH "):]
    j1_sel = "SELECT " + j1[1]
    sav = _savings("", as_of).split("WITH ,", 1)[1]
    anom = _anomaly_ctes("").split("WITH ,", 1)[1]
    rise = _j6_ctes("").split("WITH ,", 1)[1]
    return f"""WITH {j1_ctes},
{sav},
{anom},
{rise},
allr AS (
  {j1_sel}
  UNION ALL
  SELECT user_id, CAST(4 AS BIGINT), CAST(0 AS BIGINT), 'J4a', 'suggestion', 'low', CAST(0.8 AS DOUBLE), 'Investments', savings * CAST(0.5 AS DOUBLE)
  FROM sp WHERE savings_rate > CAST(0.2 AS DOUBLE)
  UNION ALL
  SELECT user_id, CAST(4 AS BIGINT), CAST(1 AS BIGINT), 'J4b', 'suggestion', 'low', CAST(0.7 AS DOUBLE), CAST(NULL AS VARCHAR), monthly_income * CAST(3.0 AS DOUBLE)
  FROM sp WHERE savings > 0 AND savings_rate > CAST(0.1 AS DOUBLE)
  UNION ALL
  SELECT user_id, CAST(5 AS BIGINT), CAST(pos AS BIGINT), 'J5', 'alert', 'medium', CAST(0.85 AS DOUBLE), category, amount FROM j5
  UNION ALL
  SELECT user_id, CAST(6 AS BIGINT), CAST(0 AS BIGINT), 'J6', 'warning', 'medium', CAST(0.75 AS DOUBLE), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE)
  FROM r WHERE rising),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
      CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 99 END, rule_no, rule_id, pos) - 1 AS rec_index
  FROM allr)"""


def queries_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # ---------------------------------------------------------- summaries --
    q["d1_month_summary"] = f"""WITH {LI},
agg AS (SELECT user_id, SUM(cents) AS c, COUNT(*) AS n, COUNT(DISTINCT date) AS d FROM txn
        WHERE date >= {LI_M0} AND date < {LI_M1} GROUP BY user_id)
SELECT u.user_id, '{LI_Y}-{LI_M:02d}' AS month, COALESCE(CAST(a.c AS DOUBLE) / 100.0, 0.0) AS total_spending,
  COALESCE(a.n, 0) AS transaction_count, COALESCE(a.d, 0) AS active_days,
  COALESCE((CAST(a.c AS DOUBLE) / 100.0) / greatest(a.d, 1), 0.0) AS daily_average
FROM users u LEFT JOIN agg a USING (user_id)"""

    q["d1_monthly_summaries"] = f"""WITH {LI}
SELECT user_id, strftime(ym, '%Y-%m') AS month, {_money()} AS total_spending, COUNT(*) AS transaction_count,
  COUNT(DISTINCT date) AS active_days, {_money()} / COUNT(DISTINCT date) AS daily_average
FROM txn GROUP BY user_id, ym"""

    q["d2_category_breakdown"] = f"""WITH {LI}
SELECT user_id, category, {_money()} AS total FROM txn
WHERE date >= {LI_M0} AND date < {LI_M1} GROUP BY user_id, category"""

    q["d3_top_merchants"] = f"""WITH {LI},
per AS (SELECT user_id, merchant, SUM(cents) AS c FROM txn
        WHERE date >= {LI_M0} AND date < {LI_M1} AND merchant IS NOT NULL AND merchant <> ''
        GROUP BY user_id, merchant)
SELECT user_id, rank, merchant, CAST(c AS DOUBLE) / 100.0 AS amount FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, merchant) AS rank FROM per) WHERE rank <= 10"""

    q["d14_dataset_profile"] = f"""WITH {LI}
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT category) AS n_categories, COUNT(DISTINCT merchant) AS n_merchants,
  MIN(date) AS min_date, MAX(date) AS max_date FROM txn"""

    q["d14_rows_per_category"] = f"""WITH {LI}
SELECT category, COUNT(*) AS n_rows FROM txn GROUP BY category"""

    q["d17_dashboard_cards"] = f"""WITH {LI},
agg AS (SELECT user_id, SUM(cents) AS c, COUNT(*) AS n, COUNT(DISTINCT date) AS d FROM txn
        WHERE date >= {LI_M0} AND date < {LI_M1} GROUP BY user_id),
s AS (SELECT u.user_id, u.monthly_income, COALESCE(CAST(a.c AS DOUBLE) / 100.0, 0.0) AS total_spending,
        COALESCE(a.n, 0) AS transaction_count,
        COALESCE((CAST(a.c AS DOUBLE) / 100.0) / greatest(a.d, 1), 0.0) AS daily_average
      FROM users u LEFT JOIN agg a USING (user_id))
SELECT user_id, '{LI_Y}-{LI_M:02d}' AS month, total_spending, transaction_count, daily_average, monthly_income,
  (1.0 - total_spending / monthly_income) * 100 AS pct_income_remaining FROM s"""

    q["d18_category_share"] = f"""WITH {LI},
b AS (SELECT user_id, category, CAST(floor({_money()} + 0.5) AS BIGINT) AS value FROM txn
      WHERE date >= {LI_M0} AND date < {LI_M1} GROUP BY user_id, category)
SELECT user_id, category, value, value / SUM(value) OVER (PARTITION BY user_id) * 100 AS share_pct,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, category) AS rank FROM b"""

    q["d19_daily_trend"] = f"""WITH {EV},
page AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, id DESC) AS rn FROM txn) WHERE rn <= 50),
per_day AS (SELECT user_id, date, {_money()} AS total FROM page GROUP BY user_id, date),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS k FROM per_day)
SELECT user_id, date, CAST(floor(total + 0.5) AS BIGINT) AS amount FROM ranked WHERE k <= 30"""

    q["f1_list_page"] = f"""WITH {EV}
SELECT id, user_id, date, amount, category, merchant, CAST(NULL AS VARCHAR) AS description,
  CAST(NULL AS VARCHAR) AS predicted_category, row_no FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, id DESC) AS row_no FROM txn)
WHERE row_no > 10 AND row_no <= 30"""

    q["g2_distinct_values"] = f"""WITH {LI}
SELECT user_id, COUNT(DISTINCT category) AS n_categories, COUNT(DISTINCT ym) AS n_months,
  COUNT(DISTINCT date) AS n_days FROM txn GROUP BY user_id"""

    # ------------------------------------------------------------ filters --
    q["b1_filter_transactions"] = f"""WITH {EV}
SELECT id, user_id, date, amount, category, merchant FROM txn
WHERE category = 'Food' AND date >= DATE '2024-01-08' AND date <= DATE '2024-01-21'"""

    q["b2_by_month"] = f"""WITH {LI}
SELECT user_id, date, amount, category, merchant FROM txn WHERE date >= {LI_M0} AND date < {LI_M1}"""

    q["b3_current_or_latest_month"] = f"""WITH {LI},
ch AS (SELECT user_id, COALESCE(MAX(CASE WHEN ym = {LI_M0} THEN ym END), MAX(ym)) AS chosen_month
       FROM txn GROUP BY user_id)
SELECT t.user_id, t.date, t.amount, t.category, ch.chosen_month
FROM txn t JOIN ch ON t.user_id = ch.user_id AND t.ym = ch.chosen_month"""

    q["b4_recent_or_all"] = f"""WITH {LI},
f AS (SELECT user_id, MAX(CASE WHEN {_after(90, LINEITEM_AS_OF)} THEN 1 ELSE 0 END) AS has_recent FROM txn GROUP BY user_id)
SELECT t.user_id, t.date, t.amount, t.category FROM txn t JOIN f USING (user_id)
WHERE f.has_recent = 0 OR t.{_after(90, LINEITEM_AS_OF)}"""

    q["b5_recent_windows"] = f"""WITH {EV}
SELECT user_id,
  CAST(COALESCE(SUM(CASE WHEN {_after(30, EVENTS_AS_OF)} THEN cents END), 0) AS DOUBLE) / 100.0 AS spend_30d,
  COUNT(CASE WHEN {_after(30, EVENTS_AS_OF)} THEN 1 END) AS rows_30d,
  CAST(COALESCE(SUM(CASE WHEN {_after(7, EVENTS_AS_OF)} THEN cents END), 0) AS DOUBLE) / 100.0 AS spend_7d,
  COUNT(CASE WHEN {_after(7, EVENTS_AS_OF)} THEN 1 END) AS rows_7d
FROM txn GROUP BY user_id"""

    q["b8_null_defaults"] = f"""WITH {EV}
SELECT user_id, id, date, amount, category, COALESCE(NULLIF(merchant, ''), 'Unknown') AS merchant, '' AS description
FROM txn"""

    q["c4_user_transactions"] = f"""WITH {LI}
SELECT t.user_id, t.date, t.amount, t.category, u.monthly_income FROM users u JOIN txn t USING (user_id)"""

    # ---------------------------------------------------------- monthly ----
    q["d4_monthly_features"] = _monthly(LI) + """
SELECT user_id, year_month, total_spending, transaction_count, avg_transaction, max_transaction,
  round(std_transaction, 4) AS std_transaction, unique_categories, unique_merchants FROM m"""

    q["d5_category_ratios"] = _monthly(LI) + "\nSELECT user_id, year_month, " + ", ".join(S.RATIO_COLUMNS) + " FROM m"

    q["d6_income_features"] = _monthly(LI) + """
SELECT user_id, year_month, total_spending, monthly_income, spending_to_income, is_overspend FROM f"""

    q["e1_e4_monthly_windows"] = _monthly(LI) + """
SELECT user_id, year_month, total_spending, prev_month_spending, spending_change, rolling_3m_avg,
  round(rolling_3m_std, 4) AS rolling_3m_std FROM f WHERE prev_month_spending IS NOT NULL"""

    q["e8_latest_month"] = _monthly(LI) + """,
r AS (SELECT * FROM f WHERE prev_month_spending IS NOT NULL)
SELECT user_id, year_month, total_spending, spending_to_income FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY year_month DESC) AS k FROM r) WHERE k = 1"""

    q["h19_risk_bands"] = _monthly(LI) + """,
r AS (SELECT * FROM f WHERE prev_month_spending IS NOT NULL),
l AS (SELECT user_id, least(1.0, spending_to_income) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY year_month DESC) AS k FROM r) WHERE k = 1),
b AS (SELECT user_id, score,
  CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium'
       WHEN score >= 0.3 THEN 'low' ELSE 'low' END AS risk_level,
  CASE WHEN score > 0.7 THEN '#f43f5e' WHEN score > 0.5 THEN '#f59e0b' WHEN score > 0.3 THEN '#3b82f6' ELSE '#10b981' END AS gauge_band,
  CASE WHEN score > 0.7 THEN 'rose' WHEN score > 0.4 THEN 'amber' ELSE 'emerald' END AS score_band FROM l)
SELECT *, CASE risk_level WHEN 'critical' THEN 'Critical Risk' WHEN 'high' THEN 'High Risk'
  WHEN 'medium' THEN 'Moderate Risk' ELSE 'Low Risk' END AS level_text FROM b"""

    # ------------------------------------------------------------ daily ----
    q["d7_daily_totals"] = f"""WITH {EV}
SELECT user_id, date AS ds, {_money()} AS y FROM txn GROUP BY user_id, date"""

    q["d7_daily_totals_global"] = f"""WITH {LI}
SELECT date AS ds, {_money()} AS y FROM txn GROUP BY date"""

    q["e5_e6_daily_features"] = _daily(EV)

    q["e10_chronological_split"] = f"""WITH {EV},
d AS (SELECT user_id, date AS ds FROM txn GROUP BY user_id, date)
SELECT user_id, ds, row_number() OVER (PARTITION BY user_id ORDER BY ds)
   <= greatest(COUNT(*) OVER (PARTITION BY user_id) - 30, CAST(floor(COUNT(*) OVER (PARTITION BY user_id) * 0.8) AS BIGINT)) AS is_train
FROM d"""

    q["i2_transaction_features"] = f"""WITH {EV},
b AS (SELECT id, user_id, date, amount, COALESCE(NULLIF(merchant, ''), 'Unknown') AS merchant FROM txn),
labels AS (SELECT merchant, row_number() OVER (ORDER BY merchant) - 1 AS idx FROM (SELECT DISTINCT merchant FROM b))
SELECT b.id, b.user_id, CAST(isodow(date) - 1 AS BIGINT) AS day_of_week, CAST(dayofmonth(date) AS BIGINT) AS day_of_month,
  CAST(month(date) AS BIGINT) AS month,
  CAST(CASE WHEN isodow(date) - 1 >= 5 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
  CAST(CASE WHEN dayofmonth(date) <= 5 THEN 1 ELSE 0 END AS BIGINT) AS is_month_start,
  CAST(CASE WHEN dayofmonth(date) >= 25 THEN 1 ELSE 0 END AS BIGINT) AS is_month_end,
  CAST(quarter(date) AS BIGINT) AS quarter, CAST(weekofyear(date) AS BIGINT) AS week_of_year,
  round(ln(1 + amount), 6) AS log_amount, amount, CAST(labels.idx AS BIGINT) AS merchant_encoded
FROM b JOIN labels USING (merchant)"""

    # ----------------------------------------------------------- rollups ---
    q["d15_savings_position"] = _savings(EV, EVENTS_AS_OF) + """
SELECT user_id, monthly_income, used_recent, n_months, monthly_avg, savings, savings_rate FROM sp"""

    q["d15_savings_position_lineitem"] = _savings(LI, LINEITEM_AS_OF) + """
SELECT user_id, monthly_income, used_recent, n_months, monthly_avg, savings, savings_rate FROM sp"""

    q["d9_category_stats"] = f"""WITH {LI},
pc AS (SELECT user_id, category, SUM(cents) AS c FROM txn GROUP BY user_id, category),
mo AS (SELECT user_id, COUNT(DISTINCT ym) AS n_months FROM txn GROUP BY user_id),
cm AS (SELECT user_id, category, ym, SUM(cents) AS c FROM txn GROUP BY user_id, category, ym),
l3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY ym DESC) AS k FROM cm) WHERE k <= 3),
tr AS (SELECT user_id, category,
         CASE WHEN COUNT(*) = 3 AND CAST(MAX(CASE WHEN k = 1 THEN c END) AS DOUBLE) / 100.0
                   > (CAST(MAX(CASE WHEN k = 3 THEN c END) AS DOUBLE) / 100.0) * CAST(1.1 AS DOUBLE)
              THEN 'increasing' ELSE 'stable' END AS trend
       FROM l3 GROUP BY user_id, category)
SELECT pc.user_id, pc.category, CAST(pc.c AS DOUBLE) / 100.0 AS total,
  (CAST(pc.c AS DOUBLE) / 100.0) / greatest(mo.n_months, 1) AS monthly_avg,
  ((CAST(pc.c AS DOUBLE) / 100.0) / greatest(mo.n_months, 1)) / u.monthly_income AS pct_of_income, tr.trend
FROM pc JOIN mo USING (user_id) JOIN users u USING (user_id) JOIN tr USING (user_id, category)"""

    q["d16_spending_velocity"] = f"""WITH {EV},
g AS (SELECT user_id,
  SUM(CASE WHEN {_after(30, EVENTS_AS_OF)} THEN cents END) AS c30, COUNT(CASE WHEN {_after(30, EVENTS_AS_OF)} THEN 1 END) AS rows_30d,
  SUM(CASE WHEN {_after(7, EVENTS_AS_OF)} THEN cents END) AS c7, COUNT(CASE WHEN {_after(7, EVENTS_AS_OF)} THEN 1 END) AS rows_7d
  FROM txn GROUP BY user_id),
h AS (SELECT user_id, rows_30d, rows_7d, CAST(COALESCE(c30, 0) AS DOUBLE) / 100.0 AS monthly_rate,
        CAST(COALESCE(c7, 0) AS DOUBLE) / 100.0 * CAST(4.3 AS DOUBLE) AS weekly_rate FROM g)
SELECT *, rows_30d > 0 AND rows_7d > 0 AND weekly_rate > monthly_rate * CAST(1.2 AS DOUBLE) AS accelerating FROM h"""

    q["e7_three_month_rise"] = _j6_ctes(LI) + "\nSELECT * FROM r"

    q["e9_category_trend"] = f"""WITH {LI},
cm AS (SELECT user_id, category, ym, SUM(cents) AS c FROM txn GROUP BY user_id, category, ym),
l3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY ym DESC) AS k FROM cm) WHERE k <= 3)
SELECT user_id, category,
  CASE WHEN COUNT(*) = 3 AND CAST(MAX(CASE WHEN k = 1 THEN c END) AS DOUBLE) / 100.0
            > (CAST(MAX(CASE WHEN k = 3 THEN c END) AS DOUBLE) / 100.0) * CAST(1.1 AS DOUBLE)
       THEN 'increasing' ELSE 'stable' END AS trend
FROM l3 GROUP BY user_id, category"""

    q["e12_group_stats_on_rows"] = f"""WITH {EV},
st AS (SELECT user_id, category, {_money()} / COUNT(*) AS cat_mean, stddev_samp(amount) AS cat_std, COUNT(*) AS cat_count
       FROM txn GROUP BY user_id, category)
SELECT t.id, t.user_id, t.category, t.amount, st.cat_mean, round(st.cat_std, 4) AS cat_std, st.cat_count
FROM txn t JOIN st USING (user_id, category)"""

    q["e13_first_appearance"] = f"""WITH {EV},
f AS (SELECT user_id, category, MIN(date) AS d FROM txn GROUP BY user_id, category),
g AS (SELECT t.user_id, t.category, f.d AS first_date, MIN(t.id) AS first_id FROM txn t JOIN f
      ON t.user_id = f.user_id AND t.category = f.category AND t.date = f.d GROUP BY t.user_id, t.category, f.d)
SELECT user_id, category, first_date, first_id,
  row_number() OVER (PARTITION BY user_id ORDER BY first_date, first_id) AS appearance FROM g"""

    # ------------------------------------------------------------- rules ---
    q["j1_category_overspend"] = _j1(EV, EVENTS_AS_OF)
    q["j1_category_overspend_lineitem"] = _j1(LI, LINEITEM_AS_OF)
    q["j4_savings_rules"] = _j4(LI, LINEITEM_AS_OF)
    q["j5_anomaly"] = _anomaly_ctes(EV) + """
SELECT user_id, CAST(5 AS BIGINT) AS rule_no, CAST(pos AS BIGINT) AS pos, 'J5' AS rule_id, 'alert' AS type, 'medium' AS priority,
  CAST(0.85 AS DOUBLE) AS confidence, category, amount FROM j5"""
    q["j6_rising_trend"] = _j6_ctes(LI) + """
SELECT user_id, CAST(6 AS BIGINT) AS rule_no, CAST(0 AS BIGINT) AS pos, 'J6' AS rule_id, 'warning' AS type, 'medium' AS priority,
  CAST(0.75 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS DOUBLE) AS amount FROM r WHERE rising"""
    q["j7_recommendations"] = _rules_union(EV, EVENTS_AS_OF) + """
SELECT user_id, rec_index, rule_id, type, priority, confidence, category, amount FROM ranked"""
    q["j8_recommendation_summary"] = _rules_union(EV, EVENTS_AS_OF) + """,
cnt AS (SELECT user_id, COUNT(*) AS n, COUNT(CASE WHEN priority = 'high' THEN 1 END) AS h FROM ranked GROUP BY user_id),
summ AS (SELECT u.user_id, COALESCE(cnt.n, 0) AS n_recommendations, COALESCE(cnt.h, 0) AS n_high FROM users u LEFT JOIN cnt USING (user_id))
SELECT user_id, n_recommendations, n_high,
  CASE WHEN n_recommendations = 0 THEN '""" + TX.SUMMARY_HEALTHY + """'
       WHEN n_high >= 3 THEN printf('""" + TX.SUMMARY_CRITICAL + """', n_high)
       WHEN n_high >= 1 THEN printf('""" + TX.SUMMARY_REVIEW + """', n_recommendations, n_high)
       ELSE printf('""" + TX.SUMMARY_SUGGESTIONS + """', n_recommendations)
  END AS summary FROM summ"""
    q["j7_record_rows"] = q["j8_recommendation_summary"].replace("SELECT user_id, n_recommendations, n_high,\n", """,
texts AS (SELECT user_id,
""", 1).replace("AS summary FROM summ", f"""AS summary FROM summ)
SELECT t.user_id, '{EVENTS_AS_OF}T12:00:00' AS generated_at, t.summary, r.rec_index, r.type, r.priority, r.confidence, r.category
FROM texts t LEFT JOIN ranked r USING (user_id)""")
    q.update(metrics_sql())
    q.update(store_sql())
    q.update(more_sql())
    q.update(model_branch_sql())
    q.update(message_sql())
    q.update(reasoning_sql())
    q.update(pairing_sql())
    q.update(registration_sql())
    q.update(replace_sql())
    q.update(factors_sql())
    q.update(impacts_sql())
    return q


def _scored() -> str:
    return _monthly(LI) + """,
sc AS (SELECT is_overspend AS label,
         CAST(CASE WHEN prev_month_spending > monthly_income * CAST(0.9 AS DOUBLE) THEN 1 ELSE 0 END AS BIGINT) AS prediction,
         prev_month_spending / monthly_income AS score
       FROM f WHERE prev_month_spending IS NOT NULL),
cm AS (SELECT label, prediction, COUNT(*) AS n FROM sc GROUP BY label, prediction),
tp AS (SELECT label AS cls, n AS tp FROM cm WHERE label = prediction),
sup AS (SELECT label AS cls, CAST(SUM(n) AS BIGINT) AS support FROM cm GROUP BY label),
pr AS (SELECT prediction AS cls, CAST(SUM(n) AS BIGINT) AS predicted FROM cm GROUP BY prediction),
cl AS (SELECT cls FROM sup UNION SELECT cls FROM pr),
jj AS (SELECT cl.cls, COALESCE(tp.tp, 0) AS tp, COALESCE(sup.support, 0) AS support, COALESCE(pr.predicted, 0) AS predicted
       FROM cl LEFT JOIN tp USING (cls) LEFT JOIN sup USING (cls) LEFT JOIN pr USING (cls)),
kk AS (SELECT cls, tp, support,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM jj),
pc AS (SELECT cls, precision, recall,
         CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
         support, tp FROM kk)"""


def _explain_figs() -> str:
    base = _rules_union(EV, EVENTS_AS_OF)
    r30, r7 = _after(30, EVENTS_AS_OF), _after(7, EVENTS_AS_OF)
    thr_case = "CASE x.category " + " ".join(f"WHEN '{c}' THEN CAST({t} AS DOUBLE)" for c, t in S.CATEGORY_THRESHOLDS) \
        + f" ELSE CAST({S.DEFAULT_CATEGORY_THRESHOLD} AS DOUBLE) END"
    return base + f""",
pc2 AS (SELECT user_id, category, SUM(cents) AS c FROM txn GROUP BY user_id, category),
mo2 AS (SELECT user_id, COUNT(DISTINCT ym) AS n_months, SUM(cents) AS all_c FROM txn GROUP BY user_id),
cm2 AS (SELECT user_id, category, ym, SUM(cents) AS c FROM txn GROUP BY user_id, category, ym),
l32 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY ym DESC) AS k FROM cm2) WHERE k <= 3),
tr2 AS (SELECT user_id, category,
          CASE WHEN COUNT(*) = 3 AND CAST(MAX(CASE WHEN k = 1 THEN c END) AS DOUBLE) / 100.0
                    > (CAST(MAX(CASE WHEN k = 3 THEN c END) AS DOUBLE) / 100.0) * CAST(1.1 AS DOUBLE)
               THEN 'increasing' ELSE 'stable' END AS trend FROM l32 GROUP BY user_id, category),
stats2 AS (SELECT pc2.user_id, pc2.category, (CAST(pc2.c AS DOUBLE) / 100.0) / greatest(mo2.n_months, 1) AS monthly_avg,
             ((CAST(pc2.c AS DOUBLE) / 100.0) / greatest(mo2.n_months, 1)) / u.monthly_income AS pct_of_income, tr2.trend
           FROM pc2 JOIN mo2 USING (user_id) JOIN users u USING (user_id) JOIN tr2 USING (user_id, category)),
inv2 AS (SELECT DISTINCT user_id FROM stats2 WHERE category = 'Investments'),
sall AS (SELECT mo2.user_id, (CAST(mo2.all_c AS DOUBLE) / 100.0) / greatest(mo2.n_months, 1) AS mavg, u.monthly_income AS inc
         FROM mo2 JOIN users u USING (user_id)),
vg AS (SELECT user_id, SUM(CASE WHEN {r30} THEN cents END) AS c30, COUNT(CASE WHEN {r30} THEN 1 END) AS n30,
         SUM(CASE WHEN {r7} THEN cents END) AS c7, COUNT(CASE WHEN {r7} THEN 1 END) AS n7 FROM txn GROUP BY user_id),
vh AS (SELECT user_id, n30 > 0 AND n7 > 0 AND (CAST(COALESCE(c7, 0) AS DOUBLE) / 100.0 * CAST(4.3 AS DOUBLE))
          > (CAST(COALESCE(c30, 0) AS DOUBLE) / 100.0) * CAST(1.2 AS DOUBLE) AS accelerating FROM vg),
x0 AS (SELECT ranked.user_id, ranked.rec_index, ranked.rule_id, ranked.category, u.monthly_income,
         inv2.user_id IS NOT NULL AS has_investments, st.pct_of_income, st.monthly_avg, st.trend,
         sall.inc - sall.mavg AS savings_all, (sall.inc - sall.mavg) / sall.inc AS savings_rate_all, sall.mavg AS mavg_all,
         vh.accelerating, r.first_total, r.last_total, r.increase_pct
       FROM ranked JOIN users u ON ranked.user_id = u.user_id
       LEFT JOIN inv2 ON ranked.user_id = inv2.user_id
       LEFT JOIN stats2 st ON ranked.user_id = st.user_id AND ranked.category = st.category
       LEFT JOIN sall ON ranked.user_id = sall.user_id
       LEFT JOIN vh ON ranked.user_id = vh.user_id
       LEFT JOIN r ON ranked.user_id = r.user_id),
x AS (SELECT *, CASE WHEN rule_id IN ('J2', 'J6') THEN 'risk' WHEN rule_id IN ('J1', 'J5') THEN 'category'
                     WHEN rule_id = 'J4a' AND has_investments THEN 'category' WHEN rule_id = 'J3' THEN 'forecast'
                     WHEN rule_id = 'J4a' THEN 'savings' ELSE 'default' END AS kind FROM x0)
SELECT user_id, rec_index, rule_id, category, kind, monthly_income,
  CASE WHEN kind = 'category' THEN COALESCE(pct_of_income, 0.0) END AS cat_share,
  CASE WHEN kind = 'category' THEN {thr_case} END AS cat_threshold,
  CASE WHEN kind = 'category' THEN COALESCE(monthly_avg, 0.0) END AS cat_monthly_avg,
  CASE WHEN kind = 'category' THEN COALESCE(trend, 'stable') END AS cat_trend,
  CASE WHEN kind = 'category' THEN greatest(0.0, COALESCE(monthly_avg, 0.0) - monthly_income * {thr_case}) END AS cat_reduction,
  CASE WHEN kind = 'savings' THEN savings_all END AS savings,
  CASE WHEN kind = 'savings' THEN savings_rate_all END AS savings_rate,
  CASE WHEN kind = 'savings' THEN mavg_all END AS savings_monthly_avg,
  CASE WHEN kind = 'risk' THEN COALESCE(accelerating, false) END AS accelerating,
  CASE WHEN kind = 'risk' THEN CAST(0.0 AS DOUBLE) END AS risk_probability,
  CASE WHEN kind = 'risk' THEN 0.0 / monthly_income END AS spend_share,
  CASE WHEN kind = 'trend' THEN increase_pct END AS trend_change_pct,
  CASE WHEN kind = 'trend' THEN first_total END AS trend_first,
  CASE WHEN kind = 'trend' THEN last_total END AS trend_last,
  CASE WHEN kind = 'forecast' THEN CAST(0.0 AS DOUBLE) END AS forecast_total,
  CASE WHEN kind = 'forecast' THEN CAST(30 AS BIGINT) END AS forecast_days,
  CASE WHEN kind = 'forecast' THEN 'unknown' END AS forecast_model,
  CASE WHEN kind = 'forecast' THEN CAST(NULL AS DOUBLE) END AS forecast_rmse
FROM x"""


def metrics_sql() -> dict[str, str]:
    q = {}
    q["d10_confusion_matrix"] = _scored() + "\nSELECT label, prediction, n FROM cm"
    q["d10_per_class_metrics"] = _scored() + "\nSELECT cls, precision, recall, f1, support FROM pc"
    q["d10_classification_summary"] = _scored() + "\nSELECT SUM(tp) / SUM(support) AS accuracy, AVG(f1) AS f1_macro FROM pc"
    q["d10_binary_summary"] = _scored() + """,
b AS (SELECT COUNT(*) AS n, COUNT(CASE WHEN label = 1 AND prediction = 1 THEN 1 END) AS tp,
        COUNT(CASE WHEN label = 0 AND prediction = 1 THEN 1 END) AS fp,
        COUNT(CASE WHEN label = 1 AND prediction = 0 THEN 1 END) AS fn,
        COUNT(CASE WHEN label = prediction THEN 1 END) AS correct FROM sc),
b2 AS (SELECT *, correct / n AS accuracy,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM b)
SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM b2"""
    q["d11_auc_rank"] = _scored() + """,
per AS (SELECT score AS s, COUNT(*) AS cnt, COUNT(CASE WHEN label = 1 THEN 1 END) AS pos FROM sc GROUP BY score),
rk AS (SELECT *, COALESCE(SUM(cnt) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per),
g2 AS (SELECT SUM(pos * (2 * before + cnt + 1)) AS rs2, SUM(pos) AS p, SUM(cnt) AS n_all FROM rk)
SELECT CASE WHEN p > 0 AND n_all - p > 0
            THEN CAST(rs2 - p * (p + 1) AS DOUBLE) / CAST(2 * p * (n_all - p) AS DOUBLE) ELSE 0.5 END AS auc FROM g2"""
    q["d12_regression_metrics"] = f"""WITH {EV},
d AS (SELECT user_id, date AS ds, {_money()} AS y FROM txn GROUP BY user_id, date),
p AS (SELECT *, lag(y, 1) OVER (PARTITION BY user_id ORDER BY ds) AS prediction FROM d),
q AS (SELECT * FROM p WHERE prediction IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ds)
          <= greatest(COUNT(*) OVER (PARTITION BY user_id) - 30, CAST(floor(COUNT(*) OVER (PARTITION BY user_id) * 0.8) AS BIGINT)) AS is_train
      FROM q)
SELECT round(sqrt(avg((prediction - y) * (prediction - y))), 6) AS rmse,
  round(avg(abs(prediction - y) / greatest(abs(y), 2.220446049250313e-16)) * 100, 6) AS mape, COUNT(*) AS n
FROM s WHERE NOT is_train"""
    q["d13_balance_summary"] = _scored() + """,
b AS (SELECT COUNT(label) AS n, CAST(COALESCE(SUM(label), 0) AS BIGINT) AS positives FROM sc)
SELECT n, positives, n - positives AS negatives,
  CAST(positives > 0 AS BIGINT) + CAST(n > positives AS BIGINT) AS n_classes,
  CASE WHEN positives > 0 AND n > positives THEN least(positives, n - positives) ELSE 0 END AS minority,
  CASE WHEN n > 0 THEN round(positives / n, 4) ELSE 0.0 END AS positive_rate
FROM b"""
    q["d13_class_balance"] = _scored() + "\nSELECT label, COUNT(*) AS n FROM sc GROUP BY label"
    q["k1_explanation_figures"] = _explain_figs()
    return q


def _raw_li() -> str:
    valid_cats = ", ".join(f"'{c}'" for c in S.CATEGORIES)
    return f"""raw AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS batch_id, o.o_custkey AS user_id, CAST(l.l_shipdate AS DATE) AS date,
         l.l_extendedprice AS amount, list_extract({_CATS}, CAST(l.l_partkey % 16 AS INTEGER) + 1) AS category,
         s.s_name AS merchant
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey),
v AS (
  SELECT *, concat_ws(',',
           CASE WHEN date > DATE '{LINEITEM_AS_OF}' THEN 'future_date' END,
           CASE WHEN amount IS NULL OR amount <= 0 THEN 'amount' END,
           CASE WHEN category IS NULL OR category NOT IN ({valid_cats}) THEN 'category' END,
           CASE WHEN length(merchant) > 255 THEN 'merchant_length' END,
           CASE WHEN user_id IS NULL THEN 'user_id' END) AS errors
  FROM raw),
vv AS (SELECT *, errors = '' AS valid FROM v),
b AS (SELECT batch_id, COUNT(*) AS n, bool_and(valid) AS ok FROM vv GROUP BY batch_id)"""


def store_sql() -> dict[str, str]:
    q = {}
    q["a2_validate_transactions"] = "WITH " + _raw_li() + "\nSELECT batch_id, user_id, date, amount, category, valid, errors FROM vv"
    q["a3_bulk_ingest"] = "WITH " + _raw_li() + """
SELECT vv.batch_id, user_id, date, amount, category, merchant FROM vv JOIN b USING (batch_id)
WHERE b.ok AND b.n BETWEEN 1 AND 1000"""
    q["a3_rejected_batches"] = "WITH " + _raw_li() + """
SELECT vv.batch_id, COUNT(*) AS rows, COUNT(CASE WHEN NOT vv.valid THEN 1 END) AS invalid_rows
FROM vv JOIN b USING (batch_id) WHERE NOT (b.ok AND b.n BETWEEN 1 AND 1000) GROUP BY vv.batch_id"""
    q["a7_purge_users"] = f"""WITH {LI}
SELECT t.user_id, t.date, t.amount, t.category FROM txn t
WHERE t.user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""
    return q


def more_sql() -> dict[str, str]:
    q = {}
    q["b9_fill_feature_nulls"] = _monthly(LI) + """
SELECT user_id, year_month, round(COALESCE(std_transaction, 0), 4) AS std_transaction,
  COALESCE(spending_change, 0) AS spending_change, COALESCE(prev_month_spending, 0) AS prev_month_spending FROM f"""
    q["c1_monthly_join_ratios"] = _monthly(LI) + "\nSELECT user_id, year_month, total_spending, transaction_count, " + \
        ", ".join(S.RATIO_COLUMNS) + " FROM m"
    q["f7_top_three_recs"] = _rules_union(EV, EVENTS_AS_OF) + """
SELECT user_id, rec_index, rule_id, priority, category FROM ranked WHERE rec_index < 3"""
    return q


def model_branch_sql() -> dict[str, str]:
    q = {}
    q["i14_insufficient_history"] = f"""WITH {LI},
d AS (SELECT user_id, COUNT(DISTINCT date) AS n_days FROM txn GROUP BY user_id)
SELECT user_id, 'Insufficient Data' AS model_used, CAST(0.0 AS DOUBLE) AS total_predicted,
  CAST(30 AS BIGINT) AS forecast_days, CAST(0.0 AS DOUBLE) AS rmse, CAST(0.0 AS DOUBLE) AS mape
FROM d WHERE n_days < 8"""
    q["a1_a9_csv_roundtrip"] = f"""WITH {EV}
SELECT 'upload' AS batch_id, CAST(NULL AS VARCHAR) AS user_id, date, amount, category,
  NULLIF(merchant, '') AS merchant, CAST(NULL AS VARCHAR) AS description FROM txn"""
    return q


def _tpl(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _num(x: str) -> str:
    return f"format('{{:,.0f}}', {x})"


def _plain(x: str) -> str:
    return f"format('{{:.0f}}', {x})"


def _pct(x: str) -> str:
    return f"(format('{{:.0f}}', ({x}) * 100) || '%')"


def _message_selects(with_anomaly: bool) -> list[str]:
    parts = [
        f"""SELECT user_id, 'J1' AS rule_id, CAST(pos AS BIGINT) AS pos,
  printf({_tpl(TX.CATEGORY_OVERSPEND)}, lower(category), {_num('spent - monthly_income * threshold')},
         {_pct('pct')}, {_pct('threshold')}) AS message FROM j WHERE pct > threshold""",
        f"""SELECT user_id, 'J4a', CAST(0 AS BIGINT),
  printf({_tpl(TX.INVEST)}, {_num('savings * CAST(0.5 AS DOUBLE)')}, {_pct('savings_rate')}, {_num('savings')})
FROM sp WHERE savings_rate > CAST(0.2 AS DOUBLE)""",
        f"""SELECT user_id, 'J4b', CAST(1 AS BIGINT),
  printf({_tpl(TX.EMERGENCY_FUND)}, {_num('monthly_income * CAST(3.0 AS DOUBLE)')}, 3)
FROM sp WHERE savings > 0 AND savings_rate > CAST(0.1 AS DOUBLE)""",
        f"""SELECT user_id, 'J6', CAST(0 AS BIGINT), printf({_tpl(TX.RISING_TREND)}, {_plain('increase_pct')})
FROM r WHERE rising""",
    ]
    if with_anomaly:
        parts.append(
            f"""SELECT user_id, 'J5', CAST(pos AS BIGINT),
  printf({_tpl(TX.ANOMALY)}, lower(category), {_num('amount')}, strftime(date, '%Y-%m-%d'), {_num('cat_mean')})
FROM j5""")
    return parts


def message_sql() -> dict[str, str]:
    q = {}
    q["j_messages"] = _rules_union(EV, EVENTS_AS_OF) + "\n" + "\nUNION ALL\n".join(_message_selects(True))
    j1 = _j1(LI, LINEITEM_AS_OF).split("\nSELECT ", 1)[0]
    sav = _savings("", LINEITEM_AS_OF).split("WITH ,", 1)[1]
    rise = _j6_ctes("").split("WITH ,", 1)[1]
    q["j_messages_lineitem"] = f"{j1},\n{sav},\n{rise}\n" + "\nUNION ALL\n".join(_message_selects(False))
    return q


def reasoning_sql() -> dict[str, str]:
    inc = "monthly_income"
    reason = f"""CASE kind
  WHEN 'risk' THEN printf({_tpl(TX.RISK_REASONING)}, {_pct('risk_probability')}, {_num(f'spend_share * {inc}')},
       {_num(inc)}, CASE WHEN accelerating THEN {_tpl(TX.RISK_VELOCITY_CLAUSE)} ELSE '' END)
  WHEN 'category' THEN printf({_tpl(TX.CATEGORY_REASONING)}, lower(category), {_pct('cat_share')}, {_pct('cat_threshold')},
       {_num('cat_monthly_avg')}, CASE WHEN cat_trend = 'increasing' THEN {_tpl(TX.CATEGORY_TREND_CLAUSE)} ELSE '' END,
       {_num('cat_reduction')})
  WHEN 'forecast' THEN printf({_tpl(TX.FORECAST_REASONING)}, forecast_model, {_num('forecast_total')}, forecast_days,
       CASE WHEN forecast_total > {inc} * CAST(0.8 AS DOUBLE) THEN {_tpl(TX.FORECAST_PRESSURE)}
            ELSE {_tpl(TX.FORECAST_MANAGEABLE)} END)
  WHEN 'savings' THEN printf({_tpl(TX.SAVINGS_REASONING)}, {_num('savings_monthly_avg')}, {_num('savings')},
       {_pct('savings_rate')})
  WHEN 'anomaly' THEN printf({_tpl(TX.ANOMALY_REASONING)}, COALESCE(category, 'this'))
  WHEN 'trend' THEN CASE WHEN trend_first IS NOT NULL THEN printf({_tpl(TX.TREND_REASONING)}, {_plain('trend_change_pct')},
       {_num('trend_first')}, {_num('trend_last')}) ELSE '' END
  ELSE {_tpl(TX.DEFAULT_REASONING)} END"""
    return {"k_reasoning": f"SELECT user_id, rec_index, kind, {reason} AS reasoning FROM ({_explain_figs()}) AS f"}


def pairing_sql() -> dict[str, str]:
    recs = _rules_union(EV, EVENTS_AS_OF) + ",\nmsg AS (\n" + "\nUNION ALL\n".join(_message_selects(True)) + """
)
SELECT ranked.user_id, ranked.rec_index, ranked.rule_id, ranked.priority, msg.message
FROM ranked JOIN msg ON ranked.user_id = msg.user_id AND ranked.rule_id = msg.rule_id AND ranked.pos = msg.pos"""
    reasons = reasoning_sql()["k_reasoning"]
    return {"c7_rec_with_explanation": f"""SELECT a.user_id, a.rec_index, a.rule_id, a.priority, a.message, b.kind, b.reasoning
FROM ({recs}) AS a LEFT JOIN ({reasons}) AS b ON a.user_id = b.user_id AND a.rec_index = b.rec_index"""}


def registration_sql() -> dict[str, str]:
    return {"a8_register_users": f"""WITH
ex AS (SELECT DISTINCT user_id, 'user' || CAST(user_id AS VARCHAR) || '@example.com' AS email,
         CAST(NULL AS VARCHAR) AS full_name, CAST(3000 + 10 * (user_id % 150) AS DOUBLE) AS monthly_income,
         'INR' AS currency
       FROM events),
b AS (SELECT lower(replace(c_name, '#', '.')) || '@example.com' AS email, c_name AS full_name,
        CAST(60000.0 AS DOUBLE) + CAST(3.0 AS DOUBLE) * c_acctbal AS monthly_income, c_custkey AS seq FROM customer),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY seq) AS k FROM b)
           WHERE k = 1),
fresh AS (SELECT * FROM firsts WHERE email NOT IN (SELECT email FROM ex)
          AND monthly_income > 0),
base AS (SELECT COALESCE(MAX(user_id), 0) AS m FROM ex)
SELECT user_id, email, full_name, monthly_income, currency FROM ex
UNION ALL
SELECT CAST(base.m + row_number() OVER (ORDER BY seq) AS BIGINT), email, full_name, monthly_income, 'INR'
FROM fresh, base"""}


def replace_sql() -> dict[str, str]:
    li = LI.replace("txn AS (", "old AS (", 1).split("\nusers AS (")[0].rstrip().rstrip(",")
    ev = EV.replace("txn AS (", "new AS (", 1).split("\nusers AS (")[0].rstrip().rstrip(",")
    return {"a6_replace_user_rows": f"""WITH {li},
{ev}
SELECT user_id, date, amount, category, merchant FROM old
WHERE user_id NOT IN (SELECT DISTINCT user_id FROM new)
UNION ALL
SELECT user_id, date, amount, category, merchant FROM new"""}


def factors_sql() -> dict[str, str]:
    def row(kind, pos, text, cond="TRUE"):
        return (f"SELECT user_id, rec_index, kind, CAST({pos} AS BIGINT) AS pos, {text} AS factor FROM f "
                f"WHERE kind = '{kind}' AND ({cond})")

    acc = "COALESCE(accelerating, false)"
    rows = [
        row("risk", 0, _tpl(TX.RISK_VELOCITY_FACTOR), acc),
        row("risk", f"CASE WHEN {acc} THEN 1 ELSE 0 END", f"printf({_tpl(TX.RISK_SHARE_FACTOR)}, {_pct('spend_share')})"),
        row("risk", f"CASE WHEN {acc} THEN 2 ELSE 1 END",
            f"printf({_tpl(TX.RISK_MODEL_FACTOR)}, {_pct('risk_probability')})"),
        row("category", 0, f"printf({_tpl(TX.CATEGORY_SHARE_FACTOR)}, lower(category), {_pct('cat_share')})"),
        row("category", 1, f"printf({_tpl(TX.CATEGORY_TREND_FACTOR)}, "
                           f"CASE WHEN cat_trend = 'increasing' THEN 'Increasing' ELSE 'Stable' END)"),
        row("category", 2, f"printf({_tpl(TX.CATEGORY_AVERAGE_FACTOR)}, {_num('cat_monthly_avg')})"),
        row("forecast", 0, f"printf({_tpl(TX.FORECAST_MODEL_FACTOR)}, forecast_model)"),
        row("forecast", 1, f"printf({_tpl(TX.FORECAST_TOTAL_FACTOR)}, forecast_days, {_num('forecast_total')})"),
        row("forecast", 2, f"printf({_tpl(TX.FORECAST_RMSE_FACTOR)}, COALESCE(CAST(forecast_rmse AS VARCHAR), 'N/A'))"),
        row("savings", 0, f"printf({_tpl(TX.SAVINGS_RATE_FACTOR)}, {_pct('savings_rate')})"),
        row("savings", 1, f"printf({_tpl(TX.SAVINGS_SURPLUS_FACTOR)}, {_num('savings')})"),
        row("savings", 2, _tpl(TX.SAVINGS_FLOW_FACTOR)),
        *[row("anomaly", i, _tpl(t)) for i, t in enumerate(TX.ANOMALY_FACTORS)],
        row("trend", 0, f"printf({_tpl(TX.TREND_CHANGE_FACTOR)}, {_plain('trend_change_pct')})", "trend_first IS NOT NULL"),
        row("trend", 1, f"printf({_tpl(TX.TREND_FIRST_FACTOR)}, {_num('trend_first')})", "trend_first IS NOT NULL"),
        row("trend", 2, f"printf({_tpl(TX.TREND_LAST_FACTOR)}, {_num('trend_last')})", "trend_first IS NOT NULL"),
        *[row("default", i, _tpl(t)) for i, t in enumerate(TX.DEFAULT_FACTORS)],
    ]
    body = "\nUNION ALL\n".join(rows)
    return {"k_factors": f"WITH f AS ({_explain_figs()})\n{body}"}


def impacts_sql() -> dict[str, str]:
    def row(kind, pos, feature, importance, direction, description, cond="TRUE"):
        return (f"SELECT user_id, rec_index, kind, CAST({pos} AS BIGINT) AS pos, {feature} AS feature, "
                f"CAST({importance} AS DOUBLE) AS importance, {direction} AS direction, {description} AS description "
                f"FROM f WHERE kind = '{kind}' AND ({cond})")

    inc = "cat_trend = 'increasing'"
    rows = [
        row("category", 0, f"printf({_tpl(TX.CATEGORY_SHARE_FEATURE)}, category)", "round(cat_share, 4)", "'positive'",
            f"printf({_tpl(TX.CATEGORY_SHARE_DESCRIPTION)}, lower(category))"),
        row("category", 1, f"printf({_tpl(TX.CATEGORY_TREND_FEATURE)}, category)",
            f"CASE WHEN {inc} THEN 0.3 ELSE 0.1 END", f"CASE WHEN {inc} THEN 'positive' ELSE 'negative' END",
            f"printf({_tpl(TX.CATEGORY_TREND_DESCRIPTION)}, lower(category), cat_trend)"),
        *[row("forecast", i, _tpl(feat), v, _tpl(dirn), _tpl(desc))
          for i, (feat, v, dirn, desc) in enumerate(TX.FORECAST_IMPACTS)],
    ]
    return {"k_impacts": f"WITH f AS ({_explain_figs()})\n" + "\nUNION ALL\n".join(rows)}
