"""SQL twins of the catalog queries, for an independent engine (DuckDB).

Each statement reads the raw tables (views named like the parquet files) and
recomputes the query from scratch; column names and types mirror the Spark
output.  Doubles that engines may sum in different orders are rounded to 6
places on both sides; money and shares use the same integer arithmetic.
"""

from __future__ import annotations

from attrita import config as C

CUTOFF = C.PROFILE_CUTOFF.strftime("%Y-%m-%d %H:%M:%S")
ACTIVE_SINCE = C.PROFILE_ACTIVE_SINCE.strftime("%Y-%m-%d %H:%M:%S")
GEO = C.TEST_HIGH_RISK_REGION
NUM = C.NUMERIC_COLUMNS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PROFILE = f"""
hist AS (
  SELECT o_custkey AS customer_id,
         count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}') AS n_before,
         min(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}') AS first_before,
         max(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}') AS last_before,
         max(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}') AS max_price_before,
         max(CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' AND o_orderpriority = '{C.PROFILE_URGENT_PRIORITY}'
                  THEN 1 ELSE 0 END) AS urgent_before,
         count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '{CUTOFF}') AS n_after
  FROM orders GROUP BY o_custkey),
profile AS (
  SELECT h.customer_id,
         c.c_mktsegment AS segment,
         CAST(300 + (h.customer_id * 37) % 551 AS INTEGER) AS credit_score,
         r.r_name AS geography,
         CASE WHEN h.customer_id % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
         CAST(18 + (h.customer_id * 7) % 75 AS INTEGER) AS age,
         CAST({C.PROFILE_TENURE_YEAR} - year(h.first_before) AS INTEGER) AS tenure,
         greatest(c.c_acctbal, CAST(0.0 AS DOUBLE)) * CAST({C.PROFILE_BALANCE_SCALE} AS DOUBLE) AS balance,
         CAST(1 + h.n_before % 4 AS INTEGER) AS num_products,
         CAST(h.urgent_before AS INTEGER) AS has_cr_card,
         CAST(h.last_before >= TIMESTAMP '{ACTIVE_SINCE}' AS INTEGER) AS is_active_member,
         h.max_price_before AS estimated_salary,
         CAST(h.n_after = 0 AS INTEGER) AS exited
  FROM customer c
  JOIN hist h ON c.c_custkey = h.customer_id
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE h.n_before > 0)"""


def _bin_sql(col: str, edges: list) -> str:
    parts = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN {i + 1}"
                     for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    return f"CAST(CASE {parts} END AS INTEGER)"


FEATURES = PROFILE + f""",
med AS (SELECT median(balance) AS m FROM profile),
features AS (
  SELECT p.*,
         CASE WHEN estimated_salary + 1 = 0 THEN NULL ELSE balance / (estimated_salary + 1) END
           AS balance_to_salary_ratio,
         CAST(tenure AS DOUBLE) / NULLIF(CAST(age + 1 AS DOUBLE), 0) AS tenure_by_age,
         CAST(num_products AS DOUBLE) / NULLIF(CAST(tenure + 1 AS DOUBLE), 0) AS products_per_year,
         CAST(balance > (SELECT m FROM med) AS INTEGER) AS is_high_value,
         CAST(balance = 0 AS INTEGER) AS has_zero_balance,
         {_bin_sql('age', C.AGE_EDGES)} AS age_group,
         {_bin_sql('credit_score', C.CREDIT_EDGES)} AS credit_score_category,
         {_bin_sql('tenure', C.TENURE_EDGES)} AS tenure_category,
         CAST(is_active_member = 1 AND balance > (SELECT m FROM med) AS INTEGER) AS active_high_balance,
         CAST(age > {C.COMPLAIN_AGE_OVER} AS DOUBLE) * {C.COMPLAIN_WEIGHT_AGE}
           + CAST(num_products >= {C.COMPLAIN_PRODUCTS_AT_LEAST} AS DOUBLE) * {C.COMPLAIN_WEIGHT_PRODUCTS}
           + CAST(is_active_member = 0 AS DOUBLE) * {C.COMPLAIN_WEIGHT_INACTIVE}
           + CAST(balance = 0 AS DOUBLE) * {C.COMPLAIN_WEIGHT_ZERO_BALANCE} AS complain_risk_score
  FROM profile p)"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _pct(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) * 100.0) / NULLIF(CAST({den} AS DOUBLE), 0)"


def _rate_by(key: str, source: str = "profile") -> str:
    return (f"SELECT {key}, round({_pct('sum(exited)', 'count(*)')}, 6) AS churn_rate_pct, "
            f"count(*) AS customers, CAST(sum(exited) AS BIGINT) AS churned FROM {source} GROUP BY {key}")


def _values(rows: list[tuple], names: list[str]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return _q(v)
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"


def _rate_by_code(key: str, labels: list[str], first: int, ctes: str) -> str:
    dim = _values([(first + i, lab) for i, lab in enumerate(labels)], [key, "label"])
    return _with(ctes, f""", agg AS ({_rate_by(key, 'features' if 'features AS' in ctes else 'profile')})
SELECT CAST(d.{key} AS INTEGER) AS {key}, d.label, a.churn_rate_pct,
       CAST(coalesce(a.customers, 0) AS BIGINT) AS customers, CAST(coalesce(a.churned, 0) AS BIGINT) AS churned
FROM {dim} d LEFT JOIN agg a ON a.{key} = d.{key}""")


def _long(cols: list[str], source: str, by: list[str] | None = None) -> str:
    by = by or []
    sel = "".join(f"{b}, " for b in by)
    return " UNION ALL ".join(
        f"SELECT {sel}'{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))"
        for c in cols)


def _describe(by: list[str]) -> str:
    g = "".join(f"{b}, " for b in by)
    return f"""SELECT {g}"column", count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
       round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max
FROM ({_long(NUM, 'profile', by)}) GROUP BY {g}"column\""""


def _histogram(cols: list[str], n: int, source: str, by_class: bool) -> str:
    cls = "exited, " if by_class else ""
    classes = "(VALUES (0), (1)) AS k(exited)" if by_class else "(VALUES (NULL::INTEGER)) AS k(exited)"
    long_ = _long(cols, source, ["exited"] if by_class else None)
    if not by_class:
        long_ = f"SELECT NULL::INTEGER AS exited, \"column\", v FROM ({long_})"
    out_cls = "g.exited, " if by_class else ""
    return f""", lv AS ({long_}),
rng AS (SELECT "column", min(v) AS lo, max(v) AS hi FROM lv GROUP BY "column"),
grid AS (SELECT r."column", k.exited, CAST(b.bin AS INTEGER) AS bin,
                r.lo + b.bin * ((r.hi - r.lo) / {n}) AS bin_lower,
                r.lo + (b.bin + 1) * ((r.hi - r.lo) / {n}) AS bin_upper
         FROM rng r CROSS JOIN range(0, {n}) AS b(bin) CROSS JOIN {classes}),
cnt AS (SELECT lv."column", lv.exited,
               CAST(CASE WHEN r.hi = r.lo THEN 0
                         ELSE least({n - 1}, greatest(0, floor((lv.v - r.lo) / ((r.hi - r.lo) / {n})))) END AS INTEGER) AS bin,
               count(*) AS c
        FROM lv JOIN rng r ON lv."column" = r."column" GROUP BY ALL)
SELECT g."column", {out_cls}g.bin, g.bin_lower, g.bin_upper, CAST(coalesce(c.c, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN cnt c ON c."column" = g."column" AND c.bin = g.bin
     AND c.exited IS NOT DISTINCT FROM g.exited"""


def _corr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / NULLIF(stddev_pop({a}) * stddev_pop({b}), 0)"


def _corr_matrix() -> str:
    cols = C.CORRELATION_COLUMNS
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    selects = []
    for a, b in pairs:
        selects.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({_corr(a, b)}, 6) AS corr FROM profile")
        if a != b:
            selects.append(f"SELECT '{b}' AS feature_a, '{a}' AS feature_b, round({_corr(a, b)}, 6) AS corr FROM profile")
    return _with(PROFILE, "\n" + "\nUNION ALL ".join(selects))


def _wide_corr() -> str:
    """Pairwise complete, one aggregate over all pairs, then unpivoted."""
    cols = C.WIDE_CORRELATION_COLUMNS
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    both = lambda a, b: f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    wide = ", ".join(f"round(covar_pop({a}, {b}) / NULLIF(stddev_pop({a}) {both(a, b)} * stddev_pop({b}) {both(a, b)}, 0), 6) AS c{k}, "
                     f"count(*) {both(a, b)} AS n{k}" for k, (a, b) in enumerate(pairs))
    rows = " UNION ALL ".join(f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, c{k} AS corr, n{k} AS rows FROM wide"
                              for k, (a, b) in enumerate(pairs) for x, y in dict.fromkeys(((a, b), (b, a))))
    return _with(FEATURES, f", wide AS (SELECT {wide} FROM features)\n{rows}")


def _overview() -> str:
    codes = {"is_active_member": (C.ACTIVITY_LABELS, 0), "age_group": (C.AGE_LABELS, 1),
             "credit_score_category": (C.CREDIT_LABELS, 1), "tenure_category": (C.TENURE_LABELS, 1)}
    rates = " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS level, churn_rate_pct, customers, churned FROM ({_rate_by(c, 'features')})"
        for c in ["geography", "gender", "num_products", *codes])
    dim = _values([(c, str(first + i), lab) for c, (labels, first) in codes.items() for i, lab in enumerate(labels)],
                  ["dimension", "level", "label"])
    return _with(FEATURES, f""", rates AS ({rates})
SELECT coalesce(r.dimension, d.dimension) AS dimension, coalesce(r.level, d.level) AS level,
       coalesce(d.label, r.level) AS label, r.churn_rate_pct,
       CAST(coalesce(r.customers, 0) AS BIGINT) AS customers, CAST(coalesce(r.churned, 0) AS BIGINT) AS churned
FROM rates r FULL OUTER JOIN {dim} d ON r.dimension = d.dimension AND r.level = d.level""")


def _centres() -> str:
    """Silhouettes from all pairs of customers, as they are defined."""
    cols, centres = C.CENTRE_COLUMNS, C.GIVEN_CENTRES
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z{i}" for i, c in enumerate(cols))
    to = lambda c: " + ".join(f"(z{i} - ({x}::DOUBLE)) * (z{i} - ({x}::DOUBLE))" for i, x in enumerate(c))
    dist = ", ".join(f"{to(c)} AS d{k}" for k, c in enumerate(centres))
    least = f"least({', '.join(f'd{k}' for k in range(len(centres)))})"
    pick = " ".join(f"WHEN d{k} = {least} THEN {k}" for k in range(len(centres)))
    apart = " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(len(cols)))
    mean = ", ".join(f"avg(z{i}) AS m{i}" for i in range(len(cols)))
    around = " + ".join(f"(n.z{i} - m.m{i}) * (n.z{i} - m.m{i})" for i in range(len(cols)))
    return _with(PROFILE, f""",
s AS (SELECT customer_id, {z} FROM profile), d AS (SELECT *, {dist} FROM s),
n AS (SELECT *, {least} AS distance, CASE {pick} END AS cluster FROM d),
size AS (SELECT cluster, count(*) AS c FROM n GROUP BY cluster),
p AS (SELECT a.customer_id, a.cluster, a.distance, b.cluster AS other, sum({apart}) AS total, count(*) AS many
      FROM n a JOIN n b ON a.customer_id <> b.customer_id GROUP BY ALL),
ab AS (SELECT customer_id, cluster, distance, max(CASE WHEN other = cluster THEN total / many END) AS a,
              min(CASE WHEN other <> cluster THEN total / many END) AS b FROM p GROUP BY ALL),
sil AS (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS v FROM ab),
m AS (SELECT cluster, {mean} FROM n GROUP BY cluster),
i AS (SELECT n.cluster, sum({around}) AS inertia FROM n JOIN m ON n.cluster = m.cluster GROUP BY n.cluster),
k AS (SELECT cluster, count(*) AS customers, sum(distance) AS cost, sum(v) AS v, count(v) AS vs FROM sil GROUP BY cluster)
SELECT CAST(k.cluster AS INTEGER) AS cluster, customers, round(cost, 6) AS cost, round(inertia, 6) AS inertia,
       round(v / vs, 6) AS mean_silhouette FROM k JOIN i ON k.cluster = i.cluster
UNION ALL SELECT -1, CAST(sum(customers) AS BIGINT), round(sum(cost), 6), (SELECT round(sum(inertia), 6) FROM i),
       round(sum(v) / sum(vs), 6) FROM k""")


def _escalations() -> str:
    day = 86_400_000_000
    marks = " UNION ALL ".join(
        f"SELECT user_id, '{name}' AS trigger, t AS moment FROM e WHERE event_type = '{kind}' AND value >= {low}"
        + ("" if high == float("inf") else f" AND value < {high}") for name, kind, low, high in C.ESCALATION_SIGNS)
    actions = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ESCALATION_ACTIONS.items())
    return f"""
WITH e AS (SELECT user_id, event_type, coalesce(value, 0) AS value, epoch_us(ts) AS t FROM events
           WHERE user_id IS NOT NULL AND ts IS NOT NULL),
newest_event AS (SELECT max(t) AS newest FROM e),
w AS (SELECT user_id, CAST(floor(t / {7 * day}) AS BIGINT) * {7 * day} AS week, sum(value) AS total FROM e GROUP BY ALL),
d AS (SELECT a.user_id, 'Balance drop' AS trigger, a.week + {7 * day} AS moment FROM w a
      LEFT JOIN w b ON a.user_id = b.user_id AND b.week = a.week + {7 * day}, newest_event
      WHERE a.total > 0 AND a.week + {7 * day} <= newest AND coalesce(b.total, 0) < a.total * {C.ESCALATION_DROP_TO}),
q AS (SELECT user_id, 'No activity' AS trigger, max(t) AS moment FROM e GROUP BY user_id
      HAVING (SELECT newest FROM newest_event) - max(t) >= {round(C.ESCALATION_INACTIVE_DAYS * day)}),
everything AS (SELECT * FROM q UNION ALL SELECT * FROM d UNION ALL {marks})
SELECT user_id, trigger, CASE trigger {actions} END AS action, count(*) AS occurrences, make_timestamp(CAST(max(moment) AS BIGINT)) AS last_at
FROM everything GROUP BY user_id, trigger"""


LATE = f"""
WITH a AS (SELECT *, epoch_us(ts) AS t, CAST(floor(floor(epoch_us(ts) / 86400000000) / {C.LATE_SLOT_DAYS})
             + CASE WHEN event_id % {C.LATE_EVERY} = 0 THEN {C.LATE_SLOTS} ELSE 0 END AS BIGINT) AS slot
           FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT slot, max(max(t)) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400000000 AS mark
      FROM a GROUP BY slot),
j AS (SELECT a.*, m.mark, CAST(floor(t / 604800000000) AS BIGINT) * 604800000000 AS week,
             coalesce(CAST(floor(t / 604800000000) AS BIGINT) * 604800000000 + 604800000000 <= m.mark, false) AS is_late
      FROM a JOIN m USING (slot))
"""


def _ingested() -> str:
    cols = ["credit_score", "geography", "gender", "age", "tenure", "balance", "num_products", "has_cr_card",
            "is_active_member", "estimated_salary", "exited"]
    none = {c: "''" if c in ("geography", "gender") else "-1" for c in cols}
    kept = ", ".join(f"CASE WHEN reason = '' THEN {c} ELSE {none[c]} END AS {c}" for c in cols)
    return _with(PROFILE, f""", r AS (SELECT *, CASE customer_id % {C.SPOILT_EVERY}
    WHEN 1 THEN 'fields 13' WHEN 2 THEN 'fields 15' WHEN 3 THEN 'type Age' WHEN 4 THEN 'label'
    WHEN 5 THEN 'missing Exited' ELSE '' END AS reason FROM profile)
SELECT customer_id, {kept}, reason FROM r""")


def _corr_with() -> str:
    feats = [c for c in C.CORRELATION_COLUMNS if c != "exited"]
    u = " UNION ALL ".join(f"SELECT '{c}' AS feature, {_corr(c, 'exited')} AS c FROM profile" for c in feats)
    return _with(PROFILE, f""", cc AS ({u})
SELECT feature, round(c, 6) AS corr,
       CASE WHEN c > 0 THEN 'positive' WHEN c < 0 THEN 'negative' ELSE 'none' END AS direction,
       CAST(row_number() OVER (ORDER BY c DESC NULLS LAST, feature) AS INTEGER) AS rank
FROM cc""")


def _feature_power() -> str:
    feats = [(c, "original") for c in C.ORIGINAL_FEATURES] + [(c, "engineered") for c in C.ENGINEERED_FEATURES]
    u = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{g}' AS feature_group, round(abs({_corr(c, 'exited')}), 6) AS abs_corr FROM features"
        for c, g in feats)
    return _with(FEATURES, "\n" + u)


# ---- segments -------------------------------------------------------------

SEG_STATS = PROFILE + f""",
seg AS (
  SELECT segment, count(*) AS size,
         {_pct('sum(exited)', 'count(*)')} AS churn_rate,
         CAST(sum(exited) AS BIGINT) AS churn_count,
         avg(age) AS avg_age, avg(balance) AS avg_balance, avg(estimated_salary) AS avg_salary,
         avg(credit_score) AS avg_credit, avg(num_products) AS avg_products,
         {_pct('sum(is_active_member)', 'count(*)')} AS active_pct,
         {_pct('sum(has_cr_card)', 'count(*)')} AS has_card_pct,
         avg(tenure) AS avg_tenure
  FROM profile GROUP BY segment),
gmode AS (SELECT segment, gender FROM (
  SELECT segment, gender, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, gender) AS rn
  FROM profile GROUP BY segment, gender) WHERE rn = 1),
cmode AS (SELECT segment, geography FROM (
  SELECT segment, geography, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, geography) AS rn
  FROM profile GROUP BY segment, geography) WHERE rn = 1),
ranked AS (
  SELECT s.*, g.gender, m.geography,
         {_pct('s.size', 'sum(s.size) OVER ()')} AS size_pct,
         CAST(row_number() OVER (ORDER BY s.churn_rate DESC, s.segment) - 1 AS INTEGER) AS rank
  FROM seg s JOIN gmode g USING (segment) JOIN cmode m USING (segment)),
labelled AS (
  SELECT *, list_extract([{', '.join(_q(x) for x in C.RISK_LABELS)}], least(rank, {len(C.RISK_LABELS) - 1}) + 1) AS risk_level,
         CASE WHEN active_pct < {C.NAME_INACTIVE_BELOW}
                THEN CASE WHEN avg_balance > {C.NAME_HIGH_BALANCE_ABOVE} THEN 'Inactive High-Value' ELSE 'Disengaged' END
              WHEN active_pct > {C.NAME_ACTIVE_ABOVE}
                THEN CASE WHEN avg_balance > {C.NAME_HIGH_BALANCE_ABOVE} THEN 'Fully Active Premium' ELSE 'Highly Engaged' END
              WHEN avg_balance < {C.NAME_LOW_BALANCE_BELOW}
                THEN CASE WHEN avg_tenure < {C.NAME_SHORT_TENURE_BELOW} THEN 'New Short-Tenure' ELSE 'Low-Balance' END
              ELSE 'Moderately Engaged' END AS descr
  FROM ranked)"""

STRATEGY_VALUES = _values(
    [(r, title, prio, budget, improve, roi, sp, text, len(acts), " | ".join(acts))
     for (r, title, prio, budget, improve, roi, _), sp, text, acts
     in zip(C.STRATEGIES, C.STRATEGY_SAVE_PCT, C.STRATEGY_DESCRIPTIONS, C.STRATEGY_ACTIONS, strict=True)],
    ["strategy_rank", "title", "priority", "budget_pct", "retention_improvement_pct", "roi", "save_pct",
     "description", "n_actions", "action_text"])

SEG_STRATEGY = SEG_STATS + f""",
strat AS (SELECT l.*, s.title, s.priority, s.description, s.n_actions, s.action_text, CAST(s.budget_pct AS INTEGER) AS budget_pct,
                 CAST(s.retention_improvement_pct AS INTEGER) AS retention_improvement_pct, s.roi,
                 CAST(s.save_pct AS INTEGER) AS save_pct
          FROM labelled l JOIN {STRATEGY_VALUES} s ON s.strategy_rank = least(l.rank, {len(C.STRATEGIES) - 1}))"""


def _segment_profile() -> str:
    return _with(SEG_STATS, """
SELECT segment, rank, risk_level, risk_level || ' — ' || descr || ' Customers' AS name,
       size, round(size_pct, 6) AS size_pct, round(churn_rate, 6) AS churn_rate_pct, churn_count,
       round(avg_age, 6) AS avg_age, round(avg_balance, 6) AS avg_balance, round(avg_salary, 6) AS avg_salary,
       round(avg_credit, 6) AS avg_credit, round(avg_products, 6) AS avg_products,
       round(active_pct, 6) AS active_pct, round(has_card_pct, 6) AS has_card_pct,
       round(avg_tenure, 6) AS avg_tenure, gender, geography
FROM labelled""")


def _segment_impact() -> str:
    inv = int(round(C.CAMPAIGN_INVESTMENT_M * 100))
    ltv10 = C.CUSTOMER_LTV * 10
    return _with(SEG_STRATEGY, f""",
imp AS (SELECT segment, churn_count, save_pct,
               CAST(floor(churn_count * save_pct / 100) AS BIGINT) AS saved FROM strat WHERE rank = 0),
val AS (SELECT *, CAST(floor((saved * {ltv10} + 500000) / 1000000) AS BIGINT) AS vt FROM imp)
SELECT segment, churn_count AS churned, saved, churn_count - saved AS reduced_churn, save_pct AS retain_pct,
       vt / 10.0 AS value_saved_m, {C.CAMPAIGN_INVESTMENT_M} AS investment_m,
       CAST(floor((vt * 10 - {inv} + 5) / 10) AS BIGINT) / 10.0 AS net_gain_m,
       CAST(floor(vt * 10 / {inv}) AS BIGINT) AS roi_x
FROM val""")


def _budget_cte() -> str:
    ltv10 = C.CUSTOMER_LTV * 10
    return SEG_STRATEGY + f""",
budget AS (SELECT segment, rank, budget_pct, retention_improvement_pct,
                  CAST(floor((churn_count * save_pct * {ltv10} + 50000000) / 100000000) AS BIGINT) / 10.0
                    AS saved_value_m,
                  CAST(floor(churn_count * save_pct / 100) AS BIGINT) AS customers_saved
           FROM strat)"""


# ---- rules ----------------------------------------------------------------

def _factor_rows() -> list[tuple[str, str, int]]:
    """(factor, condition, weight) with the second branch of two-way factors split out."""
    return [
        ("Age", f"age > {C.RULE_AGE_OVER}", C.RULE_WEIGHT_AGE),
        ("IsActiveMember", "is_active_member = 0", C.RULE_WEIGHT_INACTIVE),
        ("NumOfProducts", "num_products = 1", C.RULE_WEIGHT_ONE_PRODUCT),
        ("NumOfProducts", "num_products >= 3", C.RULE_WEIGHT_MANY_PRODUCTS),
        ("Geography", f"geography = {_q(GEO)}", C.RULE_WEIGHT_GEOGRAPHY),
        ("Balance", "balance = 0", C.RULE_WEIGHT_ZERO_BALANCE),
        ("Balance", f"balance > {C.RULE_VERY_HIGH_BALANCE}", C.RULE_WEIGHT_VERY_HIGH_BALANCE),
        ("Tenure", f"tenure < {C.RULE_TENURE_UNDER}", C.RULE_WEIGHT_TENURE),
        ("Gender", "gender = 'Female'", C.RULE_WEIGHT_FEMALE),
        ("HasCrCard", "has_cr_card = 0", C.RULE_WEIGHT_NO_CARD),
        ("CreditScore", f"credit_score < {C.RULE_CREDIT_UNDER}", C.RULE_WEIGHT_CREDIT),
    ]


def _fill(template: str, col: str) -> str:
    head, tail = template.split("{}")
    return f"{_q(head)} || CAST({col} AS VARCHAR) || {_q(tail)}"


def _texts() -> list[str]:
    geo_text = C.TEXT_GEOGRAPHY.replace("Germany", GEO, 1)
    return [
        f"CASE WHEN age > {C.RULE_AGE_OVER} THEN {_fill(C.TEXT_AGE, 'age')} END",
        f"CASE WHEN is_active_member = 0 THEN {_q(C.TEXT_INACTIVE)} END",
        f"CASE WHEN num_products = 1 THEN {_fill(C.TEXT_ONE_PRODUCT, 'num_products')} "
        f"WHEN num_products >= 3 THEN {_fill(C.TEXT_MANY_PRODUCTS, 'num_products')} END",
        f"CASE WHEN geography = {_q(GEO)} THEN {_q(geo_text)} END",
        f"CASE WHEN balance = 0 THEN {_q(C.TEXT_ZERO_BALANCE)} "
        f"WHEN balance > {C.RULE_VERY_HIGH_BALANCE} THEN {_q(C.TEXT_VERY_HIGH_BALANCE)} END",
        f"CASE WHEN tenure < {C.RULE_TENURE_UNDER} THEN {_q(C.TEXT_TENURE)} END",
        f"CASE WHEN has_cr_card = 0 THEN {_q(C.TEXT_NO_CARD)} END",
        f"CASE WHEN credit_score < {C.RULE_CREDIT_UNDER} THEN {_fill(C.TEXT_CREDIT, 'credit_score')} END",
    ]


def _score_h() -> str:
    return " + ".join(f"CASE WHEN {cond} THEN {w} ELSE 0 END" for _, cond, w in _factor_rows())


SCORED = PROFILE + f""",
scored0 AS (
  SELECT p.*, CAST({_score_h()} AS INTEGER) AS score_h,
         concat_ws(' | ', {', '.join(_texts())}) AS factor_text,
         CAST({' + '.join(f'CASE WHEN ({t}) IS NOT NULL THEN 1 ELSE 0 END' for t in _texts())} AS INTEGER) AS n_factors
  FROM profile p),
scored AS (
  SELECT *, CAST(score_h AS DOUBLE) / 100.0 AS rule_score,
         CAST(least(score_h, {C.RULE_PROBABILITY_CAP}) AS DOUBLE) / 100.0 AS churn_probability
  FROM scored0),
leveled AS (
  SELECT *, CASE WHEN churn_probability > {C.RULE_HIGH_ABOVE} THEN 'HIGH'
                 WHEN churn_probability > {C.RULE_MEDIUM_ABOVE} THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
         CAST(least({C.CONFIDENCE_CAP}, {C.CONFIDENCE_BASE} + {C.CONFIDENCE_PER_FACTOR} * n_factors) AS INTEGER)
           AS confidence,
         CAST({C.CUSTOMER_LTV} AS DOUBLE) * churn_probability AS expected_ltv_loss
  FROM scored)"""


FACTORS = SCORED + ",\nfactors AS (" + " UNION ALL ".join(
    f"SELECT customer_id, '{f}' AS factor, {w} AS wh FROM profile WHERE {cond}"
    for f, cond, w in _factor_rows()) + ")"


def _actions() -> str:
    regional = C.ACTION_REGIONAL.replace("Germany", GEO, 1)
    high = [
        f"CASE WHEN age > {C.RULE_AGE_OVER} THEN {_q(C.ACTION_AGE)} END",
        f"CASE WHEN is_active_member = 0 THEN {_q(C.ACTION_REACTIVATE)} END",
        f"CASE WHEN num_products >= 3 THEN {_q(C.ACTION_SIMPLIFY)} "
        f"WHEN num_products = 1 THEN {_q(C.ACTION_CROSS_SELL)} END",
        f"CASE WHEN geography = {_q(GEO)} THEN {_q(regional)} END",
        f"CASE WHEN balance = 0 OR balance > {C.RULE_VERY_HIGH_BALANCE} THEN {_q(C.ACTION_FINANCIAL)} END",
    ]
    medium = [
        f"CASE WHEN num_products = 1 THEN {_q(C.ACTION_MEDIUM_ONE_PRODUCT)} END",
        f"CASE WHEN is_active_member = 0 THEN {_q(C.ACTION_MEDIUM_INACTIVE)} END",
        f"CASE WHEN tenure < {C.MEDIUM_TENURE_UNDER} THEN {_q(C.ACTION_MEDIUM_NEW)} END",
    ]
    count = lambda xs: " + ".join(f"CASE WHEN ({x}) IS NOT NULL THEN 1 ELSE 0 END" for x in xs)
    plans = _values([(lvl, plan, when, " | ".join(steps), outcome, invest,
                      None if cost is None else (C.CUSTOMER_LTV - cost) / cost)
                     for lvl, plan, when, steps, outcome, invest, cost in C.RISK_PLANS],
                    ["risk_level", "plan", "timeframe", "step_text", "expected_outcome", "investment", "roi_x"])
    return _with(SCORED, f"""
SELECT l.customer_id, l.risk_level, p.plan, p.timeframe, p.step_text, p.expected_outcome,
       p.investment, CAST(p.roi_x AS DOUBLE) AS roi_x,
       CAST(CASE WHEN l.risk_level = 'HIGH' THEN {count(high)}
                 WHEN l.risk_level = 'MEDIUM' THEN {count(medium)} ELSE 0 END AS INTEGER) AS n_actions,
       CASE WHEN l.risk_level = 'HIGH' THEN concat_ws(' | ', {', '.join(high)})
            WHEN l.risk_level = 'MEDIUM' THEN concat_ws(' | ', {', '.join(medium)})
            ELSE '' END AS action_text
FROM leveled l LEFT JOIN {plans} p ON p.risk_level = l.risk_level""")


def _split_cte() -> str:
    pct = int(round(C.TEST_FRACTION * 100))
    return PROFILE + f""",
hashed AS (SELECT customer_id, exited,
                  (((customer_id % 2147483647) * 48271 % 2147483647) * 48271) % 2147483647 AS h FROM profile),
split AS (SELECT customer_id, exited,
                 CASE WHEN row_number() OVER (PARTITION BY exited ORDER BY h, customer_id)
                           <= (count(*) OVER (PARTITION BY exited) * {pct} + 99) // 100
                      THEN 'test' ELSE 'train' END AS split
          FROM hashed)"""


def _histogram_query(cols, n, by_class, features=False):
    return _with(FEATURES if features else PROFILE, _histogram(cols, n, "features" if features else "profile", by_class))


def _risk_levels() -> str:
    n = C.RISK_SCORE_LEVELS
    return _with(FEATURES, f""",
rng AS (SELECT min(complain_risk_score) AS lo, max(complain_risk_score) AS hi FROM features),
lv AS (SELECT CAST(CASE WHEN r.hi = r.lo THEN {(n + 1) // 2}
                   ELSE least({n}, greatest(1, ceil((f.complain_risk_score - r.lo) / ((r.hi - r.lo) / {n})))) END
                   AS INTEGER) AS level, f.exited
       FROM features f, rng r),
agg AS ({_rate_by('level', 'lv')}),
grid AS (SELECT CAST(k AS INTEGER) AS level, r.lo + (k - 1) * ((r.hi - r.lo) / {n}) AS bin_lower,
                r.lo + k * ((r.hi - r.lo) / {n}) AS bin_upper
         FROM range(1, {n + 1}) AS t(k), rng r)
SELECT g.level, g.bin_lower, g.bin_upper, a.churn_rate_pct,
       CAST(coalesce(a.customers, 0) AS BIGINT) AS customers, CAST(coalesce(a.churned, 0) AS BIGINT) AS churned
FROM grid g LEFT JOIN agg a ON a.level = g.level""")


def _describe_by_class() -> str:
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    u = " UNION ALL ".join(f"SELECT exited, \"column\", '{s}' AS statistic, CAST({s} AS DOUBLE) AS value FROM d"
                           for s in stats)
    return _with(PROFILE, f""", d AS ({_describe(['exited'])}), l AS ({u})
SELECT "column", statistic, max(CASE WHEN exited = 0 THEN value END) AS not_churned,
       max(CASE WHEN exited = 1 THEN value END) AS churned
FROM l GROUP BY "column", statistic""")


EVENTS_AS_OF = "(SELECT max(ts) FROM events)"


# T3
WEEKLY = """
SELECT user_id, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01 00:00:00') AS week_start,
       count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
       round(sum(value), 6) AS total_value
FROM events GROUP BY ALL"""

# Silences of more than a day that reached it a day before the newest event (in whole milliseconds).
SILENCES = """
WITH e AS (SELECT user_id, ts, epoch_us(ts) AS t, epoch_us(lead(ts) OVER w) AS next,
                  row_number() OVER w AS k
           FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
ends AS (SELECT *, k - coalesce(lag(k) OVER (PARTITION BY user_id ORDER BY k), 0) AS events
         FROM e WHERE next IS NULL OR next - t > 86400000000)
SELECT user_id, ts AS last_event, CAST(events AS BIGINT) AS events, ts + INTERVAL 1 DAY AS alert_at
FROM ends WHERE t + 86400000000 <= (SELECT max(t) // 1000 * 1000 FROM e) - 86400000000"""


def _aligned() -> str:
    """Model rows with the training rows' median (P20) and levels."""
    median = "med AS (SELECT median(balance) AS m FROM profile),"
    trained = _split_cte()[len(PROFILE):] + """,
med AS (SELECT median(p.balance) AS m FROM profile p JOIN split s USING (customer_id) WHERE s.split = 'train'),"""
    assert median in FEATURES
    return _with(FEATURES.replace(",\n" + median, trained), """
SELECT features.* EXCLUDE (segment, geography, gender, exited),
       CAST(gender = 'Male' AS INTEGER) AS gender_Male,
       CAST(geography = 'AMERICA' AS INTEGER) AS geography_AMERICA,
       CAST(geography = 'ASIA' AS INTEGER) AS geography_ASIA,
       CAST(geography = 'EUROPE' AS INTEGER) AS geography_EUROPE,
       CAST(geography = 'MIDDLE EAST' AS INTEGER) AS geography_MIDDLE_EAST,
       CAST(0 AS INTEGER) AS geography_UNSEEN
FROM features""")


def _rule_bands() -> str:
    """E4 on the rule weights."""
    def case(col: str, bands: list, zero: str | None = None) -> str:
        parts = [f"WHEN {col} IS NULL THEN NULL"] + ([f"WHEN {col} = 0 THEN {_q(zero)}"] if zero else [])
        for k, (upper, label) in enumerate(bands[:-1]):
            op = "<=" if k == len(bands) - 2 else "<"
            parts.append(f"WHEN {col} {op} {upper} THEN {_q(label)}")
        return f"CASE {' '.join(parts)} ELSE {_q(bands[-1][1])} END"
    return _with(FACTORS, f"""
SELECT f.factor AS feature,
       CASE f.factor WHEN 'Age' THEN {case('p.age', C.EXPLAIN_AGE_BANDS)}
            WHEN 'Balance' THEN {case('p.balance', C.EXPLAIN_BALANCE_BANDS, '0')}
            WHEN 'NumOfProducts' THEN CAST(p.num_products AS VARCHAR)
            ELSE CAST(p.is_active_member AS VARCHAR) END AS band,
       round(avg(f.wh / 100.0), 6) AS mean_contribution, count(*) AS customers
FROM factors f JOIN profile p USING (customer_id)
WHERE f.factor IN ('Age', 'Balance', 'NumOfProducts', 'IsActiveMember') GROUP BY ALL""")


def _importance(columns: str, where: str = "") -> str:
    power = _feature_power()
    return f"""
WITH power AS ({power}),
ordered AS (SELECT feature, abs_corr AS importance,
                   CAST(row_number() OVER (ORDER BY abs_corr DESC, feature) AS INTEGER) AS rank,
                   sum(abs_corr) OVER (ORDER BY abs_corr DESC, feature ROWS UNBOUNDED PRECEDING) * 100.0
                     / sum(abs_corr) OVER () AS pct FROM power)
SELECT {columns} FROM ordered {where}"""


def _score_board() -> str:
    return _with(SCORED, """,
s AS (SELECT l.customer_id, l.exited, CAST(l.rule_score AS DOUBLE) AS r, f.c / 8.0 AS c,
             1.0 - l.is_active_member AS i
      FROM leveled l JOIN (SELECT customer_id,
          CAST(age > %s AS DOUBLE) * %s + CAST(num_products >= %s AS DOUBLE) * %s
          + CAST(is_active_member = 0 AS DOUBLE) * %s + CAST(balance = 0 AS DOUBLE) * %s AS c FROM profile) f
        USING (customer_id)),
long AS (SELECT 'rule' AS model, exited, r AS score FROM s UNION ALL SELECT 'complain', exited, c FROM s
         UNION ALL SELECT 'inactive', exited, CAST(i AS DOUBLE) FROM s
         UNION ALL SELECT 'vote', exited, (CAST(c AS DOUBLE) + CAST(i AS DOUBLE) + r) / 3.0 FROM s),
per AS (SELECT model, round(score, 9) AS score, sum(CAST(exited = 1 AS BIGINT)) AS pos, sum(CAST(exited <> 1 AS BIGINT)) AS neg
        FROM long GROUP BY ALL),
run AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score) - neg AS below FROM per),
auc AS (SELECT model, round(sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS roc_auc,
               CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM run GROUP BY model)
SELECT model, roc_auc, positives, negatives,
       CAST(row_number() OVER (ORDER BY roc_auc DESC, model) AS INTEGER) AS rank,
       round((roc_auc - b) / b, 6) AS auc_lift_vs_baseline
FROM auc, (SELECT roc_auc AS b FROM auc WHERE model = 'rule')""" % (
        C.COMPLAIN_AGE_OVER, C.COMPLAIN_WEIGHT_AGE, C.COMPLAIN_PRODUCTS_AT_LEAST, C.COMPLAIN_WEIGHT_PRODUCTS,
        C.COMPLAIN_WEIGHT_INACTIVE, C.COMPLAIN_WEIGHT_ZERO_BALANCE))


def oracle_sql() -> dict[str, str]:
    return {
        "customer_profile": _with(PROFILE, "\nSELECT * FROM profile"),
        "customer_features": _with(FEATURES, "\nSELECT * FROM features"),
        "median_balance": _with(PROFILE, "\nSELECT round(median(balance), 6) AS median_balance FROM profile"),
        "one_hot_features": _with(FEATURES, """
SELECT features.* EXCLUDE (segment, geography, gender, exited),
       CAST(gender = 'Male' AS INTEGER) AS gender_Male,
       CAST(geography = 'AMERICA' AS INTEGER) AS geography_AMERICA,
       CAST(geography = 'ASIA' AS INTEGER) AS geography_ASIA,
       CAST(geography = 'EUROPE' AS INTEGER) AS geography_EUROPE,
       CAST(geography = 'MIDDLE EAST' AS INTEGER) AS geography_MIDDLE_EAST
FROM features"""),
        "bin_coverage": _with(PROFILE, "\n" + " UNION ALL ".join(
            f"SELECT '{name}' AS feature, count(*) AS rows, "
            f"count(*) FILTER (WHERE {src} IS NOT NULL AND ({_bin_sql(src, edges)}) IS NULL) AS out_of_range, "
            f"count(*) FILTER (WHERE {src} IS NULL) AS null_values FROM profile"
            for name, src, edges in [("age_group", "age", C.AGE_EDGES),
                                     ("credit_score_category", "credit_score", C.CREDIT_EDGES),
                                     ("tenure_category", "tenure", C.TENURE_EDGES)])),
        "churned_only": _with(PROFILE, f"""
SELECT customer_id, {', '.join(NUM)} FROM profile WHERE exited = 1"""),
        "kpis": _with(PROFILE, f"""
SELECT count(*) AS total_customers, round({_pct('sum(exited)', 'count(*)')}, 6) AS churn_rate_pct,
       CAST(sum(exited) AS BIGINT) AS churned, CAST(count(*) - sum(exited) AS BIGINT) AS retained,
       count(DISTINCT geography) AS countries, 13 AS n_columns
FROM profile"""),
        "describe_numeric": _with(PROFILE, "\n" + _describe([])),
        "describe_by_class": _describe_by_class(),
        "class_counts": _with(PROFILE, f""",
c AS (SELECT exited, count(*) AS n FROM profile GROUP BY exited),
d AS (SELECT * FROM {_values([(0, C.CLASS_LABELS[0]), (1, C.CLASS_LABELS[1])], ['exited', 'label'])})
SELECT CAST(d.exited AS INTEGER) AS exited, d.label, CAST(coalesce(c.n, 0) AS BIGINT) AS customers,
       round({_pct('coalesce(c.n, 0)', 'sum(coalesce(c.n, 0)) OVER ()')}, 6) AS share_pct
FROM d LEFT JOIN c ON c.exited = d.exited"""),
        "churn_by_geography": _with(PROFILE, "\n" + _rate_by("geography")),
        "churn_by_gender": _with(PROFILE, "\n" + _rate_by("gender")),
        "churn_by_products": _with(PROFILE, "\n" + _rate_by("num_products")),
        "churn_by_activity": _rate_by_code("is_active_member", C.ACTIVITY_LABELS, 0, PROFILE),
        "churn_by_age_group": _rate_by_code("age_group", C.AGE_LABELS, 1, FEATURES),
        "churn_by_credit_category": _rate_by_code("credit_score_category", C.CREDIT_LABELS, 1, FEATURES),
        "churn_by_tenure_category": _rate_by_code("tenure_category", C.TENURE_LABELS, 1, FEATURES),
        "churn_by_risk_level": _risk_levels(),
        "churn_overview": _overview(),
        "ingested_customers": _ingested(),
        "escalations": _escalations(),
        "given_centre_quality": _centres(),
        "stream_late_rows": LATE + """SELECT event_id, user_id, ts, value, make_timestamp(CAST(mark AS BIGINT)) AS watermark
FROM j WHERE is_late""",
        "stream_weekly_in_time": LATE + """SELECT user_id, make_timestamp(week) AS week_start, count(*) AS events,
       count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(sum(value), 6) AS total_value
FROM j WHERE NOT is_late GROUP BY user_id, week""",
        "wide_correlation_matrix": _wide_corr(),
        "feature_histogram": _histogram_query(NUM, C.HISTOGRAM_BINS, False),
        "feature_histogram_by_class": _histogram_query(NUM, C.HISTOGRAM_BINS, True),
        "risk_score_histogram": _histogram_query(["complain_risk_score"], C.RISK_HISTOGRAM_BINS, True, True),
        "correlation_matrix": _corr_matrix(),
        "churn_correlation": _corr_with(),
        "feature_power": _feature_power(),
        "segment_profile": _segment_profile(),
        "segment_sizes": _with(PROFILE, f"""
SELECT segment, round({_pct('sum(exited)', 'count(*)')}, 6) AS churn_rate_pct,
       CAST(sum(exited) AS BIGINT) AS churned, count(*) AS customers FROM profile GROUP BY segment"""),
        "segment_summary": _with(SEG_STATS, """
SELECT segment, size, round(size_pct, 2) AS size_pct, round(churn_rate, 2) AS churn_rate_pct, churn_count, risk_level
FROM labelled"""),
        "segment_profile_table": _with(SEG_STATS, """
SELECT segment, risk_level, size, round(churn_rate, 2) AS churn_pct, churn_count, round(avg_age, 1) AS avg_age,
       round(avg_balance, 0) AS avg_balance, round(avg_products, 2) AS avg_products,
       round(active_pct, 1) AS active_pct, round(avg_tenure, 1) AS avg_tenure
FROM labelled"""),
        "segment_strategy": _with(SEG_STRATEGY, """
SELECT segment, rank, risk_level, title, priority, description, CAST(n_actions AS INTEGER) AS n_actions, action_text,
       budget_pct, retention_improvement_pct, roi,
       save_pct / 100.0 AS save_rate, round(churn_rate, 6) AS churn_rate_pct, churn_count
FROM strat"""),
        "segment_impact": _segment_impact(),
        "segment_budget": _with(_budget_cte(), "\nSELECT * FROM budget"),
        "segment_budget_totals": _with(_budget_cte(), f"""
SELECT CAST(sum(CAST(round(saved_value_m * 10) AS BIGINT)) AS BIGINT) / 10.0 AS total_saved_value_m,
       CAST(sum(customers_saved) AS BIGINT) AS total_customers_saved,
       {C.TOTAL_INVESTMENT_M} AS total_investment_m,
       CAST(floor(sum(CAST(round(saved_value_m * 10) AS BIGINT)) / {int(round(C.TOTAL_INVESTMENT_M * 10))}) AS BIGINT)
         AS overall_roi_x
FROM budget"""),
        "rule_scores": _with(SCORED, """
SELECT customer_id, rule_score, churn_probability, risk_level, n_factors, confidence, expected_ltv_loss, factor_text
FROM leveled"""),
        "stream_rule_scores": _with(SCORED, """
SELECT customer_id, churn_probability, risk_level, confidence, n_factors, expected_ltv_loss, rule_score, factor_text
FROM leveled"""),
        "rule_factor_weights": _with(FACTORS, "\nSELECT customer_id, factor, wh / 100.0 AS weight FROM factors"),
        "rule_waterfall": _with(FACTORS, """
SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY wh, factor) AS INTEGER) AS step,
       factor, wh / 100.0 AS contribution,
       sum(wh) OVER (PARTITION BY customer_id ORDER BY wh, factor ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         / 100.0 AS running_total
FROM factors"""),
        "retention_actions": _actions(),
        "risk_portfolio": _with(SCORED, """
SELECT risk_level, count(*) AS customers, round(avg(churn_probability), 6) AS avg_probability,
       round(sum(expected_ltv_loss), 2) AS expected_ltv_loss, CAST(sum(exited) AS BIGINT) AS churned
FROM leveled GROUP BY risk_level"""),
        "rule_confusion": _with(SCORED, f""",
c AS (SELECT CAST(sum(CASE WHEN churn_probability > 0.5 AND exited = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN churn_probability > 0.5 AND exited <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN churn_probability <= 0.5 AND exited <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
             CAST(sum(CASE WHEN churn_probability <= 0.5 AND exited = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
      FROM scored)
SELECT tp, fp, tn, fn,
       round(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 6) AS precision,
       round(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 6) AS recall,
       round(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 6) AS f1,
       round(CAST(tp + tn AS DOUBLE) / NULLIF(tp + tn + fp + fn, 0), 6) AS accuracy,
       round(CAST(fp AS DOUBLE) / NULLIF(fp + tn, 0), 6) AS false_positive_rate
FROM c"""),
        "rule_auc": _with(SCORED, """,
s AS (SELECT churn_probability AS s, sum(CASE WHEN exited = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN exited <> 1 THEN 1 ELSE 0 END) AS neg FROM scored GROUP BY churn_probability),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM s)
SELECT round(sum(CAST(pos AS DOUBLE) * (CAST(below AS DOUBLE) + neg / 2.0))
             / NULLIF(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0), 6) AS roc_auc,
       CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
FROM r"""),
        "stratified_split": _with(_split_cte(), "\nSELECT customer_id, exited, split FROM split"),
        "split_counts": _with(_split_cte(), "\nSELECT exited, split, count(*) AS customers FROM split GROUP BY ALL"),
        "inactivity_alerts": f"""
SELECT user_id, max(ts) AS last_event, count(*) AS events,
       round((epoch_us({EVENTS_AS_OF}) - epoch_us(max(ts))) / 86400000000.0, 6) AS days_inactive,
       CAST((epoch_us({EVENTS_AS_OF}) - epoch_us(max(ts))) / 86400000000.0 >= 1.0 AS INTEGER) AS alert
FROM events GROUP BY user_id""",
        "weekly_activity": WEEKLY,
        "stream_weekly_activity": WEEKLY,
        "inactivity_silences": SILENCES,
        "aligned_model_rows": _aligned(),
        "rule_mean_contribution": _with(FACTORS, """
SELECT factor AS feature, round(avg(abs(wh / 100.0)), 6) AS mean_abs_contribution FROM factors GROUP BY factor"""),
        "rule_contribution_by_bands": _rule_bands(),
        "correlation_importance": _importance(
            "feature, importance, rank, round(pct, 6) AS cumulative_pct, "
            "rank <= min(CASE WHEN pct >= 80 THEN rank END) OVER () AS within_80pct"),
        "top_correlations": _importance("feature, importance, rank", "WHERE rank <= 10"),
        "score_leaderboard": _score_board(),
        "rule_calibration": _with(SCORED, """,
c AS (SELECT rule_score AS score, count(*) AS n, sum(CASE WHEN exited = 1 THEN 1 ELSE 0 END) AS pos FROM scored GROUP BY rule_score),
r AS (SELECT *, row_number() OVER (ORDER BY score) AS i, sum(n) OVER (ORDER BY score) AS cn, sum(pos) OVER (ORDER BY score) AS cp FROM c),
spans AS (SELECT a.i AS j, b.i AS k, (b.cp - a.cp + a.pos)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS rate FROM r a JOIN r b ON a.i <= b.i),
least AS (SELECT r.i, s.j, min(s.rate) AS m FROM r JOIN spans s ON s.j <= r.i AND s.k >= r.i GROUP BY r.i, s.j),
best AS (SELECT i, max(m) AS v FROM least GROUP BY i)
SELECT r.score, r.n AS customers, CAST(r.pos AS BIGINT) AS churned, round(r.pos::DOUBLE / r.n::DOUBLE, 6) AS observed,
       round(best.v, 6) AS calibrated FROM r JOIN best USING (i)"""),
        "stream_inactivity_alerts": SILENCES,
    }
