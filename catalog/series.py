"""Lags, differences, splits, folds, decomposition, autocorrelation."""

from pyspark.sql import functions as F

from catalog.common import month_panel, rounded
from catalog.derive import LAG_PANEL
from catalog.panel import SPLIT
from catalog.registry import EVENT_PANEL, panel, query, with_ctes
from panelwright.operators import acf as ac
from panelwright.operators import window as w
from panelwright.operators.series import numbered, series
from panelwright.sources.star import event_panel, table

LAG_COLS = [f"{c}_lag{k}" for k in (1, 2) for c in ("free_cash_flow", "current_ratio", "quick_ratio", "cash_ratio")]


@query(
    "e1_add_lags",
    with_ctes(LAG_PANEL, body=f"SELECT industry, year, {', '.join(f'round({c}, 6) AS {c}' for c in LAG_COLS)} FROM lagpanel"),
)
def e1(spark, sf):
    cols = ["free_cash_flow", "current_ratio", "quick_ratio", "cash_ratio"]
    return rounded(w.add_lags(month_panel(spark, sf), cols, 2).select("industry", "year", *LAG_COLS))


@query(
    "e1_add_lags_long",
    """SELECT event_type, event_id, value, v1 AS value_lag1, v2 AS value_lag2 FROM (
      SELECT *, lag(value, 1) OVER g AS v1, lag(value, 2) OVER g AS v2 FROM events
      WINDOW g AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE v2 IS NOT NULL""",
)
def e1_long(spark, sf):
    """Record-level series (few entities, many rows) in the block layout."""
    rows = table(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    out = w.add_lags(rows, ["value"], 2, ["event_type"], ["ts", "event_id"], layout="blocks")
    return out.drop("ts")


@query(
    "e1_add_lags_pooled",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_tax, l1 AS l_tax_lag1 FROM (
      SELECT *, lag(l_tax) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax) AS l1
      FROM lineitem) WHERE l1 IS NOT NULL""",
)
def e1_pooled(spark, sf):
    """The whole table as one series: no single-task window."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax"]
    rows = table(spark, sf, "lineitem").select(*order)
    out = w.add_lags(rows, ["l_tax"], 1, [], order)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_tax_lag1")


@query(
    "e1_positions",
    """SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t,
    count(*) OVER (PARTITION BY event_type) AS n FROM events""",
)
def e1_positions(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "ts", "event_id")
    return numbered(rows, ["event_type"], ["ts", "event_id"], "blocks").select("event_id", "t", "n")


@query(
    "e2_difference",
    with_ctes(
        panel(),
        body="""SELECT industry, year, round(coalesce(cash_ratio - lag(cash_ratio) OVER g, 0), 6) AS d1,
        round(cash_ratio - 2 * lag(cash_ratio, 1) OVER g + lag(cash_ratio, 2) OVER g, 6) AS d2
        FROM panel WINDOW g AS (PARTITION BY industry ORDER BY year)""",
    ),
)
def e2(spark, sf):
    out = w.difference(month_panel(spark, sf), "cash_ratio", 1, fill=0.0, name="d1")
    return rounded(w.difference(out, "cash_ratio", 2, name="d2").select("industry", "year", "d1", "d2"))


@query("e3_time_split", with_ctes(panel() + SPLIT.format("panel"), body="SELECT industry, year, split FROM split"))
def e3(spark, sf):
    return w.time_split(month_panel(spark, sf)).select("industry", "year", "split")


FOLDS = """, nn AS (
  SELECT industry, year, cash_ratio, free_cash_flow, row_number() OVER (PARTITION BY industry ORDER BY year) AS t,
    count(*) OVER (PARTITION BY industry) AS n FROM panel),
sz AS (SELECT *, least(3, greatest(1, (n - 2) // 2)) AS k FROM nn),
fo AS (SELECT *, n // (k + 1) AS size, unnest(range(1, k + 1)) AS fold FROM sz),
folds AS (
  SELECT industry, year, cash_ratio, free_cash_flow, t, CAST(fold AS INTEGER) AS fold, size * fold AS train_end,
    CASE WHEN t <= size * fold THEN 'train' ELSE 'test' END AS role
  FROM fo WHERE t <= size * (fold + 1) AND size * fold >= 3)"""


@query("e4_rolling_folds", with_ctes(panel() + FOLDS, body="SELECT industry, year, fold, train_end, role FROM folds"))
def e4(spark, sf):
    return w.rolling_folds(month_panel(spark, sf)).select("industry", "year", "fold", "train_end", "role")


@query(
    "e5_sequence_windows",
    with_ctes(
        panel(),
        body="""SELECT industry, year, round(l2f, 6) AS oldest_flow, round(l1f, 6) AS latest_flow,
        round(l1c, 6) AS latest_cash, round(free_cash_flow, 6) AS next_flow FROM (
          SELECT *, lag(free_cash_flow, 2) OVER g AS l2f, lag(free_cash_flow, 1) OVER g AS l1f,
            lag(cash_ratio, 1) OVER g AS l1c FROM panel WINDOW g AS (PARTITION BY industry ORDER BY year))
        WHERE l2f IS NOT NULL""",
    ),
)
def e5(spark, sf):
    out = w.sequence_windows(month_panel(spark, sf), ["free_cash_flow", "cash_ratio"], 2)
    x = F.col("window")
    return rounded(
        out.select(
            "industry", "year", x[0][0].alias("oldest_flow"), x[1][0].alias("latest_flow"),
            x[1][1].alias("latest_cash"), F.col("free_cash_flow").alias("next_flow"),
        )
    )


@query(
    "e6_tail_context",
    with_ctes(
        panel() + SPLIT.format("panel"),
        body="""SELECT industry, year, round(cash_ratio, 6) AS cash_ratio FROM (
          SELECT *, row_number() OVER (PARTITION BY industry ORDER BY year DESC) AS r FROM split WHERE split = 'train')
        WHERE r <= 2""",
    ),
)
def e6(spark, sf):
    train = w.time_split(month_panel(spark, sf)).filter("split = 'train'")
    return rounded(w.tail_context(train, 2).select("industry", "year", "cash_ratio"))


@query(
    "e7_flag_shocks",
    with_ctes(
        EVENT_PANEL,
        body="""SELECT event_type, day, round(s, 6) AS shock, abs(s) > stddev_pop(s) OVER (PARTITION BY event_type) AS is_shock,
        CASE WHEN abs(s) > stddev_pop(s) OVER (PARTITION BY event_type) THEN
          CASE WHEN s < 0 THEN 'tightening' ELSE 'improvement' END END AS direction FROM (
            SELECT *, value - avg(value) OVER (PARTITION BY event_type) AS s FROM evp)""",
    ),
)
def e7(spark, sf):
    from panelwright.operators.impute import attach

    rows = event_panel(spark, sf)
    mean = rows.groupBy("event_type").agg(F.avg("value").alias("m"))
    rows = attach(rows, mean, ["event_type"], ["m"]).withColumn("shock", F.col("value") - F.col("m"))
    out = w.flag_shocks(rows, "shock", ["event_type"])
    return rounded(out.select("event_type", "day", "shock", "is_shock", "direction"))


def decomposition_sql(period):
    h = period // 2
    inner = " + ".join(f"lag(cash_ratio, {k}) OVER g" if k > 0 else f"lead(cash_ratio, {-k}) OVER g" for k in range(1 - h, h) if k)
    inner = "cash_ratio" + (" + " + inner if inner else "")
    return with_ctes(
        panel(),
        f"""tt AS (SELECT industry, year, cash_ratio, row_number() OVER g AS t, count(*) OVER (PARTITION BY industry) AS n,
          (0.5 * lag(cash_ratio, {h}) OVER g + {inner} + 0.5 * lead(cash_ratio, {h}) OVER g) / {period} AS tr
          FROM panel WINDOW g AS (PARTITION BY industry ORDER BY year)),
        ends AS (SELECT industry,
          regr_slope(tr, t - 1) FILTER (t >= {h + 1} AND t < least({h + 1 + period}, n - {h})) AS s1,
          regr_intercept(tr, t - 1) FILTER (t >= {h + 1} AND t < least({h + 1 + period}, n - {h})) AS i1,
          regr_slope(tr, t - 1) FILTER (t < n - {h} AND t >= greatest({h + 1}, n - {h} - {period})) AS s2,
          regr_intercept(tr, t - 1) FILTER (t < n - {h} AND t >= greatest({h + 1}, n - {h} - {period})) AS i2
          FROM tt GROUP BY 1),
        tre AS (SELECT tt.*, CASE WHEN t < {h + 1} THEN s1 * (t - 1) + i1 WHEN t > n - {h} THEN s2 * (t - 1) + i2
          ELSE tr END AS trend FROM tt JOIN ends USING (industry)),
        se AS (SELECT industry, (t - 1) % {period} AS slot, avg(cash_ratio - trend) AS m FROM tre GROUP BY 1, 2),
        sea AS (SELECT industry, slot, m - avg(m) OVER (PARTITION BY industry) AS seasonal FROM se)""",
        body=f"""SELECT tre.industry, year, round(cash_ratio, 6) AS observed, round(trend, 6) AS trend,
        round(seasonal, 6) AS seasonal, round(cash_ratio - trend - seasonal, 6) AS resid
        FROM tre JOIN sea ON tre.industry = sea.industry AND (t - 1) % {period} = slot""",
    )


@query("e8_decompose", decomposition_sql(12))
def e8(spark, sf):
    return rounded(w.decompose(month_panel(spark, sf), "cash_ratio", 12))


@query("e8_decompose_shortest", decomposition_sql(2))
def e8_short(spark, sf):
    return rounded(w.decompose(month_panel(spark, sf), "cash_ratio", 1))


@query(
    "e9_durbin_watson",
    with_ctes(
        panel("nation"),
        body="""SELECT industry, count(*) AS n_obs, round(sum((e - p) ** 2) / sum(e ** 2), 6) AS dw FROM (
          SELECT industry, e, lag(e) OVER (PARTITION BY industry ORDER BY year) AS p FROM (
            SELECT industry, year, cash_ratio - avg(cash_ratio) OVER (PARTITION BY industry) AS e FROM panel)) GROUP BY 1""",
    ),
)
def e9(spark, sf):
    return rounded(w.durbin_watson(demeaned(spark, sf), ["industry"], "year"))


def demeaned(spark, sf, entity="nation", col="cash_ratio"):
    """Deviations from each entity's mean, as stand-in residuals."""
    from panelwright.operators.impute import attach

    rows = month_panel(spark, sf, entity).select("industry", "year", col)
    mean = rows.groupBy("industry").agg(F.avg(col).alias("m"))
    rows = attach(rows, mean, ["industry"], ["m"])
    return rows.select("industry", "year", (F.col(col) - F.col("m")).alias("residual"))


DEMEANED = """, dm AS (SELECT industry, year, cash_ratio - avg(cash_ratio) OVER (PARTITION BY industry) AS e FROM panel)"""


def acf_cte(source, value, key, order, nlags):
    """Autocorrelations of one value column per key, as CTE ``acfs``."""
    return f"""
x0 AS (SELECT {key} AS k, {order} AS o, {value} - avg({value}) OVER (PARTITION BY {key}) AS x,
  row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS t FROM {source}),
c0 AS (SELECT k, sum(x * x) AS c, count(*) AS n FROM x0 GROUP BY 1),
cl AS (SELECT a.k, a.t - b.t AS lag, sum(a.x * b.x) AS s FROM x0 a JOIN x0 b
  ON a.k = b.k AND a.t - b.t BETWEEN 0 AND {nlags} GROUP BY 1, 2),
acfs AS (SELECT cl.k, CAST(lag AS INTEGER) AS lag, n, s / c AS r FROM cl JOIN c0 USING (k) WHERE lag <= n // 2 - 1)"""


ACF_SQL = with_ctes(
    panel() + "," + acf_cte("panel", "cash_ratio", "industry", "year", 20),
    body="""SELECT k AS industry, lag, round(r, 6) AS acf, round(r - w, 6) AS acf_ci_low, round(r + w, 6) AS acf_ci_hi FROM (
      SELECT *, CASE WHEN lag = 0 THEN 0 ELSE 1.959963984540054 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN r * r END)
        OVER (PARTITION BY k ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS w FROM acfs)""",
)


@query("e10_acf", ACF_SQL)
def e10(spark, sf):
    return rounded(ac.acf(month_panel(spark, sf), "cash_ratio", 20))


@query("e10_acf_block_layout", ACF_SQL)
def e10_blocks(spark, sf):
    return rounded(ac.acf(month_panel(spark, sf), "cash_ratio", 20, layout="blocks"))


@query(
    "e10_acf_of_global_series",
    with_ctes(
        panel() + ", gs AS (SELECT 'all' AS g, year, median(cash_ratio) AS v FROM panel GROUP BY 2),"
        + acf_cte("gs", "v", "g", "year", 39),
        body="SELECT lag, round(r, 6) AS acf FROM acfs",
    ),
)
def e10_global(spark, sf):
    from panelwright.operators.aggregate import global_series

    out = ac.acf(global_series(month_panel(spark, sf), "cash_ratio"), "cash_ratio", 39, [], "year")
    return rounded(out.select("lag", "acf"))


@query(
    "e11_pacf_first_lags",
    with_ctes(
        panel() + "," + acf_cte("panel", "cash_ratio", "industry", "year", 3)
        + """, r AS (SELECT k, any_value(n) AS n, max(r) FILTER (lag = 1) AS a, max(r) FILTER (lag = 2) AS b,
          max(r) FILTER (lag = 3) AS c FROM acfs GROUP BY 1)""",
        body="""SELECT k AS industry, 1 AS lag, round(a, 6) AS pacf, round(a + 1.959963984540054 / sqrt(n), 6) AS pacf_ci_hi FROM r
        UNION ALL SELECT k, 2, round((b - a * a) / (1 - a * a), 6),
          round((b - a * a) / (1 - a * a) + 1.959963984540054 / sqrt(n), 6) FROM r
        UNION ALL SELECT k, 3, round(p, 6), round(p + 1.959963984540054 / sqrt(n), 6) FROM (
          SELECT k, n, (a * a * a - 2 * a * b + c + a * b * b - a * a * c) / (1 - 2 * a * a + 2 * a * a * b - b * b) AS p FROM r)""",
    ),
)
def e11_first(spark, sf):
    out = ac.pacf(month_panel(spark, sf), "cash_ratio", 20).filter("lag between 1 and 3")
    return rounded(out.select("industry", "lag", "pacf", "pacf_ci_hi"))


# Durbin-Levinson: ``phi`` are the coefficients up to lag k, newest lag first in ``rr``.
PACF_CTES = """, r AS (SELECT k AS industry, any_value(n) AS n, list(r ORDER BY lag) FILTER (lag > 0) AS rr FROM acfs GROUP BY 1),
    dl AS (SELECT industry, n, rr, 1 AS lag, rr[1] AS pacf, [rr[1]] AS phi FROM r
      UNION ALL SELECT industry, n, rr, lag, pacf,
        list_append(list_transform(phi, lambda p, i: p - pacf * phi[len(phi) + 1 - i]), pacf) FROM (
        SELECT industry, n, rr, lag + 1 AS lag, phi,
          (rr[lag + 1] - list_sum(list_transform(phi, lambda p, i: p * rr[lag + 1 - i])))
            / (1 - list_sum(list_transform(phi, lambda p, i: p * rr[i]))) AS pacf FROM dl WHERE lag < len(rr))),
    zp AS (SELECT industry, n, lag, rr[lag] AS acf, pacf,
      1.959963984540054 * sqrt((1 + 2 * coalesce(list_sum(list_transform(rr[1:lag - 1], lambda v: v * v)), 0)) / n) AS aw,
      1.959963984540054 / sqrt(n) AS pw FROM dl
      UNION ALL SELECT industry, n, 0, 1.0, 1.0, 0.0, 0.0 FROM r)"""
E11_SQL = with_ctes(
    panel() + "," + acf_cte("panel", "cash_ratio", "industry", "year", 20) + PACF_CTES,
    body="""SELECT industry, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf, round(acf - aw, 6) AS acf_ci_low, round(acf + aw, 6) AS acf_ci_hi,
      round(pacf, 6) AS pacf, round(pacf - pw, 6) AS pacf_ci_low, round(pacf + pw, 6) AS pacf_ci_hi FROM zp""",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("e11_acf_pacf", E11_SQL)
def e11(spark, sf):
    """All lags of both tables."""
    return rounded(ac.acf_pacf(month_panel(spark, sf), "cash_ratio", 20))


@query(
    "e12_qq_points",
    with_ctes(
        panel("nation") + DEMEANED,
        body="""SELECT industry, i, n_obs, round(CASE WHEN i = n_obs THEN 0.5 ** (1.0 / n_obs)
          WHEN i = 1 THEN 1 - 0.5 ** (1.0 / n_obs) ELSE (i - 0.3175) / (n_obs + 0.365) END, 8) AS prob,
          round(e, 6) AS sample FROM (
          SELECT industry, e, row_number() OVER (PARTITION BY industry ORDER BY e) AS i,
            count(*) OVER (PARTITION BY industry) AS n_obs FROM dm)""",
    ),
)
def e12(spark, sf):
    return rounded(ac.qq_points(demeaned(spark, sf), ["industry"]).drop("theoretical"), 6, prob=8)


@query("e12_qq_line")
def e12_line(spark, sf):
    return rounded(ac.qq_line(ac.qq_points(demeaned(spark, sf), ["industry"]), ["industry"]))


@query(
    "e_moving_average_blocks",
    """SELECT event_id, round((value + a + b) / 3, 6) AS mean3 FROM (
      SELECT event_id, value, lag(value) OVER g AS a, lead(value) OVER g AS b FROM events
      WINDOW g AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def e_mean(spark, sf):
    """Centred means across block borders (small blocks, reach on both sides)."""
    rows = table(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    s = series(rows, ["event_type"], ["ts", "event_id"], back=1, ahead=1, layout="blocks", block_rows=500)
    mean = (s.shift("value", 1) + F.col("value") + s.shift("value", -1)) / 3
    out = s.finish(s.df.withColumn("mean3", mean)).filter("mean3 IS NOT NULL")
    return rounded(out.select("event_id", "mean3"))
