"""Queries: the monthly panel, portfolios, evidence records and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import stats as st
from tapewright.operators import panel as pn
from tapewright.operators import validation as va
from tapewright.plans import views
from tapewright.plans.q_bars import tidy
from tapewright.plans.registry import R, held, part, query
from tapewright.session import cut_lineage

c = F.col
HELD = 10
SEEDS = 25

part("months", "SELECT month, row_number() OVER (ORDER BY month) - 1 AS month_no FROM (SELECT DISTINCT month FROM pnl)")
part("pm", "SELECT p.*, m.month_no FROM pnl p JOIN months m ON m.month = p.month")


def _form_sql(form: int, skip: int) -> str:
    return f"""
    SELECT '{form}-{skip}' AS label, p.symbol, p.month, p.month_no, p.close, n.close AS next_close,
           CASE WHEN a.close > 0 THEN z.close / a.close - 1.0 END AS form_ret, CASE WHEN p.close > 0 THEN n.close / p.close - 1.0 END AS fwd
    FROM pm p JOIN pm a ON a.symbol = p.symbol AND a.month_no = p.month_no - {form}
    JOIN pm z ON z.symbol = p.symbol AND z.month_no = p.month_no - {skip}
    LEFT JOIN pm n ON n.symbol = p.symbol AND n.month_no = p.month_no + 1"""


part("forms", " UNION BY NAME ".join(f"({_form_sql(f, s)})" for f, s in pn.FORMATIONS))
part("elig", f"""
    SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY label, month) AS n_eligible FROM forms WHERE form_ret IS NOT NULL AND next_close IS NOT NULL)
    WHERE n_eligible >= {3 * HELD}""")
part("picks", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, month ORDER BY form_ret DESC, symbol DESC) AS rnk FROM elig) WHERE rnk <= {HELD}""")


def _returns_sql(src: str, by: str) -> str:
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in by.split(", "))
    return f"""
    SELECT {by}, month, gross - 2.0 * changed * 0.0005 AS ret, changed FROM (
      SELECT {', '.join('x.' + k for k in by.split(', '))}, x.month, avg(x.fwd) AS gross, count(*) FILTER (WHERE y.symbol IS NULL) / count(*) AS changed
      FROM (SELECT *, dense_rank() OVER (PARTITION BY {by} ORDER BY month) AS q FROM {src}) x
      LEFT JOIN (SELECT {by}, symbol, dense_rank() OVER (PARTITION BY {by} ORDER BY month) + 1 AS q FROM {src}) y
      ON {on('x', 'y')} AND x.symbol = y.symbol AND x.q = y.q
      GROUP BY ALL) WHERE gross IS NOT NULL"""


part("strat", _returns_sql("picks", "label"))
part("floyd", f"""
    SELECT label, month, n_eligible, seed, CAST(n_eligible - {HELD} AS BIGINT) AS j, CAST([] AS BIGINT[]) AS acc
    FROM (SELECT DISTINCT label, month, n_eligible FROM elig) CROSS JOIN (SELECT unnest(range(1000, {1000 + SEEDS})) AS seed)
    UNION ALL
    SELECT label, month, n_eligible, seed, j + 1, list_append(acc, CASE WHEN list_contains(acc, t) THEN j ELSE t END)
    FROM (SELECT *, ('0x' || substr(md5(CAST(seed AS VARCHAR) || '|' || month || '|' || CAST(j AS VARCHAR)), 1, 8))::BIGINT % (j + 1) AS t
          FROM floyd WHERE j < n_eligible)""")
part("rpicks", """
    SELECT f.label, f.seed, f.month, e.symbol, e.fwd
    FROM (SELECT label, month, seed, unnest(acc) AS pick FROM floyd WHERE j = n_eligible) f
    JOIN (SELECT *, row_number() OVER (PARTITION BY label, month ORDER BY ('0x' || substr(md5(symbol), 1, 8))::BIGINT % 64, symbol) - 1 AS pick FROM elig) e
    ON e.label = f.label AND e.month = f.month AND e.pick = f.pick""")
part("rstrat", _returns_sql("rpicks", "label, seed"))
part("pairs", """
    SELECT s.label, s.month, s.ret, n.null_ret, s.ret - n.null_ret AS diff FROM strat s
    JOIN (SELECT label, month, avg(ret) AS null_ret FROM rstrat GROUP BY ALL) n ON n.label = s.label AND n.month = s.month""")


def eligible(spark, sf):
    return held("eligible", spark, sf, lambda: pn.eligible_sizes(views.panel_table(spark, sf), held=HELD))


def strategy(spark, sf):
    return pn.strategy_returns(eligible(spark, sf)[0], HELD)


def random_series(spark, sf):
    return pn.random_returns(*eligible(spark, sf), HELD, SEEDS)


def pairs(spark, sf):
    return held("pairs", spark, sf, lambda: cut_lineage(pn.paired_null(strategy(spark, sf), random_series(spark, sf))))


def records(spark, sf):
    return held("records", spark, sf, lambda: cut_lineage(pn.validation_record(pairs(spark, sf))))


@query("month_ends", """
    SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS month_end FROM lineitem GROUP BY 1""")
def month_ends(spark, sf):
    days = views.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return pn.month_ends(days).select("month", c("month_end").cast("string").alias("month_end"))


@query("simple_return", f"""
    SELECT p.symbol, p.month, {R('CASE WHEN p.close > 0 THEN n.close / p.close - 1.0 END')} AS fwd
    FROM pm p LEFT JOIN pm n ON n.symbol = p.symbol AND n.month_no = p.month_no + 1""")
def simple_return(spark, sf):
    return tidy(pn.monthly_returns(views.panel_table(spark, sf)).select("symbol", "month", "fwd"))


@query("momentum_rank", f"""
    SELECT symbol, month, {R('form_ret')} AS form_ret, rnk AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY month ORDER BY form_ret DESC, symbol DESC) AS rnk FROM forms WHERE label = '12-2' AND form_ret IS NOT NULL)
    WHERE rnk <= {HELD}""")
def momentum_rank(spark, sf):
    return tidy(pn.momentum_rank(views.panel_table(spark, sf), 12, 2, HELD).select("symbol", "month", "form_ret", "rank"))


@query("momentum_portfolio", f"SELECT label, month, {R('ret')} AS ret FROM strat")
def momentum_portfolio(spark, sf):
    return tidy(strategy(spark, sf))


@query("random_portfolio", f"SELECT label, CAST(seed AS BIGINT) AS seed, month, {R('ret')} AS ret FROM rstrat")
def random_portfolio(spark, sf):
    return tidy(random_series(spark, sf))


@query("turnover_cost", f"SELECT label, month, {R('changed')} AS changed, {R('2.0 * changed * 0.0005')} AS cost FROM strat")
def turnover_cost(spark, sf):
    picks = cut_lineage(pn.top_names(eligible(spark, sf)[0], HELD).select("label", "month", "symbol"))
    out = pn.turnover_share(picks, ["label"])
    return tidy(out.withColumn("cost", pn.turnover_cost(c("changed"), 5.0)))


@query("paired_null", f"SELECT label, month, {R('ret')} AS ret, {R('null_ret')} AS null_ret, {R('diff')} AS diff FROM pairs")
def paired_null(spark, sf):
    return tidy(pairs(spark, sf))


@query("paired_t", f"SELECT label, count(*) AS n, {R('avg(diff) / (stddev_samp(diff) / sqrt(count(*)))')} AS t FROM pairs GROUP BY label")
def paired_t(spark, sf):
    return tidy(pairs(spark, sf).groupBy("label").agg(F.count("diff").alias("n"), st.t_stat(c("diff")).alias("t")))


part("idx_level", "SELECT strftime(l_shipdate, '%Y-%m') AS month, round(avg(l_extendedprice / l_quantity), 4) AS level FROM lineitem GROUP BY 1")


@query("benchmark_returns", f"""
    SELECT u.month, {R('u.r')} AS universe_ret, {R('i.r')} AS index_ret, {R('coalesce(i.r, 0.0)')} AS paired_index_ret
    FROM (SELECT p.month, p.month_no, avg(CASE WHEN p.close > 0 THEN n.close / p.close - 1.0 END) AS r FROM pm p
          JOIN pm n ON n.symbol = p.symbol AND n.month_no = p.month_no + 1 WHERE p.month_no >= 12 GROUP BY ALL) u
    LEFT JOIN (SELECT m.month_no, CASE WHEN a.level > 0 THEN b.level / a.level - 1.0 END AS r FROM months m JOIN months k ON k.month_no = m.month_no + 1
               LEFT JOIN idx_level a ON a.month = m.month LEFT JOIN idx_level b ON b.month = k.month) i ON i.month_no = u.month_no
    WHERE u.r IS NOT NULL""")
def benchmark_returns(spark, sf):
    lines = views.table(spark, sf, "lineitem")
    index = lines.groupBy(F.date_format(F.to_date("l_shipdate"), "yyyy-MM").alias("month")).agg(
        F.round(F.avg(c("l_extendedprice") / c("l_quantity")), 4).alias("level"))
    return tidy(pn.benchmark_returns(views.panel_table(spark, sf), index))


@query("annualise", f"SELECT label, {R('100.0 * (exp(sum(ln(1.0 + ret)) * 12.0 / count(*)) - 1.0)', 4)} AS ann_pct FROM strat GROUP BY label")
def annualise(spark, sf):
    return tidy(strategy(spark, sf).groupBy("label").agg(st.annualise(c("ret")).alias("ann_pct")), 4)


@query("sharpe", f"SELECT label, {R('avg(ret) / stddev_samp(ret) * sqrt(12.0)')} AS sharpe FROM strat GROUP BY label")
def sharpe(spark, sf):
    return tidy(strategy(spark, sf).groupBy("label").agg(st.sharpe(c("ret")).alias("sharpe")))


_t = lambda x, cond: f"avg({x}) FILTER ({cond}) / (stddev_samp({x}) FILTER ({cond}) / sqrt(count({x}) FILTER ({cond})))"
part("halved", "SELECT *, row_number() OVER (PARTITION BY label ORDER BY month) AS rn, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY diff DESC, month DESC) AS best FROM pairs")


@query("split_half", f"""
    SELECT label, {R('avg(diff) FILTER (WHERE rn <= n // 2)')} AS first_mean, {R(_t('diff', 'WHERE rn <= n // 2'))} AS first_t,
           {R('avg(diff) FILTER (WHERE rn > n // 2)')} AS second_mean, {R(_t('diff', 'WHERE rn > n // 2'))} AS second_t,
           min(month) FILTER (WHERE rn > n // 2) AS boundary,
           (avg(diff) FILTER (WHERE rn <= n // 2) > 0) = (avg(diff) FILTER (WHERE rn > n // 2) > 0) AS same_sign
    FROM halved GROUP BY label""")
def split_half(spark, sf):
    return tidy(pn.split_half(pairs(spark, sf), ["label"], "month", "diff"))


_k = "greatest(1, CAST(round_even(0.01 * n, 0) AS BIGINT))"


@query("drop_best", f"SELECT label, month, {R('diff')} AS diff FROM halved WHERE best > {_k}")
def drop_best(spark, sf):
    return tidy(pn.drop_best(pairs(spark, sf), ["label"], "diff", "month").select("label", "month", "diff"))


@query("drop_best_floor", f"SELECT label, month, {R('diff')} AS diff FROM halved WHERE best > greatest(1, n // 100)")
def drop_best_floor(spark, sf):
    return tidy(pn.drop_best_floor(pairs(spark, sf), ["label"], "diff", "month").select("label", "month", "diff"))


@query("concentration", f"""
    SELECT label, count(*) AS n, {R('avg(diff) / (stddev_samp(diff) / sqrt(count(*)))')} AS t_all, {R(_t('diff', f'WHERE best > {_k}'))} AS t_cut,
           (avg(diff) > 0) <> (avg(diff) FILTER (WHERE best > {_k}) > 0) AS flips FROM halved GROUP BY label""")
def concentration(spark, sf):
    return tidy(pn.concentration(pairs(spark, sf), ["label"], "diff", "month"))


part("records", f"""
    SELECT label AS signal, count(*) AS n_trades, avg(diff) AS mean_r, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS t_vs_null,
           {_t('diff', 'WHERE rn > floor(n * 0.7)')} AS holdout_t,
           avg(diff) > 0 AND avg(diff) FILTER (WHERE best > {_k}) > 0 AS survives_concentration, min(month) || '..' || max(month) AS tested_on
    FROM halved GROUP BY label""")


@query("validation_record", f"""
    SELECT signal, n_trades, {R('mean_r')} AS mean_r, {R('t_vs_null')} AS t_vs_null, {R('holdout_t')} AS holdout_t, survives_concentration, tested_on FROM records""")
def validation_record(spark, sf):
    return tidy(records(spark, sf))


_fails = """list_filter([CASE WHEN n_trades < 200 THEN 'too_few_trades' END, CASE WHEN NOT coalesce(mean_r > 0, false) THEN 'mean_not_positive' END,
    CASE WHEN NOT coalesce(t_vs_null >= 2.5, false) THEN 't_below_bar' END, CASE WHEN NOT coalesce(holdout_t > 0, false) THEN 'holdout_sign' END,
    CASE WHEN NOT coalesce(survives_concentration, false) THEN 'concentrated' END], lambda x: x IS NOT NULL)"""


@query("validation_failures", f"SELECT signal, array_to_string({_fails}, '; ') AS failures, len({_fails}) = 0 AS passes FROM records")
def validation_failures(spark, sf):
    rec = records(spark, sf)
    fails = va.validation_failures()
    return rec.select("signal", F.array_join(fails, "; ").alias("failures"), (F.size(fails) == 0).alias("passes"))


_drift = """list_filter([CASE WHEN g.win <> 'monthly/10' THEN 'window_differs' END, CASE WHEN abs(g.s - r.s) > 1e-9 THEN 'stop_differs' END,
    CASE WHEN abs(g.t - r.t) > 1e-9 THEN 'target_differs' END], lambda x: x IS NOT NULL)"""


@query("may_trade", f"""
    SELECT g.signal, coalesce(len(list_concat({_fails}, {_drift})) = 0, false) AND r.signal IS NOT NULL AS allowed,
           CASE WHEN r.signal IS NULL THEN 'no_record' ELSE array_to_string(list_concat({_fails}, {_drift}), '; ') END AS reason
    FROM (SELECT DISTINCT label AS signal, 'monthly/10' AS win, 12.0::DOUBLE AS s, 2.0::DOUBLE AS t FROM strat UNION
          SELECT DISTINCT label || '-new', 'monthly/10', 12.0, 2.0 FROM strat) g
    LEFT JOIN (SELECT *, CAST(split_part(signal, '-', 1) AS DOUBLE) AS s, CAST(split_part(signal, '-', 2) AS DOUBLE) AS t FROM records) r ON r.signal = g.signal""")
def may_trade(spark, sf):
    """Live settings 12-2 against every record, and against unknown names."""
    rec = records(spark, sf).withColumns({
        "window": F.lit("monthly/10"), "stop_atr": F.split("signal", "-")[0].cast("double"),
        "target_atr": F.split("signal", "-")[1].cast("double")})
    names = rec.select("signal")
    both = names.unionByName(names.select(F.concat("signal", F.lit("-new")).alias("signal")))
    live = both.withColumns({"window": F.lit("monthly/10"), "stop_atr": F.lit(12.0), "target_atr": F.lit(2.0)})
    return va.may_trade(live, rec).select("signal", "allowed", "reason")


@query("monthly_replication", f"""
    SELECT s.label, count(*) AS months, {R('avg(100.0 * s.ret)', 5)} AS own_mean, {R('avg(p.r)', 5)} AS published_mean,
           {R('avg(100.0 * s.ret - p.r)', 5)} AS mean_diff, {R('corr(100.0 * s.ret, p.r)')} AS correlation
    FROM strat s JOIN (SELECT month, avg(100.0 * ret) AS r FROM rstrat WHERE label = '12-2' GROUP BY month) p ON p.month = s.month GROUP BY s.label""")
def monthly_replication(spark, sf):
    """The mean random portfolio stands in for the published months."""
    published = random_series(spark, sf).filter("label = '12-2'").groupBy("month").agg(F.avg(100.0 * c("ret")).alias("ret_pct"))
    own = strategy(spark, sf).withColumn("ret_pct", 100.0 * c("ret"))
    out = pn.monthly_replication(own, published, ["label"])
    return out.select("label", "months", *[F.round(k, 5).alias(k) for k in ("own_mean", "published_mean", "mean_diff")],
                      (F.round("correlation", 6) + 0.0).alias("correlation"))
