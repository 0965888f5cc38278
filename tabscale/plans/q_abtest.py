"""Registered A/B-test queries (B1-B13)."""

from __future__ import annotations

from ..operators import abtest as A
from . import fixtures as X
from .registry import register

CONT = X.SQL_FX_AB_CONT
BIN = X.SQL_FX_AB_BIN
Z = 1.959963984540054  # z_{0.975}, as computed by the operator for alpha = 0.05



def _phi(x):
    """Normal CDF in SQL by its odd power series (|x| cut at 8, where it is 0 or 1 to 15 digits)."""
    x = f"greatest(-8.0, least(8.0, {x}))"
    return (f"(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), "
            f"lambda k: pow({x}, 2 * k + 1) * exp(k * ln(2.0) + lgamma(k + 1.0) - lgamma(2.0 * k + 2)))))")


def _t_sf2(t, df):
    """Two-sided t p-value in SQL: Simpson's rule on the density over [0, |t|]."""
    n = 4000
    f = f"pow(1 + pow(abs({t}) * k / {n}, 2) / ({df}), -(({df}) + 1) / 2)"
    return (f"greatest(0.0, 1 - 2 * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi()) * abs({t}) / {3 * n} * "
            f"list_sum(list_transform(range(0, {n + 1}), lambda k: (CASE WHEN k = 0 OR k = {n} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {f})))")


_ROWS = """rows_ AS (SELECT {g}
    count(*) FILTER (WHERE arm = 'click') AS n_c, count(*) FILTER (WHERE arm = 'view') AS n_t,
    avg(outcome) FILTER (WHERE arm = 'click') AS mean_c, avg(outcome) FILTER (WHERE arm = 'view') AS mean_t,
    var_samp(outcome) FILTER (WHERE arm = 'click') AS var_c, var_samp(outcome) FILTER (WHERE arm = 'view') AS var_t
  FROM fx_ab_cont WHERE outcome IS NOT NULL {gb})"""


def _rows(by=None):
    return _ROWS.format(g=f"{by}," if by else "", gb=f"GROUP BY {by}" if by else "")


@register("ab_group_stats", X.with_ctes(
    """SELECT arm AS "group", CAST(count(*) AS BIGINT) AS n, round(avg(outcome), 4) AS mean,
       round(stddev_samp(outcome), 4) AS std, round(quantile_cont(outcome, 0.5), 4) AS median
    FROM fx_ab_cont WHERE outcome IS NOT NULL GROUP BY arm""", CONT))
def q_ab_group_stats(spark, d):
    return A.group_stats(X.fx_ab_cont(spark, d), "arm", "outcome")


@register("ab_welch_t", X.with_ctes(
    f"""SELECT segment, n_c, n_t, round(t, 6) AS t, round(df, 6) AS df, round({_t_sf2("t", "df")}, 6) AS p_value FROM (
       SELECT segment, n_c, n_t, (mean_c - mean_t) / sqrt(var_c / n_c + var_t / n_t) AS t,
       pow(var_c / n_c + var_t / n_t, 2) / (pow(var_c / n_c, 2) / (n_c - 1) + pow(var_t / n_t, 2) / (n_t - 1)) AS df
    FROM rows_)""", CONT, _rows("segment")))
def q_ab_welch_t(spark, d):
    return A.welch_t(X.fx_ab_cont(spark, d), "arm", "outcome", by=["segment"])


@register("ab_mann_whitney", X.with_ctes(
    f"""SELECT segment, n_c, n_t, u_stat, round(z, 6) AS z, round(least(1.0, 2 * (1 - {_phi("z")})), 6) AS p_value FROM (
       SELECT s.segment, n_c, n_t, round(r_c - n_c * (n_c + 1) / 2.0, 6) AS u_stat,
       (greatest(r_c - n_c * (n_c + 1) / 2.0, n_c * n_t - (r_c - n_c * (n_c + 1) / 2.0)) - n_c * n_t / 2.0 - 0.5)
             / sqrt(n_c * n_t / 12.0 * ((n_c + n_t + 1) - ties / ((n_c + n_t) * (n_c + n_t - 1.0)))) AS z
    FROM s JOIN ties USING (segment))""", CONT,
    """ranked AS (SELECT segment, arm, outcome,
        rank() OVER (PARTITION BY segment ORDER BY outcome) + (count(*) OVER (PARTITION BY segment, outcome) - 1) / 2.0 AS mr
      FROM fx_ab_cont WHERE outcome IS NOT NULL)""",
    """ties AS (SELECT segment, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM
        (SELECT segment, outcome, count(*) AS t FROM ranked GROUP BY 1, 2) GROUP BY 1)""",
    """s AS (SELECT segment, sum(mr) FILTER (WHERE arm = 'click') AS r_c,
        CAST(count(*) FILTER (WHERE arm = 'click') AS BIGINT) AS n_c,
        CAST(count(*) FILTER (WHERE arm = 'view') AS BIGINT) AS n_t FROM ranked GROUP BY 1)"""))
def q_ab_mann_whitney(spark, d):
    return A.mann_whitney(X.fx_ab_cont(spark, d), "arm", "outcome", by=["segment"])


_D = ("CASE WHEN sqrt(((n_c - 1) * var_c + (n_t - 1) * var_t) / (n_c + n_t - 2)) > 0 THEN (mean_t - mean_c) / "
      "sqrt(((n_c - 1) * var_c + (n_t - 1) * var_t) / (n_c + n_t - 2)) ELSE 0.0 END")


@register("ab_cohens_d", X.with_ctes(
    f"""SELECT round({_D}, 4) AS cohens_d, CASE WHEN abs({_D}) < 0.2 THEN 'negligible' WHEN abs({_D}) < 0.5 THEN 'small'
       WHEN abs({_D}) < 0.8 THEN 'medium' ELSE 'large' END AS interpretation FROM rows_""", CONT, _rows()))
def q_ab_cohens_d(spark, d):
    return A.cohens_d(X.fx_ab_cont(spark, d), "arm", "outcome")


@register("ab_mean_ci", X.with_ctes(
    """SELECT round(mean_t - mean_c, 4) AS mean_diff,
       round(mean_t - mean_c - 1.96 * sqrt(var_c / n_c + var_t / n_t), 4) AS ci_low,
       round(mean_t - mean_c + 1.96 * sqrt(var_c / n_c + var_t / n_t), 4) AS ci_high FROM rows_""", CONT, _rows()))
def q_ab_mean_ci(spark, d):
    return A.mean_ci(X.fx_ab_cont(spark, d), "arm", "outcome")


@register("ab_power_continuous", X.with_ctes(
    f"""SELECT segment, round(a, 6) AS power_arg, round(1 - {_phi("a")}, 6) AS power
    FROM (SELECT segment, {Z} - abs({_D}) * sqrt(n_c * n_t / (n_c + n_t)) AS a FROM rows_)""",
    CONT, _rows("segment")))
def q_ab_power_continuous(spark, d):
    return A.power_continuous(X.fx_ab_cont(spark, d), "arm", "outcome", by=["segment"])


_CT = """ct AS (SELECT a.arm, o.outcome, CAST(COALESCE(c.cnt, 0) AS BIGINT) AS count
    FROM (SELECT DISTINCT CAST(arm AS VARCHAR) AS arm FROM fx_ab_bin WHERE arm IS NOT NULL AND outcome IS NOT NULL) a
    CROSS JOIN (SELECT DISTINCT CAST(outcome AS VARCHAR) AS outcome FROM fx_ab_bin WHERE arm IS NOT NULL AND outcome IS NOT NULL) o
    LEFT JOIN (SELECT CAST(arm AS VARCHAR) AS arm, CAST(outcome AS VARCHAR) AS outcome, count(*) AS cnt FROM fx_ab_bin
               WHERE arm IS NOT NULL AND outcome IS NOT NULL GROUP BY 1, 2) c USING (arm, outcome))"""


@register("ab_contingency", X.with_ctes("SELECT * FROM ct", BIN, _CT))
def q_ab_contingency(spark, d):
    return A.contingency(X.fx_ab_bin(spark, d), "arm", "outcome", zero_cells=True)


_CHI = """chi AS (SELECT sum(dv * dv / e) AS chi2, CAST((max(nr) - 1) * (max(nc) - 1) AS BIGINT) AS dof, max(n) AS n,
        least(max(nr), max(nc)) AS k FROM (
      SELECT e, CASE WHEN (nr - 1) * (nc - 1) = 1 THEN abs(count - e) - least(0.5, abs(count - e)) ELSE abs(count - e) END AS dv,
             nr, nc, n FROM (
        SELECT count, sum(count) OVER (PARTITION BY arm) * sum(count) OVER (PARTITION BY outcome) / sum(count) OVER () AS e,
               (SELECT count(DISTINCT arm) FROM ct) AS nr, (SELECT count(DISTINCT outcome) FROM ct) AS nc,
               sum(count) OVER () AS n FROM ct)))"""


@register("ab_chi_square", X.with_ctes(
    f"""SELECT round(chi2, 6) AS chi2, dof, round(2 * (1 - {_phi("sqrt(chi2)")}), 6) AS p_value, round(sqrt(chi2 / (n * (k - 1))), 6) AS cramers_v,
       CASE WHEN sqrt(chi2 / (n * (k - 1))) < 0.1 THEN 'negligible' WHEN sqrt(chi2 / (n * (k - 1))) < 0.3 THEN 'small'
            WHEN sqrt(chi2 / (n * (k - 1))) < 0.5 THEN 'medium' ELSE 'large' END AS interpretation FROM chi""",
    BIN, _CT, _CHI))
def q_ab_chi_square(spark, d):
    return A.chi_square(X.fx_ab_bin(spark, d), "arm", "outcome")  # two by two: one degree of freedom


@register("ab_cramers_v", X.with_ctes("SELECT round(sqrt(chi2 / (n * (k - 1))), 6) AS cramers_v FROM chi", BIN, _CT, _CHI))
def q_ab_cramers_v(spark, d):
    return A.chi_square(X.fx_ab_bin(spark, d), "arm", "outcome", with_p=False).select("cramers_v")


_CONV = """cv AS (SELECT CAST(count(*) FILTER (WHERE arm = 'F') AS BIGINT) AS n_c, CAST(count(*) FILTER (WHERE arm = 'O') AS BIGINT) AS n_t,
      CAST(count(*) FILTER (WHERE arm = 'F' AND CAST(outcome AS VARCHAR) = (SELECT max(CAST(outcome AS VARCHAR)) FROM fx_ab_bin)) AS BIGINT) AS pos_c,
      CAST(count(*) FILTER (WHERE arm = 'O' AND CAST(outcome AS VARCHAR) = (SELECT max(CAST(outcome AS VARCHAR)) FROM fx_ab_bin)) AS BIGINT) AS pos_t
    FROM fx_ab_bin WHERE arm IS NOT NULL AND outcome IS NOT NULL)"""
_RC, _RT = "(pos_c / n_c)", "(pos_t / n_t)"
_POOL = "((pos_c + pos_t) / (n_c + n_t))"
_SE0 = f"sqrt({_POOL} * (1 - {_POOL}) * (1.0 / n_c + 1.0 / n_t))"


@register("ab_conversion", X.with_ctes(
    f"""SELECT n_c, n_t, pos_c, pos_t, round({_RC}, 6) AS rate_c, round({_RT}, 6) AS rate_t,
       round({_RT} - {_RC}, 6) AS rate_diff,
       round(CASE WHEN {_RC} > 0 THEN ({_RT} - {_RC}) / {_RC} * 100 ELSE 0.0 END, 6) AS lift_pct FROM cv""", BIN, _CONV))
def q_ab_conversion(spark, d):
    out = A.conversion(X.fx_ab_bin(spark, d), "arm", "outcome", with_power=False)
    return out.select("n_c", "n_t", "pos_c", "pos_t", "rate_c", "rate_t", "rate_diff", "lift_pct")


@register("ab_rate_ci_power", X.with_ctes(
    f"""SELECT round({_RT} - {_RC} - 1.96 * sqrt({_RC} * (1 - {_RC}) / n_c + {_RT} * (1 - {_RT}) / n_t), 6) AS ci_low,
       round({_RT} - {_RC} + 1.96 * sqrt({_RC} * (1 - {_RC}) / n_c + {_RT} * (1 - {_RT}) / n_t), 6) AS ci_high,
       round(CASE WHEN {_SE0} > 0 THEN ({_RT} - {_RC}) / {_SE0} ELSE 0.0 END, 6) AS z_pooled,
       round({_phi(f"abs(CASE WHEN {_SE0} > 0 THEN ({_RT} - {_RC}) / {_SE0} ELSE 0.0 END) - {Z}")}, 6) AS power FROM cv""", BIN, _CONV))
def q_ab_rate_ci_power(spark, d):
    return A.conversion(X.fx_ab_bin(spark, d), "arm", "outcome").select("ci_low", "ci_high", "z_pooled", "power")


@register("ab_normality_gate", X.with_ctes(
    """SELECT segment, max(p) FILTER (WHERE arm = 'click') AS p_control, max(p) FILTER (WHERE arm = 'view') AS p_treatment,
       bool_and(p0 > 0.05) AS normal
    FROM (SELECT segment, arm, p0, round(p0, 6) AS p FROM (
       SELECT segment, arm, exp(-n / 12.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)) AS p0 FROM (
         SELECT segment, arm, count(*) AS n, avg(pow(y - m, 2)) AS m2, avg(pow(y - m, 3)) AS m3, avg(pow(y - m, 4)) AS m4 FROM (
           SELECT segment, arm, outcome AS y, avg(outcome) OVER (PARTITION BY segment, arm) AS m
           FROM fx_ab_cont WHERE outcome IS NOT NULL) GROUP BY 1, 2))) GROUP BY segment""", CONT))
def q_ab_normality_gate(spark, d):
    return A.normality_gate(X.fx_ab_cont(spark, d), "arm", "outcome", by=["segment"])


def _ab_test_sql(by: str) -> str:
    """The whole result row: Welch where both arms pass the normality test, else Mann-Whitney."""
    g = by or "'all'"
    ctes = [CONT,
            f"""x AS (SELECT {g} AS seg, arm, outcome AS y FROM fx_ab_cont WHERE outcome IS NOT NULL)""",
            """r AS (SELECT seg, count(*) FILTER (WHERE arm = 'click') AS n_c, count(*) FILTER (WHERE arm = 'view') AS n_t,
                 avg(y) FILTER (WHERE arm = 'click') AS mean_c, avg(y) FILTER (WHERE arm = 'view') AS mean_t,
                 var_samp(y) FILTER (WHERE arm = 'click') AS var_c, var_samp(y) FILTER (WHERE arm = 'view') AS var_t FROM x GROUP BY seg)""",
            """gate AS (SELECT seg, bool_and(exp(-n / 12.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)) > 0.05) AS normal FROM (
                 SELECT seg, arm, count(*) AS n, avg(pow(y - m, 2)) AS m2, avg(pow(y - m, 3)) AS m3, avg(pow(y - m, 4)) AS m4
                 FROM (SELECT *, avg(y) OVER (PARTITION BY seg, arm) AS m FROM x) GROUP BY 1, 2) GROUP BY seg)""",
            """rk AS (SELECT seg, arm, y, rank() OVER (PARTITION BY seg ORDER BY y) + (count(*) OVER (PARTITION BY seg, y) - 1) / 2.0 AS mr FROM x)""",
            """tie AS (SELECT seg, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (SELECT seg, y, count(*) AS t FROM x GROUP BY 1, 2) GROUP BY 1)""",
            """u AS (SELECT seg, sum(mr) FILTER (WHERE arm = 'click') - r.n_c * (r.n_c + 1) / 2.0 AS u, r.n_c, r.n_t
                 FROM rk JOIN r USING (seg) GROUP BY seg, r.n_c, r.n_t)""",
            """w AS (SELECT seg, u, (greatest(u, n_c * n_t - u) - n_c * n_t / 2.0 - 0.5)
                 / sqrt(n_c * n_t / 12.0 * ((n_c + n_t + 1) - ties / ((n_c + n_t) * (n_c + n_t - 1.0)))) AS z FROM u JOIN tie USING (seg))""",
            f"""f AS (SELECT *, (mean_c - mean_t) / sqrt(var_c / n_c + var_t / n_t) AS t, {_D} AS d, sqrt(var_c / n_c + var_t / n_t) AS se,
                 pow(var_c / n_c + var_t / n_t, 2) / (pow(var_c / n_c, 2) / (n_c - 1) + pow(var_t / n_t, 2) / (n_t - 1)) AS df,
                 {Z} - abs({_D}) * sqrt(n_c * n_t / (n_c + n_t)) AS a FROM r JOIN gate USING (seg) JOIN w USING (seg))""",
            f"""p AS (SELECT *, CASE WHEN normal THEN {_t_sf2("t", "df")} ELSE least(1.0, 2 * (1 - {_phi("z")})) END AS pv FROM f)"""]
    return X.with_ctes(
        f"""SELECT {"seg AS " + by + "," if by else ""} 'continuous' AS outcome_type, 'click' AS control_label, 'view' AS treatment_label,
           n_c AS n_control, n_t AS n_treatment, CASE WHEN normal THEN 'Welch''s t-test' ELSE 'Mann-Whitney U' END AS test_name,
           round(CASE WHEN normal THEN t ELSE u END, 4) AS statistic, round(pv, 6) AS p_value, round(d, 4) AS effect_size,
           'Cohen''s d' AS effect_size_label, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small'
             WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect_interpretation,
           round(mean_t - mean_c - 1.96 * se, 4) AS ci_low, round(mean_t - mean_c + 1.96 * se, 4) AS ci_high,
           round(mean_t - mean_c, 4) AS mean_diff, round(1 - {_phi("a")}, 4) AS power, pv < 0.05 AS significant,
           normal AS normal_assumption_met, CAST(NULL AS VARCHAR) AS note FROM p""", *ctes)


@register("ab_test", _ab_test_sql(""))
def q_ab_test(spark, d):
    return A.ab_test(X.fx_ab_cont(spark, d), "arm", "outcome", id_col="event_id")


@register("ab_test_segments", _ab_test_sql("segment"))
def q_ab_test_segments(spark, d):
    return A.ab_test(X.fx_ab_cont(spark, d), "arm", "outcome", id_col="event_id", by=["segment"])


_ZP = f"(CASE WHEN {_SE0} > 0 THEN ({_RT} - {_RC}) / {_SE0} ELSE 0.0 END)"
_V = "sqrt(chi2 / (n * (k - 1)))"


@register("ab_test_binary", X.with_ctes(
    f"""SELECT 'binary' AS outcome_type, 'F' AS control_label, 'O' AS treatment_label, n_c AS n_control, n_t AS n_treatment,
       'Chi-square test' AS test_name, round(chi2, 4) AS statistic, round(2 * (1 - {_phi("sqrt(chi2)")}), 6) AS p_value,
       round({_V}, 4) AS effect_size, 'Cramér''s V' AS effect_size_label,
       CASE WHEN {_V} < 0.1 THEN 'negligible' WHEN {_V} < 0.3 THEN 'small' WHEN {_V} < 0.5 THEN 'medium' ELSE 'large' END AS effect_interpretation,
       round({_RT} - {_RC} - 1.96 * sqrt({_RC} * (1 - {_RC}) / n_c + {_RT} * (1 - {_RT}) / n_t), 4) AS ci_low,
       round({_RT} - {_RC} + 1.96 * sqrt({_RC} * (1 - {_RC}) / n_c + {_RT} * (1 - {_RT}) / n_t), 4) AS ci_high,
       round({_RC}, 6) AS rate_c, round({_RT}, 6) AS rate_t, round({_RT} - {_RC}, 4) AS rate_diff,
       round(CASE WHEN {_RC} > 0 THEN ({_RT} - {_RC}) / {_RC} * 100 ELSE 0.0 END, 2) AS lift_pct,
       round({_phi(f"abs({_ZP}) - {Z}")}, 4) AS power, 2 * (1 - {_phi("sqrt(chi2)")}) < 0.05 AS significant,
       CAST(NULL AS VARCHAR) AS note FROM cv, chi""", BIN, _CT, _CHI, _CONV))
def q_ab_test_binary(spark, d):
    return A.ab_test(X.fx_ab_bin(spark, d), "arm", "outcome", id_col="l_orderkey")
