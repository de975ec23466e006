"""Registered queries of factor promotion, weights and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake import panel
from barlake.operators import alphas, changes, evaluation, signals, validation
from barlake.plans import sql
from barlake.plans.books import _FEAR, _SHARE, fear
from barlake.plans.more import FORWARD, REPORT, _ic, factors
from barlake.plans.queries import _detail, matured, queries, r4, r4x, register, table

_DATES = "select distinct Date from bars"


@register("eval_dates", f"with {sql.BARS}, c as (select Date, row_number() over (order by Date) - 1 as i, count(*) over () as n from ({_DATES})), l as (select Date, i - greatest(n - 250, 0) as j, greatest(1, least(n, 250) // 20) as step from c where i >= n - 250), k as (select Date, row_number() over (order by Date desc) as k from l where j % step = 0) select Date from k where k <= 20")
def eval_dates(spark, sf_dir):
    return evaluation.eval_dates(panel.bars(spark, sf_dir))


RES = f"""{FORWARD}, rw0 as (select Date, Symbol, max(case when alpha = 'breakout' then value end) as y, max(case when alpha = 'amihud' then value end) as v1, max(case when alpha = 'mean_rev_z' then value end) as v2 from panel where alpha in ('breakout', 'amihud', 'mean_rev_z') group by 1, 2),
rw as (select Date, Symbol, y, coalesce(v1, 0) as x1, coalesce(v2, 0) as x2 from rw0 where y is not null and coalesce(v1, v2) is not null),
rs as (select *, count(*) over w as k, covar_pop(x1, x1) over w as s11, covar_pop(x2, x2) over w as s22, covar_pop(x1, x2) over w as s12, covar_pop(x1, y) over w as s1, covar_pop(x2, y) over w as s2, avg(y) over w as my, avg(x1) over w as m1, avg(x2) over w as m2 from rw window w as (partition by Date)),
rb as (select *, case when s11 > 0 and s22 * s11 - s12 * s12 > 1e-10 * s11 * s22 then (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) when s11 <= 0 and s22 > 0 then s2 / s22 else 0 end as b2 from rs where k >= 8),
rr as (select Date, Symbol, y - my - b2 * (x2 - m2) - (case when s11 > 0 then (s1 - s12 * b2) / s11 else 0 end) * (x1 - m1) as res from rb),
rf as (select *, stddev_pop(res) over (partition by Date) as sd from rr),
rj as (select rf.*, fwd from rf join fwd using (Date, Symbol) where fwd is not null and horizon = 10),
rk as (select Date, sd, {sql.pr('res', 'Date')} as ra, {sql.pr('fwd', 'Date')} as rf from rj), ric as (select Date, case when max(sd) < 1e-9 or corr(ra, rf) is null or isnan(corr(ra, rf)) then 0.0::double else corr(ra, rf) end as ic, count(*) as n from rk group by 1 having count(*) >= 8)"""


def _residual(spark, sf_dir):
    return evaluation.residual_columns(factors(spark, sf_dir, ("breakout", "amihud", "mean_rev_z"), (10,)), ["breakout"], ["amihud", "mean_rev_z"], 10)


@register("residual_ic", f"with {RES} select Date, n, {sql.r4('ic')} from ric")
def residual_ic(spark, sf_dir):
    return _residual(spark, sf_dir).select("Date", "n", *r4("ic"))


@register("residual_ic_promoted")
def residual_ic_promoted(spark, sf_dir):
    """Every factor against all that promote_alphas promotes; the driver holds their names."""
    wide = table(factors(spark, sf_dir).drop("Symbol"), "alphas")
    promoted = evaluation.promote_alphas(evaluation.ic_report(evaluation.spearman_ic(wide, tuple(alphas.REGISTRY))))
    survivors = sorted(r["alpha"] for r in promoted.collect())
    return evaluation.residual_columns(wide, list(alphas.REGISTRY), survivors, 10).select("Date", "alpha", "n", *r4("ic"))


_LOG = f"""{RES}, {REPORT[len(FORWARD):].lstrip(', ')}, res as (select 'breakout' as alpha, avg(ic) as residual from ric),
lg as (select alpha, horizon, mean_ic, case when not coalesce(abs(mean_ic) >= 0.03 and abs(t_stat) >= 2, false) then 'fails standalone gate' when residual is null then 'no residual evidence' when residual < 0.015 then 'adds nothing beyond survivors' else 'passes both gates' end as Reason from report left join res using (alpha))"""


def _log(spark, sf_dir):
    report = table(evaluation.ic_report(_ic(spark, sf_dir)), "report")
    residual = _residual(spark, sf_dir).agg(F.avg("ic").alias("residual")).select(F.lit("breakout").alias("alpha"), "residual")
    return report, evaluation.promotion_log(report, residual)


@register("promotion_log", f"with {_LOG} select alpha, horizon, case when Reason = 'passes both gates' then 'promote' else 'reject' end as Decision, Reason from lg")
def promotion_log(spark, sf_dir):
    return _log(spark, sf_dir)[1]


@register("alpha_evidence_table", f"with {_LOG}, k as (select *, row_number() over (order by (Reason = 'passes both gates') desc, round(abs(mean_ic), 8) desc nulls last, alpha, horizon) as Place from lg) select Place, alpha, horizon, case when Reason = 'passes both gates' then 'promote' else 'reject' end as Decision, {sql.r4('mean_ic')} from k where Place <= 20")
def alpha_evidence_table(spark, sf_dir):
    report, log = _log(spark, sf_dir)
    return evaluation.alpha_evidence_table(log, report).select("Place", "alpha", "horizon", "Decision", *r4("mean_ic"))


_TURN = f"tp as (select alpha, Symbol, Date, {sql.pr('value', 'Date', 'alpha')} as p from panel), td as (select alpha, Date, abs(p - lag(p) over (partition by alpha, Symbol order by Date)) as d from tp), turn as (select alpha, avg(t) / 2 as Turnover from (select alpha, Date, avg(d) as t from td group by 1, 2) group by 1)"


@register("turnover_weights", f"""with {REPORT}, {_TURN}, g as (select alpha, mean_ic, coalesce(abs(mean_ic) >= 0.03 and abs(t_stat) >= 2, false) as Gated from report where horizon = 10), r as (select *, case when Gated then abs(mean_ic) / (1 + 0.5 * coalesce(Turnover, 0)) end as raw from g left join turn using (alpha)),
w as (select *, case when Gated then raw / nullif(sum(raw) over (), 0) * greatest(1 - coalesce(sum(case when not Gated then 0.05 end) over (), 0), 0) else 0.05 end as w from r) select alpha, {sql.r4x('w / nullif(sum(w) over (), 0)')} as Weight from w""")
def turnover_weights(spark, sf_dir):
    gated = F.coalesce((F.abs("mean_ic") >= evaluation.LEAST_IC) & (F.abs("t_stat") >= evaluation.LEAST_T), F.lit(False))
    names = tuple(alphas.REGISTRY)
    wide = table(factors(spark, sf_dir, horizons=(10,)), "alphas")
    report = evaluation.ic_report(evaluation.spearman_ic(wide, names, (10,))).select("alpha", "mean_ic", gated.alias("Gated"))
    return evaluation.turnover_weights(report, evaluation.factor_turnover(wide, names), 0.05).select("alpha", *r4("Weight"))


_FAMILY = ", ".join(f"('{k}', '{v[0]}')" for k, v in alphas.REGISTRY.items())


@register("regime_tilt", f"""with {sql.BARS}, {_FEAR}, p as (select Date, {_SHARE.format(least=60, op='<=')} as q from fear window w as (order by Date rows between 251 preceding and current row)),
m as (select Date, case when count(*) over (order by Date) >= 55 then (Benchmark_Close / lag(Benchmark_Close, 49) over (order by Date) - 1) * 100 end as t, q from bench left join p using (Date)), r as (select Date, case when q is null then 'NEUTRAL' when coalesce(t, 0) > 2 and q < 40 then 'RISK_ON' when coalesce(t, 0) < -3 or q > 70 then 'RISK_OFF' else 'NEUTRAL' end as Regime from m),
f(alpha, family) as (values {_FAMILY}) select Date, alpha, Regime, case {' '.join(f"when Regime = '{r}' and family = '{f}' then {v}" for r, f, v in evaluation.TILTS)} else 1.0 end::double as Multiplier from r cross join f""")
def regime_tilt(spark, sf_dir):
    names = spark.createDataFrame([(k, v[0]) for k, v in alphas.REGISTRY.items()], "alpha string, family string")
    return evaluation.regime_tilt(names, signals.macro_tape(panel.benchmark(panel.bars(spark, sf_dir)), fear(spark, sf_dir)))


_NAMES = ("mean_rev_z", "up_ratio", "gap")
_PANEL = f"{FORWARD}, ap0 as (select Date, Symbol, {', '.join(f'max(case when alpha = {chr(39)}{k}{chr(39)} then value end) as {k}' for k in _NAMES)} from panel where alpha in {_NAMES} group by 1, 2), ap as (select ap0.*, fwd as Fwd_Return from ap0 join fwd using (Date, Symbol) where horizon = 10 and {' and '.join(f'{k} is not null' for k in _NAMES)} and fwd is not null)"


def _adaptive(spark, sf_dir):
    return evaluation.adaptive_panel(factors(spark, sf_dir, _NAMES, (10,)), _NAMES, 10)


@register("adaptive_panel", f"with {_PANEL} select Date, count(*) as n, {', '.join(f'round(avg({k}) + 0.00000137::double, 4) as {k}' for k in (*_NAMES, 'Fwd_Return'))} from ap group by 1")
def adaptive_panel(spark, sf_dir):
    return _adaptive(spark, sf_dir).groupBy("Date").agg(F.count(F.lit(1)).alias("n"), *(r4x(F.avg(k)).alias(k) for k in (*_NAMES, "Fwd_Return")))


_DET = "({0}0_0 * ({0}1_1 * {0}2_2 - {0}1_2 * {0}1_2) - {0}0_1 * ({0}0_1 * {0}2_2 - {0}1_2 * {0}0_2) + {0}0_2 * ({0}0_1 * {0}1_2 - {0}1_1 * {0}0_2))"
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_TERMS = {f"s{i}": k for i, k in enumerate(_NAMES)} | {f"s{i}_{j}": f"{_NAMES[i]} * {_NAMES[j]}" for i, j in _PAIRS} | {f"b{i}": f"{k} * Fwd_Return" for i, k in enumerate(_NAMES)}


def _cramer(k: int) -> str:
    """The k-th unknown's numerator of the ridge system m beta = b."""
    m = [[f"m{min(i, j)}_{max(i, j)}" if j != k else f"b{i}" for j in range(3)] for i in range(3)]
    return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"


_CORR = ", ".join(f"coalesce(abs(s{i}_{j} / n - s{i} / n * s{j} / n) / nullif(sqrt(greatest(s{i}_{i} / n - (s{i} / n) ** 2, 0) * greatest(s{j}_{j} / n - (s{j} / n) ** 2, 0)), 0), 0)" for i, j in _PAIRS if i != j)
_ADAPT = f"""{_PANEL}, ad as (select Date, count(*) as n, {', '.join(f'sum({v}) as {k}' for k, v in _TERMS.items())} from ap group by 1),
tg as (select distinct Date from bars), tt as (select t.Date, coalesce(sum(n), 0)::double as n, count(a.Date) as dates, {', '.join(f'sum({k}) as {k}' for k in _TERMS)} from tg t left join ad a on a.Date <= t.Date - 70 group by 1),
am as (select *, {', '.join(f"s{i}_{j} + {1.0 if i == j else 0.0}::double as m{i}_{j}" for i, j in _PAIRS)}, greatest({_CORR}) as corr from tt),
ai as (select *, {', '.join(f"abs({_cramer(k)} / {_DET.format('m')}) as i{k}" for k in range(3))} from am),
af as (select *, {', '.join(f"i{k} / (i0 + i1 + i2) as f{k}" for k in range(3))} from ai),
aw as (select *, case when dates < 60 then 'insufficient effective history (N_eff=' || dates || ', need 60)' when n < 9 then 'too few clean rows (' || n::bigint || ') vs alphas (3)' when round(corr, 8) > 0.8 then 'alpha collinearity' when not i0 + i1 + i2 > 0 then 'zero-signal coefficients'
  when round(abs(f0 - 1 / 3.0::double) + abs(f1 - 1 / 3.0::double) + abs(f2 - 1 / 3.0::double), 8) > 0.3 then 'total drift exceeds cap' end as why, {', '.join(f"1 / 3.0::double + least(greatest(0.2 * (f{k} - 1 / 3.0::double), -0.05), 0.05) as w{k}" for k in range(3))} from af)"""
_WEIGHTS = {f"Weight_{k + 1}": sql.r4x(f"case when why is null then w{k} / (w0 + w1 + w2) else 1 / 3.0::double end") for k in range(3)}


@register("adaptive_weights", f"with {_ADAPT} select Date, n::bigint as N, {', '.join(f'{v} as {k}' for k, v in _WEIGHTS.items())}, why as Dormant_Reason from aw")
def adaptive_weights(spark, sf_dir):
    """As if validation were positive, with the usual caps; adaptive_weights_gated takes the computed verdict."""
    dates = panel.bars(spark, sf_dir).select("Date").distinct()
    got = evaluation.adaptive_weights(_adaptive(spark, sf_dir), dict.fromkeys(_NAMES, 1 / 3), dates, 70, "Validation Positive")
    return got.select("Date", "N", *r4("Weight_1", "Weight_2", "Weight_3"), "Dormant_Reason")


@register("adaptive_weights_gated")
def adaptive_weights_gated(spark, sf_dir):
    """Six factors, under the verdict that the validation of 10 days gives (one row)."""
    six = (*_NAMES, "breakout", "amihud", "low_vol")
    b = panel.bars(spark, sf_dir)
    rows = evaluation.adaptive_panel(factors(spark, sf_dir, six, (10,)), six, 10)
    verdict = queries()["verdict"](spark, sf_dir).where("Horizon_Days = 10").select("Verdict").first()
    got = evaluation.adaptive_weights(rows, dict.fromkeys(six, 1 / 6), b.select("Date").distinct(), 70, verdict["Verdict"] if verdict else "")
    return got.select("Date", "N", *r4(*(f"Weight_{k}" for k in range(1, 7))), "Dormant_Reason")


_DELIV = "dl as (select 'S' || l_suppkey as Symbol, date_trunc('week', l_shipdate)::date as Date, round(avg(l_discount), 6) as Delivery_Pct from lineitem group by 1, 2)"


def _delivery(spark, sf_dir):
    line = panel.table(spark, sf_dir, "lineitem")
    return line.groupBy(panel.symbol("l_suppkey").alias("Symbol"), F.date_trunc("week", "l_shipdate").cast("date").alias("Date")).agg(F.round(F.avg("l_discount"), 6).alias("Delivery_Pct"))


@register("alpha_delivery_mom", f"with {_DELIV}, v as (select Symbol, Date, case when count(Delivery_Pct) over w20 >= 20 then avg(Delivery_Pct) over w5 - avg(Delivery_Pct) over w20 end as value from dl window w5 as (partition by Symbol order by Date rows between 4 preceding and current row), w20 as (partition by Symbol order by Date rows between 19 preceding and current row)) select Symbol, Date, {sql.r4x('value')} as value from v")
def alpha_delivery_mom(spark, sf_dir):
    return alphas.delivery_momentum(_delivery(spark, sf_dir)).select("Symbol", "Date", *r4("value"))


@register("alpha_iv_rank", f"with {sql.BARS}, {_DELIV}, w as (select Symbol, Date, Delivery_Pct as Value, list(Delivery_Pct) over (partition by Symbol order by Date rows between 252 preceding and 1 preceding) as v from dl where dayofyear(Date) % 2 = 0), r as (select Symbol, Date, len(list_filter(v, lambda x: x < Value)) / len(v)::double * 100 as IV_Rank from w where len(v) >= 1) select b.Symbol, b.Date, {sql.r4x('IV_Rank')} as value from bars b asof left join r on r.Symbol = b.Symbol and r.Date <= b.Date")
def alpha_iv_rank(spark, sf_dir):
    """The rank of a value that is quoted every other day, as of each bar."""
    from barlake.sources.readers import iv_rank_daily

    quoted = _delivery(spark, sf_dir).where(F.dayofyear("Date") % 2 == 0).select("Symbol", "Date", F.col("Delivery_Pct").alias("IV"))
    return alphas.asof_overlay(panel.bars(spark, sf_dir), iv_rank_daily(quoted), "IV_Rank").select("Symbol", "Date", r4x(F.col("IV_Rank")).alias("value"))


@register("pandas_alpha", f"with {sql.BARS}, v as (select Symbol, Date, case when row_number() over w >= 10 then avg(Close / Open) over (partition by Symbol order by Date rows between 9 preceding and current row) end as value from bars window w as (partition by Symbol order by Date)) select Date, Symbol, {sql.r4x('value')} as value from v where value is not null")
def pandas_alpha(spark, sf_dir):
    alphas.register_pandas_alpha("open_close", "reversal", lambda f: (f["Close"] / f["Open"]).rolling(10).mean())
    return alphas.pandas_alpha(panel.bars(spark, sf_dir), "open_close").select("Date", "Symbol", *r4("value"))


@register("validation_detail", f"with {sql.MATURED}, k as (select *, (length(Symbol) % 2 + 1) as v from matured) select Symbol, Signal_Date, Horizon_Days, {sql.r4('Net_Forward_Return')} from k where v = 2 and lower(trim(Opportunity_Eligible)) = 'yes'")
def validation_detail(spark, sf_dir):
    """Forward returns with the history rows of schema 2 (told here by the symbol's length) that are eligible."""
    m = table(matured(spark, sf_dir), "matured")
    history = m.select(F.col("Signal_Date").alias("Date"), "Symbol", "Opportunity_Eligible", (F.length("Symbol") % 2 + 1).alias("Schema_Version")).distinct()
    return validation.validation_detail(m.drop("Opportunity_Eligible"), history).select("Symbol", "Signal_Date", "Horizon_Days", *r4("Net_Forward_Return"))


@register("validation_diagnosis", f"with {sql.MATURED} select Horizon_Days, count(distinct Signal_Date) as Dates, count(distinct case when Net_Forward_Return is not null then Signal_Date end) as Matured_Dates, min(Signal_Date) as First_Date, max(Signal_Date) as Last_Date, count(distinct Symbol) - count(distinct case when Net_Forward_Return is not null then Symbol end) as Symbols_Lost, count(*) filter (Reason is not null) as Unmatured from matured group by 1")
def validation_diagnosis(spark, sf_dir):
    return validation.validation_diagnosis(matured(spark, sf_dir))


def _span(section: str, item: str, date: str, source: str) -> str:
    return f"select '{section}' as Section, '{item}' as Item, count(*) as Rows, count(distinct {date}) as Dates, min({date})::date as First_Date, max({date})::date as Last_Date from {source}"


@register("validation_coverage", f"""with {sql.MATURED}, h as (select distinct Signal_Date as Date, Symbol, Confidence_Adjusted_Score as cas, length(Symbol) % 2 + 1 as v from matured), r as (select * from matured where Net_Forward_Return is not null), u as (select * from r where Horizon_Days = 10), b as (select * from bars where Symbol not like '%7'),
g as (select Signal_Date, count(*) as n from u where lower(trim(Opportunity_Eligible)) = 'yes' and exists (select 1 from h where h.v = 2 and h.cas is not null and h.Date = u.Signal_Date and h.Symbol = u.Symbol) group by 1)
{_span('schema', 'v1', 'Date', 'h where v = 1')} union all {_span('schema', 'v2', 'Date', 'h where v = 2')} union all {_span('schema', 'v2 without score', 'Date', 'h where v = 2 and cas is null')} union all {_span('matured', 'rows', 'Signal_Date', 'u')} union all {_span('overlap', 'rows', 'Signal_Date', 'u where Signal_Date in (select Date from h where v = 2)')}
union all {_span('breadth', 'usable dates', 'Signal_Date', 'g where n >= 10')} union all {_span('breadth', 'thin dates', 'Signal_Date', 'g where n < 10')} union all select 'reason', Reason, count(*), 0, null, null from matured where Reason is not null group by Reason union all {_span('prices', 'bars', 'Date', 'b')}
union all select 'lost', 'symbols', count(*), 0, null, null from (select distinct Symbol from h where Symbol not in (select Symbol from b))""")
def validation_coverage(spark, sf_dir):
    """Schema 2 is told by the symbol's length, as in validation_detail; symbols that end in 7 have left the price file."""
    m = table(matured(spark, sf_dir), "matured")
    history = m.select(F.col("Signal_Date").alias("Date"), "Symbol", "Confidence_Adjusted_Score", (F.length("Symbol") % 2 + 1).alias("Schema_Version")).distinct()
    bars = panel.bars(spark, sf_dir).where(~F.col("Symbol").endswith("7"))
    return validation.validation_coverage(history, m.where("Net_Forward_Return is not null"), m, bars)


@register("evidence_fallback", f"with {sql.DETAIL} select Horizon_Days, count(distinct Signal_Date) as Dates, {sql.r4x('quantile_cont(case when Score_Quintile = 5 then Net_Forward_Return end, 0.5) - quantile_cont(case when Score_Quintile = 1 then Net_Forward_Return end, 0.5)')} as Median_Gap from detail group by 1")
def evidence_fallback(spark, sf_dir):
    return validation.evidence_fallback(_detail(spark, sf_dir)).select("Horizon_Days", "Dates", *r4("Median_Gap"))
