"""Whether factors rank what follows: information coefficients of every factor, date and horizon."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.frames import average_rank, correlation
from barlake.functions.ranks import Keep, average_ranks, codes, rounded

#: Gates of promotion. Fixed values.
LEAST_IC, LEAST_T = 0.03, 2.0


def calendar(bars: DataFrame) -> DataFrame:
    """(Date, idx): the shared calendar's sessions, numbered. One row a date."""
    return bars.select("Date").distinct().withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("Date")).cast("long"))


def forward_returns_panel(bars: DataFrame, horizons=(5, 10, 21)) -> DataFrame:
    """(Date, Symbol, horizon, fwd): close h sessions of the shared calendar later; missing where the symbol has no bar then."""
    df = _with_later(bars.select("Symbol", "Date", "Close"), bars, horizons)
    each = df.select("Date", "Symbol", "Close", F.explode(F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"_later{h}").alias("later")) for h in horizons))).alias("x")).where("x.later is not null")
    return each.select("Date", "Symbol", "x.horizon", (F.col("x.later.Close") / F.nullif(F.col("Close"), F.lit(0.0)) - 1).alias("fwd"))


def _with_later(df: DataFrame, bars: DataFrame, horizons) -> DataFrame:
    """df with the symbol's close (a struct; null without a bar) h sessions later, from one sort of each symbol's bars."""
    dated = df.join(F.broadcast(calendar(bars)), "Date")  # a row a date
    at = Window.partitionBy("Symbol").orderBy("idx")
    return dated.withColumns({f"_later{h}": F.first(F.struct("Close")).over(at.rangeBetween(h, h)) for h in horizons})


def forward_columns(bars: DataFrame, horizons=(5, 10, 21)) -> DataFrame:
    """Bars with fwd_h for each horizon: as forward_returns_panel, a column a horizon."""
    df = _with_later(bars, bars, horizons)
    return df.select(*bars.columns, *((F.col(f"_later{h}.Close") / F.nullif(F.col("Close"), F.lit(0.0)) - 1).alias(f"fwd_{h}") for h in horizons))


def _coefficients(names: Sequence[str], horizons: Sequence[int], least: int):
    """Rank correlations of one date's factors with its forward returns."""

    def run(table: pa.Table) -> pa.Table:
        coded = {c: codes(pa.chunked_array([rounded(table.column(c))])) for c in (*names, *(f"fwd_{h}" for h in horizons))}
        rows = []
        for a in names:
            for h in horizons:
                both = coded[a][0] & coded[f"fwd_{h}"][0]
                n = int(both.sum())
                if n < least:
                    continue
                ra, rf = (average_ranks(coded[c][1][both]) - (n + 1) / 2 for c in (a, f"fwd_{h}"))
                size = np.sqrt((ra @ ra) * (rf @ rf))
                if size > 0:
                    rows.append((a, h, float(ra @ rf / size), n))
        alpha, horizon, ic, n = ([r[i] for r in rows] for i in range(4))
        date = pa.array([table.column("Date")[0].as_py()] * len(rows), pa.date32())
        return pa.table({"Date": date, "alpha": pa.array(alpha, pa.string()), "horizon": pa.array(horizon, pa.int64()), "ic": pa.array(ic, pa.float64()), "n": pa.array(n, pa.int64())})

    return run


def spearman_ic(wide: DataFrame, names: Sequence[str], horizons: Sequence[int] = (5, 10, 21), least: int = 8) -> DataFrame:
    """(Date, alpha, horizon, ic, n): correlation of average ranks over the symbols that have both, where there are `least`.

    wide: Date, Symbol, a column a factor, and fwd_h. Rows are shuffled once by date, each with all its factors and returns; values are compared at 10 decimals. A date's
    cross-section is one group of a task: its columns of numbers.
    """
    columns = [*names, *(f"fwd_{h}" for h in horizons)]
    rows = wide.select("Date", *(F.col(c).cast("double").alias(c) for c in columns))
    return rows.groupBy("Date").applyInArrow(_coefficients(list(names), list(horizons), least), "Date date, alpha string, horizon long, ic double, n long")


def ic_report(ic: DataFrame, least: int = 3) -> DataFrame:
    """Per factor and horizon: dates, mean, deviation, t statistic and the share of dates with the mean's sign.

    Signs are those of coefficients and means at 10 decimals, so that float noise about zero has none.
    """
    sign = lambda c: F.signum(F.round(c, 10))
    mean = ic.groupBy("alpha", "horizon").agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.count(F.lit(1)).alias("n_dates"), F.count_if(sign("ic") > 0).alias("up"), F.count_if(sign("ic") < 0).alias("down"))
    hit = F.when(sign("mean_ic") > 0, F.col("up") / F.col("n_dates")).when(sign("mean_ic") < 0, F.col("down") / F.col("n_dates")).otherwise(0.5)
    t = F.when(F.col("std_ic") > 0, F.col("mean_ic") / (F.col("std_ic") / F.sqrt("n_dates")))
    enough = F.col("n_dates") >= least
    return mean.select("alpha", "horizon", "n_dates", *(F.when(enough, c).alias(k) for k, c in {"mean_ic": F.col("mean_ic"), "std_ic": F.col("std_ic"), "t_stat": t, "hit_rate": hit}.items()))


def promote_alphas(report: DataFrame) -> DataFrame:
    """Factors whose mean coefficient and t statistic pass the gates at some horizon, each with its best one."""
    good = report.where((F.abs("mean_ic") >= LEAST_IC) & (F.abs("t_stat") >= LEAST_T))
    best = Window.partitionBy("alpha").orderBy(F.round(F.abs("mean_ic"), 10).desc(), F.round(F.abs("t_stat"), 10).desc(), "horizon")
    return good.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def eval_dates(bars: DataFrame, lookback: int = 250, most: int = 20) -> DataFrame:
    """(Date): of the last `lookback` sessions every max(1, n // 20)th, the last `most` of these."""
    last = calendar(bars).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where(F.col("idx") > F.col("n") - lookback)
    i = F.col("idx") - 1 - F.greatest(F.col("n") - lookback, F.lit(0))
    size = F.least(F.col("n"), F.lit(lookback))
    step = F.greatest(F.lit(1), F.floor(size / most)).cast("long")
    chosen = last.where(i % step == 0)
    return chosen.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("Date").desc()))).where(F.col("_k") <= most).select("Date")


def _solved(g: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Coefficients of normal equations, by Cholesky; a column that the ones before it already hold gets the coefficient 0."""
    p = len(right)
    low, used, z = np.zeros((p, p)), np.zeros(p, bool), np.zeros(p)
    for k in range(p):
        pivot = g[k, k] - low[k] @ low[k]
        if pivot > 1e-10 * g[k, k] and pivot > 0:
            used[k] = True
            low[k:, k] = (g[k:, k] - low[k:] @ low[k]) / np.sqrt(pivot)
            z[k] = (right[k] - low[k, :k] @ z[:k]) / low[k, k]
    beta = np.zeros(p)
    for k in reversed(range(p)):
        if used[k]:
            beta[k] = (z[k] - low[k + 1 :, k] @ beta[k + 1 :]) / low[k, k]
    return beta


def _projections(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Coefficients of a row's normal equations."""
    for frame in frames:
        out = []
        for gram, right in zip(frame["gram"], frame["right"], strict=True):
            p = len(right)
            g = np.zeros((p, p))
            g[np.triu_indices(p)] = gram
            out.append(_solved(g + np.triu(g, 1).T, right).tolist())
        yield frame[["Date", "alpha"]].assign(beta=out)


def residual_ic(panel: DataFrame, forward: DataFrame, candidates: Sequence[str], survivors: Sequence[str], horizon: int, keep: Keep, least: int = 8) -> DataFrame:
    """(Date, alpha, ic, n): rank correlation of forward returns with what the surviving factors and a constant leave of each candidate (panel: Date, Symbol, alpha, value).

    Any number of survivors; without any, the candidate's own rank correlation. A candidate does not survive against itself. Symbols without any survivor's value do not
    count, a single missing one counts as 0. Normal equations come from one aggregate a date; survivors that others already hold change nothing. ic is 0 where nothing is
    left (deviation below 1e-9). Dates with fewer than `least` symbols give no row. keep(df, name) writes a table and returns it.
    """
    names = list(dict.fromkeys([*candidates, *survivors]))
    pivot = panel.where(F.col("alpha").isin(*names)).groupBy("Date", "Symbol").agg(*(F.max(F.when(F.col("alpha") == k, F.col("value"))).alias(f"v_{k}") for k in names))
    wide = keep(pivot, "factors")
    each = None
    for c in candidates:
        rest = [s for s in survivors if s != c]
        known = F.coalesce(*(F.col(f"v_{s}") for s in rest)).isNotNull() if rest else F.lit(True)
        # of one length for all candidates: a candidate's own place holds 0
        x = F.array(*(F.lit(0.0) if s == c else F.coalesce(F.col(f"v_{s}"), F.lit(0.0)) for s in survivors)).cast("array<double>")
        part = wide.where(F.col(f"v_{c}").isNotNull() & known).select("Date", "Symbol", F.lit(c).alias("alpha"), F.col(f"v_{c}").alias("y"), x.alias("x"))
        each = part if each is None else each.unionByName(part)
    # the regression takes all symbols that have the factors, the correlation those that have a forward return too
    rows, p, keys = keep(each, "candidates"), len(survivors), ["Date", "alpha"]
    at = lambda i: F.col("x")[i]
    gram = [F.covar_pop(at(i), at(j)) for i in range(p) for j in range(i, p)]
    empty = F.array().cast("array<double>")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("y").alias("_y"), (F.array(*(F.avg(at(i)) for i in range(p))) if p else empty).alias("_x"),
        (F.array(*gram) if p else empty).alias("gram"), (F.array(*(F.covar_pop(at(i), "y") for i in range(p))) if p else empty).alias("right"),
    )
    sums = keep(sums.where(F.col("_n") >= least), "normal_equations")
    beta = keep(sums.select(*keys, "gram", "right").mapInPandas(_projections, "Date date, alpha string, beta array<double>"), "coefficients")
    fit = F.aggregate(F.zip_with(F.zip_with("x", "_x", lambda a, b: a - b), "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    left = rows.join(sums.select(*keys, "_y", "_x").join(beta.hint("merge"), keys).hint("merge"), keys).select("Date", "Symbol", "alpha", (F.col("y") - F.col("_y") - fit).alias("res"))
    spread = Window.partitionBy(*keys)
    left = left.withColumn("_flat", F.stddev_pop("res").over(spread) < 1e-9)
    both = left.join(forward.where(F.col("horizon") == horizon).select("Date", "Symbol", "fwd").hint("merge"), ["Date", "Symbol"]).where("fwd is not null")
    both = both.withColumns({"ra": average_rank(F.col("res"), *keys), "rf": average_rank(F.col("fwd"), *keys)})
    ic = F.when(F.bool_and("_flat"), 0.0).otherwise(F.coalesce(correlation("ra", "rf"), F.lit(0.0)))
    return both.groupBy(*keys).agg(ic.alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _residuals(candidates: Sequence[str], survivors: Sequence[str], fwd: str, least: int):
    """Rank correlations of one date's residuals with its forward returns."""

    def run(table: pa.Table) -> pa.Table:
        there = {c: table.column(c).is_valid().to_numpy() for c in {*candidates, *survivors, fwd}}
        value = {c: np.where(v, table.column(c).to_numpy(), 0.0) for c, v in there.items()}
        rows = []
        for a in candidates:
            rest = [s for s in survivors if s != a]
            mine = there[a] & np.logical_or.reduce([there[s] for s in rest]) if rest else there[a]
            if mine.sum() < least:
                continue
            y = value[a][mine] - value[a][mine].mean()
            x = np.stack([value[s][mine] - value[s][mine].mean() for s in rest]) if rest else np.zeros((0, len(y)))
            left = y - _solved(x @ x.T / len(y), x @ y / len(y)) @ x
            both = there[fwd][mine]
            n = int(both.sum())
            if n < least:
                continue
            ic = 0.0
            if left.std() >= 1e-9:
                ra, rf = (average_ranks(np.unique(np.round(v[both], 10), return_inverse=True)[1]) - (n + 1) / 2 for v in (left, value[fwd][mine]))
                size = np.sqrt((ra @ ra) * (rf @ rf))
                ic = float(ra @ rf / size) if size > 0 else 0.0
            rows.append((a, ic, n))
        alpha, ic, n = ([r[i] for r in rows] for i in range(3))
        date = pa.array([table.column("Date")[0].as_py()] * len(rows), pa.date32())
        return pa.table({"Date": date, "alpha": pa.array(alpha, pa.string()), "ic": pa.array(ic, pa.float64()), "n": pa.array(n, pa.int64())})

    return run


def residual_columns(wide: DataFrame, candidates: Sequence[str], survivors: Sequence[str], horizon: int, least: int = 8) -> DataFrame:
    """(Date, alpha, ic, n): as residual_ic, from rows with a column a factor and fwd_h, which are shuffled once by date and never unfolded.

    A date's cross-section is one group of a task: its columns of numbers.
    """
    fwd = f"fwd_{horizon}"
    rows = wide.select("Date", *dict.fromkeys([*candidates, *survivors]), fwd)
    return rows.groupBy("Date").applyInArrow(_residuals(list(candidates), list(survivors), fwd, least), "Date date, alpha string, ic double, n long")


def promotion_log(report: DataFrame, residual: DataFrame, least: float = 0.015, signed: bool = True) -> DataFrame:
    """(alpha, horizon, Decision, Reason): promoted where the factor passes its own gate and its mean residual IC (alpha, residual) the least; unsigned compares sizes."""
    own = (F.abs("mean_ic") >= LEAST_IC) & (F.abs("t_stat") >= LEAST_T)
    left = F.col("residual") if signed else F.abs("residual")
    reason = F.when(~F.coalesce(own, F.lit(False)), "fails standalone gate").when(F.col("residual").isNull(), "no residual evidence").when(left < least, "adds nothing beyond survivors").otherwise("passes both gates")
    return report.join(residual.hint("shuffle_hash"), "alpha", "left").select("alpha", "horizon", F.when(reason == "passes both gates", "promote").otherwise("reject").alias("Decision"), reason.alias("Reason"))


def alpha_evidence_table(log: DataFrame, report: DataFrame, n: int = 20) -> DataFrame:
    """(Place, alpha, horizon, Decision, mean_ic): promoted first, then by the size of the mean IC; the first n. A row a factor and horizon."""
    both = report.join(log.hint("shuffle_hash"), ["alpha", "horizon"], "full")
    order = Window.partitionBy(F.lit(1)).orderBy((F.coalesce("Decision", F.lit("")) == "promote").desc(), F.round(F.abs("mean_ic"), 8).desc_nulls_last(), "alpha", "horizon")
    return both.withColumn("Place", F.row_number().over(order).cast("long")).where(F.col("Place") <= n).select("Place", "alpha", "horizon", "Decision", "mean_ic")


def _shares(names: Sequence[str]):
    """Percentiles of one date's factors."""

    def run(table: pa.Table) -> pa.Table:
        out = {"Date": table.column("Date"), "Symbol": table.column("Symbol")}
        for c in names:
            there, places = codes(table.column(c))
            share = np.zeros(len(places))
            if there.any():
                share[there] = average_ranks(places[there]) / there.sum()
            out[c] = pa.array(share, pa.float64(), mask=~there)
        return pa.table(out)

    return run


def factor_turnover(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """(alpha, Turnover): mean over dates of half the mean change of the factor's percentiles from each symbol's row before that has the factor.

    wide: Date, Symbol, a column a factor. Rows are shuffled once by date and once by symbol, with all their factors.
    """
    rows = wide.select("Date", "Symbol", *(F.round(c, 10).alias(c) for c in names))
    shares = rows.groupBy("Date").applyInArrow(_shares(list(names)), "Date date, Symbol string, " + ", ".join(f"`{c}` double" for c in names))
    before = Window.partitionBy("Symbol").orderBy("Date").rowsBetween(Window.unboundedPreceding, -1)
    moved = shares.select("Date", *(F.abs(F.col(c) - F.last(c, ignorenulls=True).over(before)).alias(c) for c in names))
    day = moved.groupBy("Date").agg(*(F.avg(c).alias(c) for c in names))
    return day.unpivot(["Date"], list(names), "alpha", "t").groupBy("alpha").agg((F.avg("t") / 2).alias("Turnover"))


def turnover_weights(report: DataFrame, turnover: DataFrame, baseline: float, penalty: float = 0.5) -> DataFrame:
    """(alpha, Weight) from (alpha, mean_ic, Gated): gated factors share what the held ones leave by |IC| / (1 + penalty * turnover); others hold the baseline; weights add up to 1. A row a factor."""
    w = Window.partitionBy(F.lit(1))
    df = report.join(turnover.hint("shuffle_hash"), "alpha", "left").withColumn("_raw", F.when(F.col("Gated"), F.abs("mean_ic") / (1 + penalty * F.coalesce("Turnover", F.lit(0.0)))))
    held = F.coalesce(F.sum(F.when(~F.col("Gated"), F.lit(baseline))).over(w), F.lit(0.0))
    df = df.withColumn("_w", F.when(F.col("Gated"), F.col("_raw") / F.nullif(F.sum("_raw").over(w), F.lit(0.0)) * F.greatest(1 - held, F.lit(0.0))).otherwise(baseline))
    return df.withColumn("Weight", F.col("_w") / F.nullif(F.sum("_w").over(w), F.lit(0.0))).select("alpha", "Weight")


#: (regime, family, multiplier); others are 1. Fixed values.
TILTS = (("RISK_OFF", "momentum", 0.5), ("RISK_OFF", "reversal", 2.0), ("RISK_OFF", "volatility", 2.0), ("RISK_ON", "momentum", 2.0), ("RISK_ON", "reversal", 0.75), ("RISK_ON", "volatility", 0.5))


def regime_tilt(alphas: DataFrame, regimes: DataFrame) -> DataFrame:
    """(Date, alpha, Regime, Multiplier) of factors (alpha, family) under each date's regime; labels are compared without case, - as _."""
    regime = F.upper(F.translate("Regime", "-", "_"))
    mult = F.lit(1.0)
    for r, family, value in TILTS:
        mult = F.when((F.col("Regime") == r) & (F.col("family") == family), value).otherwise(mult)
    known = F.when(regime.isin("RISK_OFF", "RISK_ON"), regime).otherwise("NEUTRAL")
    return regimes.select("Date", known.alias("Regime")).join(F.broadcast(alphas)).select("Date", "alpha", "Regime", mult.alias("Multiplier"))


def adaptive_panel(wide: DataFrame, names: tuple[str, ...], horizon: int) -> DataFrame:
    """(Date, one column a factor, Fwd_Return) of rows (Date, a column a factor, fwd_h) that have all of them; no symbol is kept."""
    return wide.select("Date", *names, F.col(f"fwd_{horizon}").alias("Fwd_Return")).dropna()


def _fitted(base: list[float], ridge: float, shrink: float, step: float, drift: float, most_corr: float, least_dates: int):
    """Weights of each target's sums, or the reason that they stay at the baseline."""
    b0, p = np.array(base), len(base)

    def fit(n, dates, one, two, right):
        if dates < least_dates:
            return b0, f"insufficient effective history (N_eff={int(dates)}, need {least_dates})"
        if n < 3 * p:
            return b0, f"too few clean rows ({int(n)}) vs alphas ({p})"
        gram = np.zeros((p, p))
        gram[np.triu_indices(p)] = two
        gram = gram + np.triu(gram, 1).T
        cov = gram / n - np.outer(one, one) / n**2
        size = np.sqrt(np.maximum(np.diag(cov), 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            corr = np.nan_to_num(np.abs(cov / np.outer(size, size)), nan=0.0, posinf=0.0)
        np.fill_diagonal(corr, 0)
        if round(float(corr.max(initial=0.0)), 8) > most_corr:
            return b0, "alpha collinearity"
        size_of = np.abs(np.linalg.solve(gram + ridge * np.eye(p), right))
        if not size_of.sum() > 0:
            return b0, "zero-signal coefficients"
        fitted = size_of / size_of.sum()
        if round(float(np.abs(fitted - b0).sum()), 8) > drift:
            return b0, "total drift exceeds cap"
        w = b0 + np.clip(shrink * (fitted - b0), -step, step)
        return (w / w.sum() if w.sum() > 0 else w), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [fit(*x) for x in zip(f["n"], f["dates"], f["one"].map(np.asarray), f["two"].map(np.asarray), f["right"].map(np.asarray), strict=True)]
            weights = {f"Weight_{k + 1}": [float(w[k]) for w, _ in got] for k in range(p)}
            yield pd.DataFrame({"Date": f["Date"], "N": f["n"].astype("int64"), **weights, "Dormant_Reason": [why for _, why in got]})

    return run


def adaptive_weights(panel: DataFrame, baseline: dict[str, float], targets: DataFrame, horizon_days: int, verdict: str, ridge: float = 1.0, shrink: float = 0.20, step: float = 0.05, drift: float = 0.30, most_corr: float = 0.8, least_dates: int = 60) -> DataFrame:
    """(Date, N, Weight_1 ... Weight_p, Dormant_Reason) for each target date: the p factors' weights from a ridge regression on the rows known by then, in the order of `baseline`.

    panel: Date, a column a factor, Fwd_Return, no symbol. Sums of products over all rows up to `horizon_days` before the target come from one window over the dates' sums, a row a date,
    so every target is fitted in one pass; each small system is solved from its sums alone. A guard that does not hold leaves the baseline and names itself: the verdict,
    fewer than `least_dates` dates, fewer than 3 p rows, two factors that correlate beyond `most_corr`, no signal, or a drift beyond `drift` in all.
    """
    names = list(baseline)
    if not names or {"Symbol", "Ticker", "ISIN", "SecurityId"} & set(panel.columns):
        raise ValueError("needs factors, and no column that names securities")
    p = len(names)
    x, y = [F.col(c) for c in names], F.col("Fwd_Return")
    terms = {"n": F.lit(1.0), **{f"s{i}": x[i] for i in range(p)}, **{f"s{i}_{j}": x[i] * x[j] for i in range(p) for j in range(i, p)}, **{f"b{i}": x[i] * y for i in range(p)}}
    day = panel.dropna(subset=[*names, "Fwd_Return"]).groupBy("Date").agg(*(F.sum(v).alias(k) for k, v in terms.items())).withColumn("dates", F.lit(1.0))
    terms["dates"] = F.lit(1.0)
    at = targets.select(F.date_sub("Date", horizon_days).alias("_at"), F.col("Date").alias("_target"))
    both = day.select(F.col("Date").alias("_at"), *terms, F.lit(0).alias("_t"), F.lit(None).cast("date").alias("_target")).unionByName(at.select("_at", *(F.lit(0.0).alias(k) for k in terms), F.lit(1).alias("_t"), "_target"))
    upto = Window.partitionBy(F.lit(1)).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)  # a row a date
    df = both.withColumns({k: F.sum(k).over(upto) for k in terms}).where("_t = 1")
    listed = df.select(F.col("_target").alias("Date"), "n", "dates", F.array(*(f"s{i}" for i in range(p))).alias("one"), F.array(*(f"s{i}_{j}" for i in range(p) for j in range(i, p))).alias("two"), F.array(*(f"b{i}" for i in range(p))).alias("right"))
    base = [float(v) for v in baseline.values()]
    if verdict != "Validation Positive":
        return listed.select("Date", F.col("n").cast("long").alias("N"), *(F.lit(v).alias(f"Weight_{k + 1}") for k, v in enumerate(base)), F.lit(f"validation verdict='{verdict}' (need Validation Positive)").alias("Dormant_Reason"))
    schema = "Date date, N long, " + ", ".join(f"Weight_{k + 1} double" for k in range(p)) + ", Dormant_Reason string"
    return listed.mapInPandas(_fitted(base, ridge, shrink, step, drift, most_corr, least_dates), schema)
