"""Residual coefficients against least squares and adaptive weights against ridge fits, for any number of factors."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from barlake.operators import evaluation
from barlake.sources.shared import shared_path

D = lambda d: dt.date(2024, 1, 1) + dt.timedelta(days=d)


def keep(df, name):
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def factors():
    """Three dates, of which the last has few symbols; e doubles a, f is constant, g is a + b; values and forward returns are missing here and there."""
    rnd = np.random.default_rng(3)
    panel, forward = [], []
    for d, n in ((0, 40), (1, 25), (2, 6)):
        for s in range(n):
            a, b, c, y = rnd.normal(size=4)
            row = {"a": a, "b": b, "c": c, "e": 2 * a + 1, "f": 4.0, "g": a + b, "y": y + 0.3 * a, "z": 3 * a - b + 2}
            for k, v in row.items():
                if k in "efgz" or rnd.random() > 0.1:
                    panel.append((D(d), f"S{s}", k, float(v)))
            if rnd.random() > 0.1:
                forward.append((D(d), f"S{s}", 10, float(rnd.normal() + y)))
    return panel, forward


def plain(panel, forward, candidate, survivors, least=8):
    wide = pd.DataFrame(panel, columns=["Date", "Symbol", "alpha", "value"]).pivot(index=["Date", "Symbol"], columns="alpha", values="value")
    fwd = pd.DataFrame(forward, columns=["Date", "Symbol", "h", "fwd"]).set_index(["Date", "Symbol"])["fwd"]
    out = {}
    for date, w in wide.groupby(level=0):
        s = [k for k in survivors if k != candidate]
        w = w[w[candidate].notna()]
        if s:
            w = w[w[s].notna().any(axis=1)]
            if len(w) < least:
                continue
            x = np.hstack([w[s].fillna(0.0).to_numpy(), np.ones((len(w), 1))])
            res = pd.Series(w[candidate].to_numpy() - x @ np.linalg.lstsq(x, w[candidate].to_numpy(), rcond=None)[0], index=w.index)
        else:
            res = w[candidate]
        both = pd.concat([res, fwd], axis=1, join="inner").dropna()
        if len(both) >= least:
            flat = s and float(np.std(res.to_numpy())) < 1e-9
            out[date] = (0.0 if flat else float(both.iloc[:, 0].rank().corr(both.iloc[:, 1].rank())), len(both))
    return out


@pytest.mark.parametrize("survivors", [(), ("a",), ("a", "b"), ("e", "a", "f"), ("a", "b", "c", "e", "g"), ("y", "b")], ids=str)
def test_residuals_match_least_squares(spark, survivors):
    panel, forward = factors()
    p, f = spark.createDataFrame(panel, "Date date, Symbol string, alpha string, value double"), spark.createDataFrame(forward, "Date date, Symbol string, horizon int, fwd double")
    got = {(r.alpha, r.Date): (r.ic, r.n) for r in evaluation.residual_ic(p, f, ["y", "c"], survivors, 10, keep).collect()}
    want = {(c, d): v for c in ("y", "c") for d, v in plain(panel, forward, c, survivors).items()}
    assert set(got) == set(want) and all(got[k] == (pytest.approx(v[0], abs=1e-9), v[1]) for k, v in want.items()) and len(want) == 4


def test_a_combination_of_survivors_leaves_nothing(spark):
    panel, forward = factors()
    panel = [r for r in panel if r[1] not in {s for _, s, k, _ in panel if k == "a" and s == "S1"}]
    p, f = spark.createDataFrame([r for r in panel if r[2] in "eg"] + [(d, s, "q", 2 * v + 5) for d, s, k, v in panel if k == "g"], "Date date, Symbol string, alpha string, value double"), spark.createDataFrame(forward, "Date date, Symbol string, horizon int, fwd double")
    got = evaluation.residual_ic(p, f, ["q"], ["g", "e"], 10, keep).collect()
    assert got and all(r.ic == 0.0 for r in got)
    assert evaluation.residual_ic(p.limit(0), f, ["q"], ["g"], 10, keep).count() == 0


@pytest.mark.parametrize("p", [1, 2, 3, 6])
def test_adaptive_weights_match_a_ridge_fit(spark, p):
    rnd = np.random.default_rng(p)
    names = [f"k{i}" for i in range(p)]
    x = rnd.normal(size=(400, p))
    y = x @ np.linspace(0.8, 1.2, p) + 0.05 * rnd.normal(size=400)
    rows = [(D(i // 4), *map(float, x[i]), float(y[i])) for i in range(400)]
    panel = spark.createDataFrame([*rows, (D(1), *[None] * p, 1.0)], "Date date, " + ", ".join(f"{k} double" for k in names) + ", Fwd_Return double")
    targets = spark.createDataFrame([(D(95),), (D(2),)], "Date date")
    got = {r.Date: r for r in evaluation.adaptive_weights(panel, dict.fromkeys(names, 1 / p), targets, 10, "Validation Positive", drift=0.5).collect()}
    m = 4 * 86  # dates up to ten days before
    beta = np.abs(np.linalg.solve(x[:m].T @ x[:m] + np.eye(p), x[:m].T @ y[:m]))
    fit = beta / beta.sum()
    want = 1 / p + np.clip(0.2 * (fit - 1 / p), -0.05, 0.05)
    want /= want.sum()
    assert got[D(95)].N == m and got[D(95)].Dormant_Reason is None and [got[D(95)][f"Weight_{k + 1}"] for k in range(p)] == pytest.approx(list(want), abs=1e-12)
    assert "insufficient effective history" in got[D(2)].Dormant_Reason and got[D(2)].Weight_1 == pytest.approx(1 / p)
    dormant = evaluation.adaptive_weights(panel, dict.fromkeys(names, 1 / p), targets, 10, "Unknown").collect()
    assert len(dormant) == 2 and all("verdict" in r.Dormant_Reason for r in dormant)
    if p == 2:
        same = panel.withColumn("k1", panel["k0"])
        assert evaluation.adaptive_weights(same, dict.fromkeys(names, 0.5), targets.where("Date > '2024-02-01'"), 10, "Validation Positive").first().Dormant_Reason == "alpha collinearity"
        uneven = evaluation.adaptive_weights(panel.withColumn("k1", panel["k1"] * 100), dict.fromkeys(names, 0.5), targets.where("Date > '2024-02-01'"), 10, "Validation Positive").first()
        assert uneven.Dormant_Reason == "total drift exceeds cap"
    with pytest.raises(ValueError):
        evaluation.adaptive_weights(panel.withColumnRenamed("k0", "Symbol"), {}, targets, 1, "")


def test_rank_correlations_and_turnover_in_wide_form(spark):
    """Against pandas, with ties, nulls and a factor that does not vary; rows are shuffled once for all factors and horizons."""
    rnd = random.Random(5)
    some = lambda: rnd.choice([None, 0.0, 0.0, 1.0, rnd.gauss(0, 1)])
    rows = [(dt.date(2024, 1, d), f"S{k}", some(), some(), 3.0, some(), some()) for d in range(1, 5) for k in range(40 if d < 4 else 6)]
    df = spark.createDataFrame(rows, "Date date, Symbol string, a double, b double, flat double, fwd_5 double, fwd_10 double")
    names, p = ["a", "b", "flat"], pd.DataFrame(rows, columns=df.columns)
    want = {}
    for d, g in p.groupby("Date"):
        for a in names:
            for h in (5, 10):
                both = g[[a, f"fwd_{h}"]].dropna().rank()
                if len(both) >= 8 and a != "flat":
                    want[d, a, h] = (pytest.approx(both.corr().iloc[0, 1]), len(both))
    ic = evaluation.spearman_ic(df, names, (5, 10))
    assert {(r.Date, r.alpha, r.horizon): (r.ic, r.n) for r in ic.collect()} == want and len(want) == 12
    assert ic._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    share = p.groupby("Date")[names].rank(pct=True).assign(Date=p.Date, Symbol=p.Symbol).sort_values("Date")
    moved = pd.concat([share.dropna(subset=[a]).groupby("Symbol")[a].diff().abs().rename(a) for a in names], axis=1).groupby(share.Date).mean().mean() / 2
    got = {r.alpha: r.Turnover for r in evaluation.factor_turnover(df, names).collect()}
    assert got == {a: pytest.approx(moved[a]) for a in names}
