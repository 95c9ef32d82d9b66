"""Operators against brute force on small panels with ties and missing values."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import cross_section, elementwise, time_series
from strandline.operators import backtest, etl, evaluate, report, select
from strandline.plans import expression as ex
from strandline.plans.compiler import evaluate as run
from strandline.plans.grammar import Grammar

N = 5


def panel(spark, x, y=None):
    """Arrays (date, stock), nan where missing."""
    none = lambda v: None if v is None or math.isnan(v) else float(v)
    rows = [(t, f"s{s}", none(x[t, s]), none((y if y is not None else x)[t, s])) for t in range(x.shape[0]) for s in range(x.shape[1])]
    return spark.createDataFrame(rows, "t int, stock string, close double, open double")


def matrix(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for t, s, v in df.select("t", "stock", name).collect():
        out[t, int(s[1:])] = np.nan if v is None else v
    return out


@pytest.fixture(scope="module")
def xy():
    rng = np.random.default_rng(5)
    x, y = rng.integers(1, 9, (30, 6)).astype(float), rng.integers(1, 9, (30, 6)).astype(float)
    x[rng.random(x.shape) < 0.06] = np.nan
    y[rng.random(y.shape) < 0.06] = np.nan
    x[3] = 4.0
    return x, y


def ranks(v):
    return np.array([(v < a).sum() + ((v == a).sum() - 1) / 2 for a in v])


SECTION = {
    "cs_rank": lambda v: (ranks(v) + 0.5) / len(v),
    "cs_zscore": lambda v: (v - v.mean()) / v.std() if v.std() > 1e-12 else v * np.nan,
    "cs_demean": lambda v: v - v.mean(),
    "cs_scale": lambda v: v / np.abs(v).sum(),
    "cs_normalize": lambda v: (v - v.min()) / (v.max() - v.min() + 1e-12),
    "cs_winsorize": lambda v: np.clip(v, *np.quantile(v, [0.05, 0.95])),
    "cs_truncate": lambda v: np.where((v >= np.quantile(v, 0.05)) & (v <= np.quantile(v, 0.95)), v, np.nan),
    "cs_quantile": lambda v: ranks(v) / (len(v) - 1),
    "cs_rank_gauss": lambda v: np.array([statistics.NormalDist().inv_cdf((r + 0.5) / len(v)) for r in ranks(v)]),
}


def ema(v):
    e = v[0]
    for a in v[1:]:
        e = 2 / (N + 1) * a + (1 - 2 / (N + 1)) * e
    return e


def slope(v):
    t = np.arange(len(v)) - (len(v) - 1) / 2
    return (t * v).sum() / (t * t).sum()


SERIES = {
    "ts_mean": np.mean, "ts_std": np.std, "ts_max": np.max, "ts_min": np.min, "ts_sum": np.sum, "ts_rank": lambda v: ((v < v[-1]).sum() + 0.5 * (v == v[-1]).sum()) / N,
    "ts_argmax": lambda v: float(N - 1 - np.argmax(v[::-1])), "ts_argmin": lambda v: float(N - 1 - np.argmin(v[::-1])), "ts_wma": lambda v: (v * np.arange(1, N + 1)).sum() / (N * (N + 1) / 2),
    "ts_slope": slope, "ts_residual": lambda v: v[-1] - v.mean() - slope(v) * (N - 1) / 2, "ts_zscore": lambda v: (v[-1] - v.mean()) / v.std() if v.std() > 1e-12 else np.nan,
    "ts_position": lambda v: (v[-1] - v.min()) / (v.max() - v.min() + 1e-12), "ts_range": np.ptp,
}


@pytest.mark.parametrize("op", SECTION)
def test_sections(spark, xy, op):
    x, want = xy[0], np.full(xy[0].shape, np.nan)
    for t, row in enumerate(x):
        ok = ~np.isnan(row)
        if ok.sum() >= 2:
            want[t, ok] = SECTION[op](row[ok])
    got = matrix(run(panel(spark, x), {"v": f"{op}(close)"}), x.shape)
    np.testing.assert_allclose(got, want, atol=1e-8 if op == "cs_rank_gauss" else 1e-12)


def test_series(spark, xy):
    x = xy[0]
    out = run(panel(spark, x), {op: f"{op}(close, {N})" for op in [*SERIES, "ts_ema", "ts_delay", "ts_delta"]})
    for op, f in SERIES.items():
        want = np.full(x.shape, np.nan)
        for t in range(N - 1, len(x)):
            for s in range(x.shape[1]):
                v = x[t - N + 1 : t + 1, s]
                if not np.isnan(v).any():
                    want[t, s] = f(v)
        np.testing.assert_allclose(matrix(out, x.shape, op), want, atol=1e-10, err_msg=op)
    want = np.full(x.shape, np.nan)
    for s in range(x.shape[1]):
        run_ = []
        for t in range(len(x)):
            run_ = [] if np.isnan(x[t, s]) else [*run_, x[t, s]]
            if len(run_) >= N:
                want[t, s] = ema(run_)
    np.testing.assert_allclose(matrix(out, x.shape, "ts_ema"), want, atol=1e-12)
    want = np.full(x.shape, np.nan)
    want[N:] = x[:-N]
    np.testing.assert_allclose(matrix(out, x.shape, "ts_delay"), want)
    np.testing.assert_allclose(matrix(out, x.shape, "ts_delta"), x - want)


def test_pairs(spark, xy):
    x, y = xy
    out = run(panel(spark, x, y), {op: f"{op}(close, open, {N})" for op in ("ts_cov", "ts_corr", "ts_beta", "ts_orth")})
    cov = lambda a, b: ((a - a.mean()) * (b - b.mean())).mean()
    f = {
        "ts_cov": cov,
        "ts_corr": lambda a, b: cov(a, b) / (a.std() * b.std()) if a.std() > 1e-12 and b.std() > 1e-12 else np.nan,
        "ts_beta": lambda a, b: cov(a, b) / b.var() if b.var() > 1e-12 else np.nan,
        "ts_orth": lambda a, b: a[-1] - a.mean() - cov(a, b) / b.var() * (b[-1] - b.mean()) if b.var() > 1e-12 else np.nan,
    }
    for op in f:
        want = np.full(x.shape, np.nan)
        for t in range(N - 1, len(x)):
            for s in range(x.shape[1]):
                a, b = x[t - N + 1 : t + 1, s], y[t - N + 1 : t + 1, s]
                if not np.isnan(a + b).any():
                    want[t, s] = f[op](a, b)
        np.testing.assert_allclose(matrix(out, x.shape, op), want, atol=1e-10, err_msg=op)


def test_the_future_does_not_change_the_past(spark, xy):
    x = xy[0].copy()
    formulas = {f"e{k}": f for k, f in enumerate(["ts_rank(close, 5)", "ts_ema(close, 5)", "cs_rank(ts_mean(close, 5))", "ts_wma(close, 10)"])}
    a = run(panel(spark, x), formulas)
    x[20:] = 99.0
    b = run(panel(spark, x), formulas)
    for k in formulas:
        np.testing.assert_allclose(matrix(a, x.shape, k)[:20], matrix(b, x.shape, k)[:20], atol=1e-12)


def test_elementwise_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (float("inf"), 1.0), (1e200, 1e200), (-2.0, 3.0)], "x double, y double")
    df = df.select(elementwise.finite(F.col("x")).alias("x"), elementwise.finite(F.col("y")).alias("y"))
    out = df.select(*[f(F.col("x")).alias(k) for k, f in elementwise.UNARY.items()], *[f(F.col("x"), F.col("y")).alias(k) for k, f in elementwise.BINARY.items()]).collect()
    assert all(v is None for r in out[1:3] for v in r)
    assert out[0]["div"] is None and out[0]["max2"] == 1.0 and out[0]["greater"] == 1.0
    assert out[3]["mul"] is None and out[3]["signed_power3"] is None and out[3]["add"] == 2e200
    assert out[4]["relu"] == 0.0 and out[4]["signed_power2"] == -4.0 and out[4]["log_ratio"] is None
    assert all(v is None or math.isfinite(v) for r in out for v in r)


def test_expressions():
    assert len(ex.actions()) == 142 and len(ex.actions(ex.DERIVED)) == 152
    e = ex.parse("ts_corr(add(open, close), cs_rank(volume), 20)")
    assert ex.from_prefix(e.prefix()) == ex.from_postfix(e.postfix()) == ex.parse(e.formula()) == e
    assert e.stats() == {"nodes": 6, "operators": 3, "leaves": 3, "depth": 2, "operator_ratio": 0.5}
    assert ex.parse("add(open, close)").hash() == ex.parse("add(close, open)").hash() != ex.parse("sub(close, open)").hash()
    assert ex.parse("ts_mean(ts_delta(close, 5), 10)").lookback() == 14
    for bad in ("add(open)", "ts_mean(close, 7)", "foo(close)", "open close", "add(open, close"):
        with pytest.raises(ex.ExpressionError):
            ex.parse(bad)
    with pytest.raises(ex.ExpressionError):
        ex.from_prefix(["open", "close"])


def test_grammar():
    g = Grammar()
    two = list(g.enumerate(2))
    assert len({n.hash() for n in two}) == len(two) == g.count(2) == 636 and g.count(1) == 6
    small = Grammar(leaves=("open", "close"))
    three = [n for n in small.enumerate(3) if n.action.arity == 2]
    assert len({n.hash() for n in three}) == len(three) == 4 * 3 + 26 * 4
    for k in range(1, 9):
        e = g.sample(k, k)
        assert e.stats()["nodes"] == k and ex.parse(e.formula()) == e
    assert not Grammar(max_depth=0).reachable((0,), 2) and g.reachable((1, 1), 2)


def test_spearman_and_portfolio_ties(spark):
    rows = [(0, f"s{k:02d}", float(k // 3), float(k)) for k in range(23)]
    df = spark.createDataFrame(rows, "t int, stock string, x double, r double")
    a, b = ranks(np.array([r[2] for r in rows])), ranks(np.array([r[3] for r in rows]))
    assert evaluate.rank_correlation(df, "x", "r").head()["ic"] == pytest.approx(np.corrcoef(a, b)[0, 1])
    legs = evaluate.portfolios(df, "x", "r").head()
    assert legs["long"] == pytest.approx((22 + 21 + 20) / 3) and legs["long_short"] == pytest.approx(21 - 1)
    sizes = backtest.deciles(df, "x").groupBy("g").count().orderBy("g").collect()
    assert [r["count"] for r in sizes] == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]


def test_turnover_by_hand(spark):
    rows = [(0, "A", 0.1), (0, "B", -0.1), (1, "A", 0.0), (1, "B", 0.0), (2, "C", 0.0), (2, "D", None), (3, "C", 0.0), (3, "A", 0.0)]
    periods = spark.createDataFrame([(k, True) for k in range(4)], "p int, valid boolean")
    out = {r["p"]: (r["turnover"], r["replaced"]) for r in backtest.turnover(spark.createDataFrame(rows, "p int, stock string, ret double"), periods).collect()}
    assert out[0] == (None, None) and out[3] == (None, None)
    assert out[1] == (pytest.approx(0.05), 0.0) and out[2] == (pytest.approx(1.0), 1.0)


def test_greedy_and_redistribution(spark):
    ranks_ = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "rank int")
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.1), (2, 3, 0.99), (1, 4, None), (3, 4, 0.2)], "a int, b int, c double")
    assert select.greedy_decorrelate(ranks_, pairs) == [(1, "retained", None), (2, "rejected", 1), (3, "retained", None), (4, "invalid", 1)]
    w = backtest.redistribute([0.7, 0.1, 0.1, 0.1], 0.4)
    assert sum(w) == pytest.approx(1) and max(w) == pytest.approx(0.4) and w[1] == pytest.approx(0.2)
    gate = backtest.LabelGate(ranks_)
    with pytest.raises(PermissionError):
        gate.labels()
    gate.freeze(pairs)
    assert gate.labels() is ranks_


def test_names_and_validity(spark):
    names = ["ST x", "*ST x", "S*ST y", "SST z", "STAR co", "plain", "st-a"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(etl.is_special_name(F.col("n"))).collect()]
    assert got == [True, True, True, True, False, False, True]
    rows = [(10.0, 11.0, 9.0, 10.5, 10.2, 5.0), (10.0, 11.0, 9.0, 10.5, 10.2, 0.0), (10.0, 10.0, 9.0, 10.5, 10.2, 5.0), (10.0, 11.0, 9.0, 10.5, 12.0, 5.0), (10.0, float("inf"), 9.0, 10.5, 10.2, 5.0), (None, 11.0, 9.0, 10.5, 10.2, 5.0)]
    out = etl.validity(spark.createDataFrame(rows, "open double, high double, low double, close double, vwap double, volume double")).collect()
    assert [r["valid"] for r in out] == [True, False, False, False, False, False] and out[1]["close"] is None


def test_masks_and_cardinality(spark):
    a = spark.createDataFrame([(1, "x", True), (1, "y", False)], "date int, stock string, valid boolean")
    b = spark.createDataFrame([(1, "x", True)], "date int, stock string, eligible boolean")
    with pytest.raises(etl.IntegrityError):
        etl.combine_masks(a, b)
    with pytest.raises(etl.IntegrityError):
        etl.left_checked(a, a.unionAll(a), ["date", "stock"])


def test_stream_monitor(spark, tmp_path):
    from strandline.streaming import monitor

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"step":1,"at":"2024-01-01T00:00:00Z","condition":1,"loss":0.5,"seconds":2,"valid":true}\n{"step":2,"at":"2024-01-01T00:01:00Z","condition":1,"loss":0.4,"seconds":90,"valid":true}\n')
    q = monitor.status(monitor.watch(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("monitor").start()
    try:
        q.processAllAvailable()
        r = spark.table("monitor").head()
        assert (r["step"], r["loss"], r["n"], r["alert"]) == (2, 0.4, 2, "slow")
    finally:
        q.stop()


def test_files(spark, tmp_path):
    from strandline.sources import files

    df = spark.createDataFrame([(1, "a", None), (2, "b", 2.0)], "k int, s string, x double")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "j"), "k int, s string, x double").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert files.append_new(df, str(tmp_path / "t"), ["k"], spark) == 2
    assert files.append_new(df, str(tmp_path / "t"), ["k"], spark) == 0
    (tmp_path / "swind_20200203.csv").write_text("﻿" + ",".join(files.INDUSTRY_COLUMNS) + "\n2020-02-03,000001.SZ,name,801780.SI,a,801781.SI,b,801782.SI,c\n", encoding="utf-8")
    row = etl.parse_industry(files.read_industry_csv(spark, str(tmp_path / "swind_*.csv"))).head()
    assert row["stock_code"] == "000001" and row["sw_code_1"] == "801780" and row["ok"]


def test_parents_are_the_trees_one_step_before():
    """Every tree that transitions reach, and from where, against parents()."""
    g = Grammar(max_nodes=4, max_depth=2, leaves=("open", "close"))
    g.actions = [a for a in g.actions if a.token in ("open", "close", "abs", "add", "sub")]
    from strandline.plans.grammar import _key, _sorted, _tree

    before, todo, seen = {}, [None], {"_"}
    while todo:
        tree = todo.pop()
        if tree is not None and "_" not in _key(tree):
            assert not g.transitions(tree)
            continue
        steps = g.transitions(tree)
        after = [_key(g.step(tree, path, a)) for path, a in steps]
        assert len(set(after)) == len(after)
        for (path, a), k in zip(steps, after, strict=True):
            before.setdefault(k, set()).add(_key(tree))
            if k not in seen:
                seen.add(k)
                todo.append(g.step(tree, path, a))
    for k in seen - {"_"}:
        assert before[k]
    trees = [ex.parse(f) for f in ("abs(open)", "add(abs(open), close)", "add(open, open)", "sub(open, open)", "add(close, open)", "sub(abs(close), abs(close))")]
    assert [g.parents(t) for t in trees] == [1, 2, 1, 2, 2, 2]
    small = Grammar(max_nodes=4, max_depth=2, leaves=("open", "close"))
    for t in trees[:5]:
        assert {_key(x) for x in small.parent_trees(t)} == before[_key(_sorted(_tree(t)))]
    assert g.open_slots((ex.by_token()["add"], (None, None))) == [(0,)] and g.open_slots((ex.by_token()["sub"], (None, None))) == [(0,), (1,)]


def test_enumeration_against_products():
    leaves = list(ex.RAW)
    ones = [f"{n}({x})" for n in (*elementwise.UNARY, *cross_section.NAMES) for x in leaves] + [f"{n}({x}, {w})" for n in time_series.UNARY for w in time_series.WINDOWS for x in leaves]
    assert sorted(n.formula() for n in Grammar().enumerate(1)) == sorted(leaves)
    assert sorted(n.formula() for n in Grammar().enumerate(2)) == sorted(ones)
    two = [n.formula() for n in Grammar(leaves=("open", "close")).enumerate(3) if n.action.arity == 2 and n.action.kind == "binary"]
    want = [f"{n}({a}, {b})" for n in elementwise.BINARY for a in ("open", "close") for b in ("open", "close") if n not in elementwise.COMMUTATIVE or a <= b]
    assert sorted(two) == sorted(want)


def test_samples_are_legal_and_repeat():
    g = Grammar()
    for n in range(1, 12):
        a, b = g.sample(n, 5), g.sample(n, 5)
        assert a == b and a.stats()["nodes"] == n and a.depth() <= g.max_depth
        tokens, known = a.prefix(), ex.by_token()
        for k in range(n):
            assert known[tokens[k]] in g.legal(tuple(known[t] for t in tokens[:k]), n)


def test_rolling_weights_against_a_loop(spark):
    """A short factor, a capped one, updates whose weights are kept, and development periods that seed."""
    rng = np.random.default_rng(6)
    names, history, least, cap = ["a", "b", "c", "d"], 20, 10, 0.4
    ic = {(f, p): float(rng.normal(m, 0.1)) for f, m in zip(names, (0.1, 0.03, 0.02, 0.01), strict=True) for p in range(-25, 60)}
    for p in range(-25, 60):
        if p < 30 or p % 3:
            ic[("d", p)] = None if p < 48 else ic[("d", p)]
        if 8 <= p < 34:
            ic.update({(f, p): -abs(ic[(f, p)] or 0.1) for f in names})
    df = spark.createDataFrame([(f, p, v) for (f, p), v in ic.items()], "factor string, p int, ic double")
    out = {(r["u"], r["factor"]): r["weight"] for r in backtest.icir_weights(df, names, spark.createDataFrame([(p,) for p in range(60)], "p int"), history, least, cap).collect()}
    held, kept, short = None, 0, 0
    for u in range(0, 60, 4):
        end = max(u - 2, -1)
        ratio = []
        for f in names:
            v = [ic[f, p] for p in range(end - history + 1, end + 1) if (f, p) in ic and ic[f, p] is not None]
            ratio.append(max(0.0, statistics.fmean(v) / statistics.stdev(v)) if len(v) >= least and statistics.stdev(v) > 1e-12 else 0.0)
            short += len(v) < least
        if not any(ratio):
            kept += held is not None
            held = held or [0.25] * 4
        else:
            top = float(np.quantile([r for r in ratio if r > 0], 0.95))
            clipped = [min(r, top) for r in ratio]
            w = [0.125 + 0.5 * r / sum(clipped) for r in clipped]
            over = sum(max(x - cap, 0) for x in w)
            room = [max(cap - x, 0) for x in w]
            held = [min(x, cap) + over * r / sum(room) for x, r in zip(w, room, strict=True)]
        assert [out[u, f] for f in names] == pytest.approx(held), u
        assert sum(held) == pytest.approx(1) and max(held) <= cap + 1e-9
    assert kept and short and len(out) == 15 * 4
    assert backtest.redistribute([0.5, 0.3, 0.15, 0.05], 0.4) == pytest.approx([0.4, 0.3 + 0.1 / 7, 0.15 + 0.025 / 0.7, 0.05 + 0.035 / 0.7])


def test_greedy_in_batches(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(4, 80))
    series = [base[k % 4] + rng.normal(size=80) * (0.2 + 0.15 * k) for k in range(11)]
    rows = [(f"h{k}", t, float(v)) for k, x in enumerate(series) for t, v in enumerate(x) if not (k == 5 and t > 30)]
    df, ranks_ = spark.createDataFrame(rows, "hash string, t int, x double"), spark.createDataFrame([(f"h{k}", k + 1) for k in range(11)], "hash string, rank int")
    kept, want = [], []
    for k in range(11):
        verdict = (k + 1, "retained", None)
        for j in kept:
            n = 31 if 5 in (j, k) else 80
            c = np.corrcoef(series[j][:n], series[k][:n])[0, 1]
            if n < 60 or abs(c) >= 0.7:
                verdict = (k + 1, "invalid" if n < 60 else "rejected", j + 1)
                break
        want.append(verdict)
        kept += [k] * (verdict[1] == "retained")
    assert {v[1] for v in want} == {"retained", "rejected", "invalid"}
    for batch in (1, 3, 100):
        assert select.greedy_select(df, ranks_, batch=batch) == want
    assert select.greedy_decorrelate(ranks_, select.pair_correlations(df, ranks_)) == want


def test_raw_and_cleaned_samples(spark):
    """The sample of a date counts names that cleaning leaves out."""
    rows = [(t, f"s{k:02d}", float(k * 7 % 23 + t), float(k), k % 3 if k < 18 else None, k != 22) for t in range(2) for k in range(23)]
    df = spark.createDataFrame(rows, "t int, stock string, x double, label double, industry int, universe boolean")
    z = evaluate.clean_candidate(df, "x", F.col("universe"), out="z")
    a, b = evaluate.rank_ic(z, "x", "z", "label", F.col("universe")).orderBy("t").collect()
    assert a["n"] == b["n"] == 22 and a["ic"] is None
    assert evaluate.rank_ic(z, "x", "z", "label", F.col("universe"), least=18).head()["ic"] is not None
    assert evaluate.rank_correlation(z, "z", "label").head()["n"] == 18


def test_boosting_learns_and_is_refitted(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 2))
    rows = [(int(k // 30), f"s{k % 30}", float(a), float(b), float(a if b > 0 else -a)) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "t int, stock string, a double, b double, label double")
    train, test = df.filter("t < 30"), df.filter("t >= 30")
    one, two = (backtest.boosted_scores(train, test, ["a", "b"], "label", trees=12).orderBy("t", "stock").collect() for _ in range(2))
    assert [r["score"] for r in one] == pytest.approx([r["score"] for r in two]) and len(one) == 300
    want = {(r["t"], r["stock"]): r["label"] for r in test.collect()}
    assert np.corrcoef([r["score"] for r in one], [want[r["t"], r["stock"]] for r in one])[0, 1] > 0.7
    _, model = backtest.boosted_model(train.filter("t <= 24"), train.filter("t > 24"), ["a", "b"], "label", trees=12)
    assert 1 <= model.getNumTrees <= 12


def test_store_and_pool(spark, tmp_path):
    from strandline.operators import store

    s = store.ResultStore(spark, str(tmp_path / "store"), "score double")
    names = spark.createDataFrame([(f"h{k}",) for k in range(7)], "hash string")
    calls = []

    def evaluate_(some):
        calls.append(some.count())
        return some.filter("hash <> 'h3'").select("hash", (F.length("hash") + F.substring("hash", 2, 1).cast("double")).alias("score"))

    out = {r["hash"]: r["state"] for r in s.run(names, "c1", evaluate_, batch=3).collect()}
    assert out == {f"h{k}": "failed" if k == 3 else "completed" for k in range(7)} and calls == [3, 3, 1]
    s.run(names, "c1", evaluate_, batch=3)
    assert calls == [3, 3, 1, 1] and s.results().count() == 6 and s.pending(names, "c2").count() == 7
    s.insert(spark.createDataFrame([("h1", "c1", 9.5), ("h2", "c1", 4.0), ("new", "c1", 1.0)], "hash string, context string, score double"))
    assert [(r["hash"], r["score"]) for r in s.conflicts().collect()] == [("h1", 9.5)]
    assert {r["hash"]: r["score"] for r in s.lookup(names, "c1").collect()}["h1"] == 3.0 and s.results().count() == 7
    ranked = names.withColumn("rank", F.substring("hash", 2, 1).cast("int"))
    store.freeze_pool(ranked, str(tmp_path / "pool"), 3)
    assert [r["hash"] for r in store.verify_pool(spark, str(tmp_path / "pool")).orderBy("rank").collect()] == ["h0", "h1", "h2"]
    spark.createDataFrame([("x", 9)], "hash string, rank int").write.mode("append").parquet(str(tmp_path / "pool" / "pool"))
    with pytest.raises(ValueError):
        store.verify_pool(spark, str(tmp_path / "pool"))


def test_sinks_and_prefixes(spark, tmp_path):
    from strandline.sources import files

    (tmp_path / "log.jsonl").write_text("".join(f'{{"k": {k}}}\n' for k in range(20)) + '{"k": broken')
    assert [r["k"] for r in files.read_jsonl_prefix(spark, str(tmp_path / "log.jsonl"), "k int", 6).collect()] == list(range(6))
    parts = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (1, "a")], "k int, v string")
    for _ in range(2):
        files.consolidate(parts, str(tmp_path / "one"), ["k"], ["v"])
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "one")).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(ValueError):
        files.consolidate(parts.unionAll(spark.createDataFrame([(2, "x")], "k int, v string")), str(tmp_path / "one"), ["k"], ["v"])
    assert files.read_until(spark, str(tmp_path / "one"), "k", 2).count() == 2
    assert files.read_parquet(spark, str(tmp_path / "one"), str(tmp_path / "one")).count() == 6
    files.write_csv(parts, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    (tmp_path / "ind").mkdir()
    (tmp_path / "ind" / "swind_20200203.csv").write_text("x")
    assert files.industry_files(spark, str(tmp_path / "ind")).count() == 1
    (tmp_path / "ind" / "other_20200203.csv").write_text("x")
    with pytest.raises(ValueError):
        files.industry_files(spark, str(tmp_path / "ind"))


def test_samplers():
    rows = [("a", frozenset({"op:x", "f:1"})), ("b", frozenset({"op:x", "op:y"})), ("c", frozenset({"f:1", "f:2", "f:3"}))]
    assert select.greedy_coverage(rows, 3) == ["b", "c", "a"]
    from strandline.plans.grammar import schedule

    out = schedule([1, 2, 3], 4, 5)
    assert all(sorted(out[k : k + 3]) == [1, 2, 3] for k in range(0, 12, 3)) and out == schedule([1, 2, 3], 4, 5)


def test_spread_sample_beyond_one_task(spark, monkeypatch):
    df = spark.createDataFrame([(f"{k * 37 % 1009:04d}",) for k in range(1009)], "hash string")
    want = select.spread_sample(df, 12, ["hash"]).orderBy("place").collect()
    monkeypatch.setattr(select, "SORTED_ROWS", 10)
    assert select.spread_sample(df, 12, ["hash"]).orderBy("place").collect() == want and [r["place"] for r in want] == list(range(12))
    few = spark.createDataFrame([("a",), ("b",)], "hash string")
    assert [(r["hash"], r["place"]) for r in select.spread_sample(few, 4, ["hash"]).orderBy("place").collect()] == [("a", 0), ("a", 1), ("a", 2), ("b", 3)]


def test_records_of_a_key_must_agree(spark):
    schema = "hash string, source string, nodes int, reward double, cached boolean"
    rows = [("a", "found", 3, None, True), ("a", "found", 3, None, False), ("b", "found", 2, 0.5, True), (None, "found", 9, 9.0, True), ("b", "other", 7, 0.1, False)]
    got = report.unique_records(spark.createDataFrame(rows, schema), "source", "found", ["nodes", "reward"], ["cached"])
    assert {tuple(r) for r in got.select("hash", "nodes", "reward", "cached", "visits").collect()} == {("a", 3, None, False, 2), ("b", 2, 0.5, True, 1)}
    with pytest.raises(Exception, match="disagree"):
        report.unique_records(spark.createDataFrame([*rows, ("a", "found", 3, 0.0, True)], schema), "source", "found", ["nodes", "reward"], ["cached"]).collect()
    assert not report.unique_records(spark.createDataFrame([], schema), "source", "found", ["nodes"], ["cached"]).head(1)


def test_fingerprints_ignore_order(spark):
    df = spark.createDataFrame([("x", 1, None), ("x", 2, "b"), ("y", 1, "c"), ("z", 1, "d")], "branch string, hash int, note string")
    of = lambda d: {tuple(r) for r in report.set_fingerprints(report.source_snapshot(d, "branch", ["x", "y"]), "branch").collect()}
    one = of(df)
    assert {r[0] for r in one} == {"x", "y"} and of(df.orderBy(F.desc("hash")).select("note", "hash", "branch").repartition(3)) == one
    assert of(df.fillna("", ["note"])) != one and of(df.unionAll(df.limit(1))) != one
