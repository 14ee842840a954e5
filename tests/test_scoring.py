import datetime as dt
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics
from barloom.operators.panel import forward_mfe
from barloom.plans import regression, scoring
from barloom.plans.features import label_gains, label_rank
from barloom.session import cut_lineage

EPOCH = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def std(spark):
    draw = np.random.default_rng(5)
    rows = [
        (f"t{t}", EPOCH + dt.timedelta(days=i), [float(x) for x in draw.normal(size=12)],
         1.0, 2.0, 0.5, 1.0 + i)
        for t, n in enumerate((3, 25, 70))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "ticker string, date date, feature array<float>, open float, high float, low float, close float",
    ).repartition(3)


def by_key(df):
    return {(r.ticker, r.date): r.score for r in df.collect()}


def slow_gru(window, w):
    """One window, one gate at a time."""

    def sigmoid(x):
        return 1.0 / (1.0 + np.exp(-x))

    def layer(sequence, name):
        hidden = w[f"{name}.w_state"].shape[0]
        state, out = np.zeros(hidden), []
        for x in sequence:
            gates_x = x @ w[f"{name}.w_in"].astype(float) + w[f"{name}.b_in"]
            gates_h = state @ w[f"{name}.w_state"].astype(float) + w[f"{name}.b_state"]
            part = [slice(i * hidden, (i + 1) * hidden) for i in range(3)]
            reset = sigmoid(gates_x[part[0]] + gates_h[part[0]])
            update = sigmoid(gates_x[part[1]] + gates_h[part[1]])
            new = np.tanh(gates_x[part[2]] + reset * gates_h[part[2]])
            state = (1 - update) * new + update * state
            out.append(state)
        return out

    def norm(x, gain):
        return x / math.sqrt(np.mean(x * x) + 1e-5) * gain

    first = [norm(h, w["gru_1.norm"]) for h in layer(window, "gru_1")]
    summary = norm(layer(first, "gru_2")[-1], w["gru_2.norm"])
    inner = summary @ w["hidden.w"] + w["hidden.b"]
    inner = np.array([0.5 * x * (1 + math.erf(x / math.sqrt(2))) for x in inner])
    return float((inner @ w["head.w"] + w["head.b"])[0])


def test_gru_parameter_count():
    weights = scoring.gru_weights()
    sizes = {}
    for name, value in weights.items():
        part = name.rsplit(".", 1)[0] + (".norm" if name.endswith("norm") else "")
        sizes[part] = sizes.get(part, 0) + value.size
    assert list(sizes.values()) == [4416, 32, 6336, 32, 1056, 33]
    assert sum(sizes.values()) == 11_905


def test_gru_matches_slow_loop(spark, std):
    weights = scoring.gru_weights(seed=2)
    got = by_key(scoring.score(std, scoring.GruScorer(weights), 20))
    assert len(got) == 6 + 51
    rows = std.filter("ticker = 't1'").orderBy("date").collect()
    features = np.array([r.feature for r in rows])
    for end in (19, 22, 24):
        expected = slow_gru(features[end - 19 : end + 1], weights)
        assert got[("t1", rows[end].date)] == pytest.approx(expected, abs=1e-5)


def test_gru_chunks_do_not_change_scores(spark, std):
    weights = scoring.gru_weights(seed=2)
    whole = by_key(scoring.score(std, scoring.GruScorer(weights), 20))
    for spread in (False, True):
        scorer = scoring.GruScorer(weights, chunk_rows=23, spread=spread)
        cut = by_key(scoring.score(std, scorer, 20))
        assert cut.keys() == whole.keys()
        assert all(cut[k] == pytest.approx(whole[k], abs=1e-6) for k in whole)
    with pytest.raises(ValueError):
        scoring.GruScorer(weights, chunk_rows=5).score(std, 20)


def test_gru_works_in_blocks_of_windows(spark, std):
    weights = scoring.gru_weights(seed=2)
    rows = np.random.default_rng(7).normal(size=(scoring.GRU_WINDOWS * 16 + 30, 12)).astype(np.float32)
    rows[5] *= 1000  # gates far beyond the range of exp
    tracemalloc.start()
    got = scoring.gru_forward(rows, 20, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The rows' products and the buffers of a block, not of all windows.
    assert peak < 2 * 4 * 96 * len(rows)
    for at in (0, 5, scoring.GRU_WINDOWS - 1, scoring.GRU_WINDOWS, len(got) - 1):
        assert got[at] == pytest.approx(slow_gru(rows[at : at + 20].astype(float), weights), abs=1e-6)
    assert len(scoring.gru_forward(rows[:19], 20, weights)) == 0
    # Rows reach the worker as Arrow columns; no date becomes an object of its own.
    plan = scoring.GruScorer(weights).score(std, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Pandas" not in plan


def test_gru_streams_rows_as_they_lie(spark, std):
    weights = scoring.gru_weights(seed=2)
    scored = scoring.score(std, scoring.GruScorer(weights), 20)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    # One sort along the ticker serves the numbers and the groups, and no row is copied.
    assert plan.count("Sort [") == 1 and "Generate" not in plan
    whole = by_key(scored)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        streamed = by_key(scored)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert streamed.keys() == whole.keys()
    assert all(streamed[k] == pytest.approx(whole[k], abs=1e-6) for k in whole)


def test_linear_is_a_dot_product(spark, std):
    draw = np.random.default_rng(1)
    weights = draw.normal(size=(4, 12))
    got = by_key(scoring.score(std, scoring.LinearScorer(weights.tolist()), 4))
    rows = std.filter("ticker = 't1'").orderBy("date").collect()
    assert sum(k[0] == "t1" for k in got) == 22 and not any(k[0] == "t0" for k in got)
    for end in (3, 10, 24):
        window = np.array([rows[i].feature for i in range(end - 3, end + 1)])
        assert got[("t1", rows[end].date)] == pytest.approx(float((window * weights).sum()), abs=1e-6)


def test_windows_of_one_row_are_scored_where_they_lie(spark, std):
    weights = np.random.default_rng(4).normal(size=(1, 12))
    scored = scoring.score(std, scoring.LinearScorer(weights.tolist(), 0.5), 1)
    assert "Window" not in scored._jdf.queryExecution().optimizedPlan().toString()
    got = by_key(scored)
    assert len(got) == 3 + 25 + 70
    for row in std.collect():
        assert got[row.ticker, row.date] == pytest.approx(0.5 + float(np.dot(weights[0], row.feature)), abs=1e-6)


def test_windows_of_one_row_are_packed_across_tickers(spark, std):
    labelled = std.withColumn("label", F.get("feature", F.lit(3)).cast("double"))
    panel = regression.pack(labelled.coalesce(1), 1, [0, 3])
    # 98 rows of three tickers fit one stored row.
    stored = panel.rows.collect()
    assert len(stored) == 1 and len(stored[0].y) == 98 and len(stored[0].x) == 2 * 98 and panel.width == 2
    model = regression.fit_packed(panel)
    assert model.n == 98 and model.coefficients == pytest.approx([0, 1], abs=1e-9)


def test_stored_gains_are_labelled_without_a_frame(spark, std):
    stored = cut_lineage(forward_mfe(std, 3).drop("high", "low"))
    labelled = label_gains(stored)
    assert "Window" not in labelled._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.ticker, r.date): r.label for r in labelled.collect()}
    expected = {(r.ticker, r.date): r.label for r in label_rank(std, 3).collect()}
    assert got.keys() == expected.keys() and got
    assert all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)


def test_since_keeps_lookback(spark, std):
    cutoff = EPOCH + dt.timedelta(days=22)
    scorer = scoring.momentum_scorer(20)
    late = by_key(scoring.score(std, scorer, 20, since=cutoff))
    full = by_key(scoring.score(std, scorer, 20))
    assert late == {k: v for k, v in full.items() if k[1] >= cutoff} and late


def test_day_bars_lag_the_score(spark, std):
    scorer = scoring.momentum_scorer(20)
    scores = by_key(scoring.score(std, scorer, 20))
    day = scoring.day_bars(std, scorer, 20)
    one = dt.timedelta(days=1)
    got = by_key(day)
    assert got == {(t, d + one): s for (t, d), s in scores.items() if (t, d + one) in scores}
    cutoff = EPOCH + dt.timedelta(days=22)
    assert by_key(scoring.day_bars(std, scorer, 20, since=cutoff)) == {
        k: v for k, v in got.items() if k[1] > cutoff
    }


def test_huber_fit_scores_with_ml(spark, std):
    labelled = std.withColumn("label", F.get("feature", F.lit(0)).cast("double") * 2 + 1)
    model = scoring.fit_huber(labelled, steps=3, max_iter=60)
    scored = scoring.score(labelled, scoring.MLScorer(model), 3)
    row = metrics.ic(scored.withColumnRenamed("label", "target")).first()
    assert row.ic > 0.99
    loss = metrics.huber_loss(scored.withColumnRenamed("label", "target")).first().huber
    assert loss < 0.05


def test_a_short_tail_gives_no_rank(spark):
    rows = [(code, dt.date(2026, 1, 1) + dt.timedelta(days=7 * i), *[10.0 + i + n] * 4, 100.0)
            for n, code in enumerate("AB") for i in range(30)]
    sparse = spark.createDataFrame(rows, "code string, date date, open float, high float, low float, close float, volume float")
    scorer = scoring.momentum_scorer(20)
    assert scoring.rank(sparse, scorer, 20).count() == 0
    found = scoring.rank(sparse, scorer, 20, lookback_days=7 * 25)
    whole = scoring.rank(sparse, scorer, 20, lookback_days=7 * 40)
    assert [r.ticker for r in found.collect()] == [r.ticker for r in whole.collect()] and found.count() == 2


def test_weights_come_from_a_table(spark):
    weights = scoring.gru_weights(seed=3)
    rows = [(name, list(a.shape), [float(x) for x in a.reshape(-1)]) for name, a in weights.items()]
    schema = "name string, shape array<int>, values array<float>"
    read = scoring.read_gru_weights(spark.createDataFrame(rows, schema))
    assert read.keys() == weights.keys() and all(np.array_equal(read[n], weights[n]) for n in weights)
    for wrong in (rows[1:], rows + rows[:1], [(rows[0][0], [1], [0.0]), *rows[1:]], [("other", [1], [0.0]), *rows[1:]]):
        with pytest.raises(ValueError):
            scoring.read_gru_weights(spark.createDataFrame(wrong, schema))


def huber_rows(spark, n, noise, outliers):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(n, 3))
    y = 0.7 + x @ np.array([2.0, -1.5, 0.0]) + noise * draw.normal(size=n)
    y[:outliers] += 40.0
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)] + [(None, 1.0), ([1.0, 2.0, 3.0], None)],
                               "x array<double>, y double")
    return df, x, y


def test_huber_finds_a_linear_function(spark):
    df, _, _ = huber_rows(spark, 200, 0.0, 0)
    model = regression.huber(df, 3)
    assert model.converged and model.n == 200
    assert [model.intercept, *model.coefficients] == pytest.approx([0.7, 2.0, -1.5, 0.0], abs=1e-9)


@pytest.mark.parametrize("delta", [0.5, 1.0, 3.0])
def test_huber_is_at_the_least_loss(spark, delta):
    df, x, y = huber_rows(spark, 300, 0.8, 12)
    model = regression.huber(df, 3, delta)

    def loss(beta):
        off = np.abs(y - beta[0] - x @ beta[1:])
        return float(np.where(off <= delta, off * off / 2, delta * (off - delta / 2)).mean())

    best = np.array([model.intercept, *model.coefficients])
    assert model.converged
    for i in range(4):
        for step in (-1e-3, 1e-3):
            moved = best.copy()
            moved[i] += step
            assert loss(moved) > loss(best)
    slopes = {r.position: (r.n, r.slope) for r in regression.stationarity(df, model).collect()}
    assert sorted(slopes) == [-1, 0, 1, 2]
    assert all(n == 300 and abs(slope) < 1e-8 for n, slope in slopes.values())
    assert abs(best[1] - 2.0) < 0.3  # a squared loss is moved by the outliers
    with pytest.raises(ValueError):
        regression.huber(df.limit(0), 3)
    with pytest.raises(ValueError):
        regression.huber(df, 3, delta=0.0)


def test_huber_of_windows_scores_like_its_function(spark, std):
    labelled = std.withColumn("label", F.get("feature", F.lit(2)).cast("double") * 2 + 1)
    model = regression.fit_windows(labelled, steps=3)
    wanted = np.zeros((3, 12))
    wanted[2, 2] = 2.0
    assert np.allclose(model.step_weights(3), wanted, atol=1e-7) and model.intercept == pytest.approx(1.0)
    scores = by_key(scoring.score(std, scoring.LinearScorer(model.step_weights(3), model.intercept), 3))
    labels = {(r.ticker, r.date): r.label for r in labelled.collect()}
    assert scores and all(s == pytest.approx(labels[k], abs=1e-6) for k, s in scores.items())


def test_packed_windows_are_all_windows(spark, std, monkeypatch):
    monkeypatch.setattr(regression, "CHUNK_WINDOWS", 7)
    monkeypatch.setattr(regression, "BLOCK_WINDOWS", 5)
    labelled = std.withColumn("label", F.when(F.dayofmonth("date") % 9 != 0, F.hash("ticker", "date") / 2**30))
    panel = regression.pack(labelled, 4, [0, 3])
    assert panel.width == 2 and max(len(r.y) for r in panel.rows.collect()) == 10
    model = regression.fit_packed(panel)
    rows = regression.window_rows(labelled, 4, [0, 3])
    other = regression.huber(rows, 8)
    assert model.converged and model.n == other.n == rows.filter("y is not null").count()
    assert [model.intercept, *model.coefficients] == pytest.approx([other.intercept, *other.coefficients], abs=1e-8)
    # The slopes, added up in SQL over windows that Spark makes.
    beta = F.array(*[F.lit(float(b)) for b in model.coefficients])
    fitted = F.aggregate(F.zip_with("x", beta, lambda a, b: a * b), F.lit(model.intercept), lambda s, v: s + v)
    error = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), fitted - F.col("y")))
    assert rows.filter("y is not null").agg(F.avg(error * F.col("x")[5])).first()[0] == pytest.approx(0.0, abs=1e-9)


def test_few_passes_and_no_row_moved(spark, std):
    labelled = std.withColumn("label", F.hash("ticker", "date") / 2**30)
    panel = regression.pack(labelled, 2)
    model = regression.fit_packed(panel)
    assert model.converged and model.iterations <= 15
    plan = regression.packed_stationarity(panel, model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "collect_list" not in plan and "Window" not in plan


def test_scaled_huber_is_the_loss_of_spark(spark, std):
    noise = F.hash("ticker", "date") / 2**31
    labelled = std.withColumn("label", F.get("feature", F.lit(0)) * 2 + 1 + noise * noise * noise * 3)
    ours = scoring.fit_huber(labelled, steps=1)
    rows = scoring.window_vectors(regression.windows(labelled, 1))
    theirs = scoring.LinearRegression(loss="huber", epsilon=1.35, maxIter=500, tol=1e-12).fit(rows)
    assert ours.coefficients.toArray() == pytest.approx(theirs.coefficients.toArray(), abs=2e-4)
    assert ours.intercept == pytest.approx(theirs.intercept, abs=2e-4)
    found = regression.scaled_windows(labelled, 1)
    assert found.converged and found.delta / 1.35 == pytest.approx(theirs.scale, abs=2e-4)
    assert ours.coefficients.toArray() == pytest.approx(found.coefficients, abs=1e-7)


def test_gru_gates_far_out_are_shut_or_open_without_a_warning():
    import warnings

    weights = scoring.gru_weights(seed=3)
    rows = np.linspace(-3e3, 3e3, 40 * scoring.N_FEATURES, dtype=np.float32).reshape(40, -1)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        scores = scoring.gru_forward(rows, 5, weights)
    assert scores.shape == (36,) and np.isfinite(scores).all()


def test_gru_takes_no_tanh(monkeypatch):
    # A tanh takes numpy twice as long as an exp.
    monkeypatch.setattr(np, "tanh", None)
    rows = np.zeros((6, scoring.N_FEATURES), np.float32)
    assert len(scoring.gru_forward(rows, 5, scoring.gru_weights(seed=3))) == 2


def window_block(holes=0):
    draw = np.random.default_rng(7)
    rows, y = draw.normal(size=(60, 3)), draw.normal(size=60)
    ends = np.array([e for e in range(3, 60) if not holes or e % holes])
    block = regression._Block(rows, ends, y[ends], 4)
    return block, np.array([[1.0, *rows[e - 3 : e + 1].ravel(), y[e]] for e in ends])


@pytest.mark.parametrize("holes", [0, 2, 7])
def test_a_block_adds_up_what_its_windows_do(holes):
    block, full = window_block(holes)
    draw = np.random.default_rng(8)
    beta, factors = draw.normal(size=13), draw.normal(size=len(full))
    assert block.errors(beta) == pytest.approx(full[:, -1] - full[:, :-1] @ beta)
    assert block.added(factors) == pytest.approx(factors @ full[:, :-1])
    assert regression._whole(block.products(), 14) == pytest.approx(full.T @ full)
    some, weights = factors > 0, draw.random((factors > 0).sum())
    assert regression._whole(block.products(some, weights), 14) == pytest.approx((weights[:, None] * full[some]).T @ full[some])


def test_a_step_takes_out_the_windows_that_cross_the_threshold_only(spark, std, monkeypatch):
    labelled = std.withColumn("label", F.hash("ticker", "date") / 2**30)
    panel = regression.pack(labelled, 2, [0, 3])
    rows = np.array([[1.0, *r.x, r.y] for r in regression.window_rows(labelled, 2, [0, 3]).collect()])
    before, now = regression._Point(np.zeros(5), 1.0), regression._Point(np.array([0.2, 0.3, -0.1, 0.0, 0.1]), 0.9)
    step = regression._beyond(panel.rows, panel.blocks, before, now)
    error, was = rows[:, -1] - rows[:, :-1] @ now.beta, np.abs(rows[:, -1]) > 1.0
    far = np.abs(error) > 0.9
    assert (was & ~far).any() and (far & ~was).any() and step.n == far.sum()
    assert step.change == pytest.approx(rows[was & ~far].T @ rows[was & ~far] - rows[far & ~was].T @ rows[far & ~was])
    assert step.signs == pytest.approx(np.sign(error[far]) @ rows[far, :-1])
    # From a point to itself nothing crosses.
    assert not regression._beyond(panel.rows, panel.blocks, now, now).change.any()


@pytest.mark.parametrize("seed, noise, freedom, delta", [(3, 20.0, 1.1, 0.05), (5, 1.0, 2.0, 0.02)])
def test_few_windows_within_the_threshold(spark, seed, noise, freedom, delta):
    # The first has none at least squares; in the second, steps overshoot.
    draw = np.random.default_rng(seed)
    x = draw.standard_t(1.5 if freedom < 2 else 3, size=(200, 1))
    y = 3 * x[:, 0] + draw.standard_t(freedom, size=200) * noise
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)], "x array<double>, y double")
    model = regression.huber(df, 1, delta)
    assert model.converged
    assert all(abs(r.slope) < 1e-8 for r in regression.stationarity(df, model).collect())


def test_bars_and_gains_of_the_window_fit_are_made_once(spark):
    from barloom.catalog import scoring as queries, tables as t

    data, held = "/root/testdata/sf0.001", spark.sparkContext._jsc.getPersistentRDDs
    with queries.early(spark, data) as train:
        plan = train._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan and "Relation [l_" not in plan  # the lines are not read again
        got = {(r.ticker, r.date): (r.feature, r.label) for r in train.collect()}
        assert not held().isEmpty()
    assert held().isEmpty()
    labelled = t.labelled(spark, data).filter(F.col("date") < F.lit(t.CUTOFF).cast("date"))
    expected = {(r.ticker, r.date): (r.feature, r.label) for r in labelled.collect()}
    assert got.keys() == expected.keys() and got
    assert all(got[k][0] == pytest.approx(expected[k][0], abs=1e-6) and got[k][1] == pytest.approx(expected[k][1]) for k in got)
