import pathlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowguard.detectors import iforest, ocsvm, vae
from flowguard.operators import metrics as mt
from flowguard.plans import training as tr
from flowguard.sources import artifacts

COLS = [f"x{i}" for i in range(5)]


@pytest.fixture(scope="module")
def planted(spark):
    """Correlated benign rows and off-manifold outliers."""
    rng = np.random.RandomState(0)
    base = rng.normal(size=(3000, 2)) @ rng.normal(size=(2, 5)) + 0.1 * rng.normal(size=(3000, 5))
    odd = rng.normal(size=(300, 5)) * 4 + rng.choice([-6, 6], size=(300, 5))
    x = np.vstack([base, odd])
    pdf = pd.DataFrame(x, columns=COLS)
    pdf["label"] = [0] * 3000 + [1] * 300
    pdf["row_id"] = [f"r{i}" for i in range(3300)]
    return spark.createDataFrame(pdf).repartition(4).cache()


def auc(df, raw, sign):
    return mt.roc_auc(df.withColumn("score", F.col(raw) * sign)).first()[0]


def test_average_path():
    assert iforest.average_path(1) == 0 and iforest.average_path(2) == 1
    assert abs(float(iforest.average_path(256)) - 10.244770920116851) < 1e-9


def test_forest(spark, planted):
    benign = planted.filter("label = 0")
    f = iforest.IsolationForest.fit(benign, COLS, trees=60)
    assert f.nodes["depth"].max() <= 8 and set(f.nodes.groupby("tree").head(1)["size"]) == {256}
    out = f.raw_score(planted)
    assert auc(out, "if_raw", -1) > 0.9
    lo, hi = out.agg(F.min("if_raw"), F.max("if_raw")).first()
    assert -1 <= lo < hi <= 0
    again = iforest.IsolationForest.fit(benign.repartition(9), COLS, trees=60)
    assert again.nodes.equals(f.nodes)  # same seed, any partitioning
    stored = iforest.IsolationForest.from_df(f.to_df(spark), COLS, 256)
    x = np.random.RandomState(1).normal(size=(50, 5))
    assert np.array_equal(stored.scorer()(x), f.scorer()(x))


def test_forest_smaller_than_a_tree_sample(planted):
    f = iforest.IsolationForest.fit(planted.limit(40), COLS, trees=5)
    assert f.tree_rows == 40


def test_svm(spark, planted):
    m = ocsvm.OneClassSVM.fit(planted.filter("label = 0"), COLS)
    assert auc(m.raw_score(planted), "svm_raw", -1) > 0.9
    x = planted.filter("label = 0").select(*COLS).toPandas().to_numpy()
    assert abs(m.gamma - 1 / (5 * x.var())) < 1e-9
    again = ocsvm.OneClassSVM.from_df(m.to_df(spark))
    assert np.allclose(again.scorer()(x[:10]), m.scorer()(x[:10]))


def test_vae_gradients_numerically():
    class Fixed:
        """Same noise at every call; no dropout."""

        def bytes(self, n):
            return b"\xff" * n

        def standard_normal(self, shape, dtype=None):
            return np.random.RandomState(1).normal(size=shape)

    rng = np.random.RandomState(0)
    p, bn = vae.initial_state(4, 0)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    bn = {k: v.astype(np.float64) for k, v in bn.items()}
    x = rng.normal(size=(16, 4))

    def loss(params):
        run = {k: v.copy() for k, v in bn.items()}
        h1, _ = vae._block("e1", x, params, run, Fixed())
        h2, _ = vae._block("e2", h1, params, run, Fixed())
        mu, lv = h2 @ params["mu.w"] + params["mu.b"], h2 @ params["lv.w"] + params["lv.b"]
        z = mu + Fixed().standard_normal(mu.shape) * np.exp(0.5 * lv)
        g1, _ = vae._block("d1", np.hstack([z, h2]), params, run, Fixed())
        g2, _ = vae._block("d2", np.hstack([g1, h1]), params, run, Fixed())
        r = g2 @ params["out.w"] + params["out.b"]
        return ((r - x) ** 2).mean() + 0.3 * -0.5 * (1 + lv - mu**2 - np.exp(lv)).mean()

    g = vae.gradients(x, p, {k: v.copy() for k, v in bn.items()}, 0.3, Fixed())
    for name in ("e1.w", "e1.g", "e2.b", "e2.s", "mu.w", "lv.w", "d1.w", "d1.g", "d2.w", "d2.s", "out.w", "out.b"):
        at = tuple(rng.randint(s) for s in p[name].shape)
        up, down = {k: v.copy() for k, v in p.items()}, {k: v.copy() for k, v in p.items()}
        up[name][at] += 1e-6
        down[name][at] -= 1e-6
        assert abs((loss(up) - loss(down)) / 2e-6 - g[name][at]) < 1e-5, name


def test_vae_schedule():
    assert vae.learning_rate(1) == 1e-3 and vae.learning_rate(21) == 1e-3 and vae.learning_rate(61) == 1e-3
    assert vae.learning_rate(20) < 2e-5 and vae.kl_share(5) == 0.05 and vae.kl_share(50) == 0.1


def test_vae(spark, planted):
    benign = planted.filter("label = 0")
    train, val = benign.filter("hash(row_id) % 5 <> 0"), benign.filter("hash(row_id) % 5 = 0")
    m = vae.VAE.fit(train, val, COLS, max_epochs=30)
    out = m.raw_score(planted)
    assert auc(out, "ae_raw", 1) > 0.9
    again = vae.VAE.from_df(m.to_df(spark))
    x = np.random.RandomState(1).normal(size=(20, 5))
    assert np.allclose(again.scorer()(x), m.scorer()(x))
    assert (m.scorer("serve")(x) <= m.scorer()(x) + 1e-6).all()  # without the KL part


def test_training_scoring_and_artifacts(spark, planted, tmp_path):
    flows = planted.select("row_id", *COLS, F.when(F.col("label") == 0, "Benign").otherwise("Syn").alias("Label"))
    cfg = tr.TrainingConfig(trees=40, vae_epochs=15)
    model, scored = tr.train(flows, cfg)
    r = tr.evaluate_model(scored).first()
    assert r["roc_auc"] > 0.9
    probs = scored.agg(F.min("prob"), F.max("prob"), *[f(c) for c in ("if_score", "ae_score", "svm_score") for f in (F.min, F.max)]).first()
    assert all(0 <= v <= 1 for v in probs)
    folder = f"file://{tmp_path}/model"
    artifacts.save_artifacts(spark, model, folder)
    loaded = artifacts.load_artifacts(spark, folder)
    a = {r["row_id"]: r["prob"] for r in tr.score_flows(flows, loaded, ["row_id"]).collect()}
    b = {r["row_id"]: r["prob"] for r in scored.collect()}
    assert max(abs(a[k] - b[k]) for k in b) < 1e-5
    artifacts.save_metrics(tr.evaluate_model(scored), tr.evaluate_types(scored), 1.5, f"{folder}/metrics")
    m = spark.read.json(f"{folder}/metrics").first()
    assert m["training_time_seconds"] == 1.5 and m["per_attack_type"]["Benign"]["count"] > 0


def test_blocks_do_not_depend_on_batches():
    from flowguard.detectors.common import blocks

    whole = pd.DataFrame({"a": range(1000)})
    for size in (1, 7, 300, 1000):
        got = list(blocks((whole.iloc[i : i + size] for i in range(0, 1000, size)), 256))
        assert [len(b) for b in got] == [256, 256, 256, 232] and [v for b in got for v in b["a"]] == list(range(1000))


def test_models_do_not_depend_on_batches_or_partitions(spark, monkeypatch):
    from flowguard.detectors import common
    from flowguard.detectors.iforest import IsolationForest
    from flowguard.detectors.ocsvm import OneClassSVM
    from flowguard.detectors.vae import VAE

    for name in ("SHARD_ROWS", "MERGE_STATES"):
        monkeypatch.setattr(common, name, {"SHARD_ROWS": 150, "MERGE_STATES": 4}[name])
    rng = np.random.RandomState(1)
    pdf = pd.DataFrame(rng.normal(size=(1000, 3)), columns=["x", "y", "z"])
    pdf.insert(0, "row_id", [str(i) for i in range(1000)])
    found = []
    for parts, batch in ((2, "10000"), (5, "64")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        df = spark.createDataFrame(pdf).repartition(parts)
        svm = OneClassSVM.fit(df, ["x", "y", "z"], rounds=2)
        vae = VAE.fit(df, None, ["x", "y", "z"], max_epochs=2, local_epochs=1)
        forest = IsolationForest.fit(df, ["x", "y", "z"], trees=5, tree_rows=32)
        found.append((svm.weights, np.concatenate([v.ravel() for v in vae.params.values()]), forest.nodes))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    a, b = found
    assert np.allclose(a[0], b[0], atol=1e-12) and np.allclose(a[1], b[1], atol=1e-6) and a[2].equals(b[2])


def test_training_on_a_table_without_ids(spark):
    rng = np.random.RandomState(3)
    rows = [(float(a), float(b), "Benign") for a, b in rng.normal(size=(500, 2))] + [(float(a), float(b), "Syn") for a, b in rng.normal(4, 1, size=(200, 2))]
    rows += rows[:20]  # equal rows share an id
    flows = spark.createDataFrame(rows, "x double, y double, Label string")
    ids = [sorted(r["row_id"] for r in tr.with_row_id(df).collect()) for df in (flows, flows.repartition(7).select("Label", "y", "x"))]
    assert ids[0] == ids[1] and len(set(ids[0])) == 700
    cfg = tr.TrainingConfig(trees=20, tree_rows=64, svm_rounds=1, vae_epochs=2, vae_local_epochs=1)
    model, scored = tr.train(flows, cfg)
    assert model.scaler.feature_names and scored.filter("split = 'test'").count() > 0


def test_cosine_map_holds_no_large_arrays_when_scoring():
    """Equal to numpy's cosine, also for wide angles and NaN; scores need room for some rows of the map, not for all."""
    import tracemalloc

    w, b = ocsvm.cosine_map(3, 0.4, 512, 7)
    x = np.random.RandomState(2).normal(size=(20_000, 3))
    x[0], x[700], x[5000] = 1e9, np.nan, -300.0
    with np.errstate(invalid="ignore"):
        want = np.sqrt(2.0 / 512) * np.cos(x @ w + b)
        assert np.allclose(ocsvm.mapped(x, w, b), want, rtol=0, atol=1e-13, equal_nan=True)
        m = ocsvm.OneClassSVM(["x", "y", "z"], 0.4, 512, 7, np.linspace(-1, 1, 512), 0.25)
        score = m.scorer()
        tracemalloc.start()
        got = score(x)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert np.allclose(got, want @ m.weights - 0.25, rtol=0, atol=1e-10, equal_nan=True)
    assert most < 8 * 1024 * 1024


def test_joined_arrays_are_views_of_one():
    params, _ = vae.initial_state(4, 0)
    flat, views = vae._joined(params)
    assert list(views) == list(params) and all(np.array_equal(views[k], params[k]) for k in params)
    flat += 1
    assert all(np.array_equal(views[k], params[k] + 1) for k in params)


@pytest.mark.parametrize("features", [1, 3, 4, 12])
def test_forest_looks_leaves_up_as_a_walk_finds_them(features):
    rng = np.random.RandomState(features)
    x = rng.normal(size=(600, features)).round(1)
    grown = []
    for tree in range(6):
        t = pd.DataFrame(iforest.grow_tree(x[rng.choice(600, 256, replace=False)], 8, rng), columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        t.insert(0, "tree", tree)
        grown.append(t)
    f = iforest.IsolationForest([f"x{i}" for i in range(features)], pd.concat(grown, ignore_index=True), 256)
    x[::50, 0], x[7], x[8] = np.nan, np.inf, -np.inf
    cuts = f.nodes[f.nodes["feature"] == 0]["threshold"].to_numpy()[:100]
    x[100 : 100 + len(cuts), 0] = cuts  # values that equal a threshold go left, missing ones too

    def walk(row) -> float:
        total = 0.0
        for t in grown:
            node = t.iloc[0]
            while node["feature"] >= 0:
                node = t.iloc[int(node["right"] if row[int(node["feature"])] > node["threshold"] else node["left"])]
            total += node["depth"] + float(iforest.average_path(node["size"]))
        return total

    want = -np.power(2.0, -(np.array([walk(row) for row in x]) / len(grown)) / float(iforest.average_path(256)))
    assert np.array_equal(f.scorer()(x), want)


def test_forest_scores_cost_less_than_a_walk(monkeypatch):
    """300 trees of three features: a look-up per tree, against a step per level."""
    import time

    rng = np.random.RandomState(5)
    x = rng.normal(size=(10_000, 3))
    grown = []
    for tree in range(iforest.TREES):
        t = pd.DataFrame(iforest.grow_tree(x[rng.choice(10_000, 256, replace=False)], 8, rng), columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        t.insert(0, "tree", tree)
        grown.append(t)
    f = iforest.IsolationForest(["x", "y", "z"], pd.concat(grown, ignore_index=True), 256)

    def least(score) -> float:
        took = []
        for _ in range(3):
            started = time.process_time()
            score(x)
            took.append(time.process_time() - started)
        return min(took)

    table = least(f.scorer())
    monkeypatch.setattr(iforest, "PARTS", 0, raising=False)
    assert table < 0.5 * least(f.scorer())


def test_forest_puts_few_rows_in_order_to_draw_its_samples(spark, planted, monkeypatch):
    """Only rows near a drawn one are sorted; the samples are those at the drawn positions of all rows in key order."""
    from pyspark.sql import Window

    from flowguard.operators.prep import SEED, row_key

    ordered = []

    def watched(df, order_by, *more):
        ordered.append(df.count())
        return ranged(df, order_by, *more)

    ranged = iforest.ranged
    monkeypatch.setattr(iforest, "ranged", watched)
    monkeypatch.setattr(iforest, "DRAWN_DIGITS", 2, raising=False)
    rows = planted.select("row_id", *COLS).unionByName(planted.select("row_id", *COLS).limit(200))  # ids that come twice
    rows = rows.unionByName(planted.limit(50).select(F.lit(None).cast("string").alias("row_id"), *COLS))  # and none
    f = iforest.IsolationForest.fit(rows, COLS, trees=3, tree_rows=8)
    assert len(ordered) == 1 and ordered[0] < 1000 < rows.count()
    slim = rows.select(*COLS, "row_id")
    keyed = slim.withColumn("h", row_key(slim, SEED, ["row_id"]))
    whole = keyed.withColumn("i", F.row_number().over(Window.orderBy("h"))).orderBy("i").toPandas()
    grown = []
    for tree in range(3):
        at = np.sort(np.random.default_rng([SEED, tree]).choice(len(whole), 8, replace=False))
        t = pd.DataFrame(iforest.grow_tree(whole[COLS].to_numpy()[at], 3, np.random.RandomState(SEED + tree)), columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        grown.append(t.assign(tree=tree)[["tree", *t.columns]])
    pd.testing.assert_frame_equal(f.nodes, pd.concat(grown, ignore_index=True), check_dtype=False)


def folders(spark):
    from urllib.parse import urlparse

    from flowguard.session import ensure_checkpoint_dir

    top = pathlib.Path(urlparse(ensure_checkpoint_dir(spark)).path)
    return {p for p in [*top.glob("flowguard-staged-*"), *top.glob("rdd-*")] if p.is_dir()}


def test_training_keeps_only_the_tables_that_it_returns(spark):
    from flowguard.plans.training import TrainingConfig, train

    rng = np.random.default_rng(4)
    rows = [(i, "Benign" if i % 3 else "Syn", float(rng.normal()), float(rng.normal() + (i % 3 == 0)), float(rng.random())) for i in range(600)]
    flows = spark.createDataFrame(rows, "row_id long, Label string, a double, b double, c double")
    before = folders(spark)
    _, scored = train(flows, TrainingConfig(trees=5, tree_rows=16, svm_rounds=1, vae_epochs=2, vae_local_epochs=1))
    left = folders(spark) - before
    assert [p.name[:17] for p in left if p.name[0] == "f"] == ["flowguard-staged-"]  # raw scores, of the tables written on the way
    assert sum(p.name[0] == "r" for p in left) <= 1  # the drawn rows of the forest; no shards
    assert scored.count() == 400 - 280 + 200


def test_released_tables_are_deleted(spark):
    from flowguard.session import materialise, release, staged

    for make in (staged, materialise):
        before = folders(spark)
        table = make(spark.range(7))
        assert table.count() == 7 and len(folders(spark) - before) == 1
        release(table.filter("id > 2") if make is staged else table)
        assert folders(spark) == before
    kept = materialise(spark.range(7))
    release(kept.filter("id > 2"))  # neither a checkpoint nor a staged table
    assert kept.count() == 7


def test_packed_ranges_come_back_by_value():
    from flowguard.operators import selection as sl

    v = np.array([5, -4 * 10**18, 4 * 10**18, 5, 0])
    rows = pd.DataFrame({"feature": np.int32(2), "y": np.array([1, 0, 1, 0, 1], np.int32), "v": v, "_slice": 3})
    (packed,) = sl._packed(iter([rows]))
    ((feature, no, points),) = sl._unpacked(iter([packed]))
    assert (feature, no) == (2, 3) and points["v"].tolist() == sorted(v.tolist()) and points["y"].tolist() == [0, 1, 0, 1, 1]
