"""Packets to alerts: batch, stream, sink and artifacts agree."""

import pytest
from pyspark.sql import functions as F

from flowguard.operators import flows as fl
from flowguard.plans import detection as de
from flowguard.plans.catalog.detection import MODEL
from flowguard.sources.artifacts import load_artifacts, save_artifacts
from flowguard.streaming import runs
from flowguard.streaming.runs import drain_to_end, read_detections, run_folder, save_batch, write_detections_stream

from test_flows import frame, random_packets
from test_streaming import stream, write_batches


def plain(df):
    return sorted((r["flow_id"], r["packets"], r["closed"], round(r["prob"], 9), r["is_attack"]) for r in df.collect())


def test_eight_packets_give_one_scored_flow(spark):
    from test_flows import back, packet

    rows = [packet(i, i * 0.1) for i in range(5)] + [back(10 + i, 0.05 + i * 0.1) for i in range(3)]
    r = de.detect_flows(frame(spark, rows), MODEL).collect()
    assert len(r) == 1 and r[0]["packets"] == 8
    assert all(0.0 <= r[0][c] <= 1.0 for c in ("if_score", "ae_score", "svm_score", "prob"))


def test_wrong_features_are_an_error(spark):
    from dataclasses import replace

    other = replace(MODEL, scaler=replace(MODEL.scaler, feature_names=["Nothing", *MODEL.scaler.feature_names[1:]]))
    with pytest.raises(ValueError, match="Nothing"):
        de.detect_flows(frame(spark, random_packets(10, 1)), other)


def test_replayed_batch_is_recorded_once(spark, tmp_path, monkeypatch):
    rows = random_packets(120, 3)
    write_batches(spark, tmp_path, [rows[:60], rows[60:]])
    path, failures = run_folder(spark), []

    def fail_once(found, batch_id, where):
        save_batch(found, batch_id, where)
        if batch_id == 1 and not failures:
            failures.append(batch_id)
            raise RuntimeError("lost after writing")

    monkeypatch.setattr(runs, "save_batch", fail_once)

    def run(found, folder):
        for _ in range(2):
            try:
                write_detections_stream(found, path, f"{folder}/checkpoint", available_now=True).awaitTermination()
            except Exception:
                assert failures
                continue
            break
        return read_detections(spark, path, found.schema)

    end = max(r[1] for r in rows)
    got = drain_to_end(stream(spark, tmp_path), lambda p: de.detect_flows_stream(p, MODEL, end_us=end, buckets=2), run)
    assert failures == [1]
    assert plain(got) == plain(de.detect_flows(frame(spark, rows), MODEL))


def test_sweeps_of_the_chain_cover_every_flow_once(spark, tmp_path):
    rows = random_packets(90, 21)
    write_batches(spark, tmp_path, [rows[:30], rows[30:]])
    got = drain_to_end(stream(spark, tmp_path), lambda p: de.sweeps_stream(p, MODEL, buckets=2)).collect()
    flows = de.detect_flows(frame(spark, rows), MODEL)
    assert sum(r["expired"] for r in got) == flows.count()
    assert sum(r["attacks"] for r in got) == flows.filter("is_attack").count()
    assert all(r["tick_us"] % 10_000_000 == 0 for r in got)


def test_detection_plan_scores_once(spark):
    plan = de.detect_flows(frame(spark, random_packets(20, 2)), MODEL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "CartesianProduct" not in plan


def test_all_six_artifacts_come_back(spark, tmp_path):
    folder = f"file://{tmp_path}/model"
    save_artifacts(spark, MODEL, folder)
    back = load_artifacts(spark, folder)
    packets = frame(spark, random_packets(60, 4))
    want = {r["flow_id"]: r for r in de.detect_flows(packets, MODEL).collect()}
    for r in de.detect_flows(packets, back).collect():
        assert r["if_raw"] == want[r["flow_id"]]["if_raw"] and abs(r["svm_raw"] - want[r["flow_id"]]["svm_raw"]) < 1e-12
        assert abs(r["ae_raw"] - want[r["flow_id"]]["ae_raw"]) < 1e-4 * abs(r["ae_raw"])  # weights are stored as 32-bit numbers
    assert back.scaler == MODEL.scaler and back.bounds == MODEL.bounds and back.ensemble.coefficients == MODEL.ensemble.coefficients
    assert back.forest.nodes.equals(MODEL.forest.nodes.astype(back.forest.nodes.dtypes))
    assert fl.FEATURE_NAMES == back.vae.columns
    assert {k: v.shape for k, v in back.vae.params.items()} == {k: v.shape for k, v in MODEL.vae.params.items()}


def test_alert_lines(spark):
    packets = frame(spark, random_packets(60, 4))
    lines = de.alerts(de.detect_flows(packets, MODEL))
    assert lines.filter(~F.col("message").contains("ATTACK")).count() == 0
    assert lines.count() == de.detect_flows(packets, MODEL).filter("is_attack").count()
