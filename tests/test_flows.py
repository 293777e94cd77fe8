import math
import random

import pytest
from pyspark.sql import functions as F

from flowguard.operators import flows as fl

SCHEMA = "pkt_id bigint, ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, payload_len int, header_len int, tcp_flags int, window_size int"
A, B = ("192.168.1.1", 5000), ("10.0.0.1", 80)


def packet(i, t, src=A, dst=B, payload=100, flags=0, window=65535, header=20, protocol=6):
    return (i, int(t * 1_000_000), src[0], dst[0], src[1], dst[1], protocol, payload, header, flags, window)


def back(i, t, **kw):
    kw.setdefault("flags", fl.TCP_ACK)
    kw.setdefault("window", 32768)
    return packet(i, t, B, A, **kw)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def features(spark, rows, **kw):
    return fl.flow_features(frame(spark, rows), **kw).orderBy("start_us").collect()


def test_feature_count_and_order(spark):
    df = fl.flow_features(frame(spark, [packet(1, 0), packet(2, 1)]))
    assert len(fl.FEATURE_NAMES) == 54
    assert df.columns[-54:] == fl.FEATURE_NAMES
    assert fl.FEATURE_NAMES[0] == "Protocol"
    assert len({c.lower() for c in df.columns}) == len(df.columns)


def test_bidirectional_counts_and_bytes(spark):
    r = features(spark, [packet(1, 0, payload=100), packet(2, 1, payload=200), back(3, 2, payload=150)])
    assert len(r) == 1
    f = r[0]
    assert (f["Total Fwd Packets"], f["Total Backward Packets"]) == (2, 1)
    assert (f["Fwd Packets Length Total"], f["Bwd Packets Length Total"]) == (300, 150)
    assert (f["Fwd Packet Length Max"], f["Fwd Packet Length Min"], f["Fwd Packet Length Mean"]) == (200, 100, 150)
    assert (f["Init Fwd Win Bytes"], f["Init Bwd Win Bytes"]) == (65535, 32768)
    for a, b in (("Subflow Fwd Packets", "Total Fwd Packets"), ("Subflow Fwd Bytes", "Fwd Packets Length Total"), ("Subflow Bwd Packets", "Total Backward Packets"), ("Subflow Bwd Bytes", "Bwd Packets Length Total")):
        assert f[a] == f[b]
    assert (f["src_ip"], f["src_port"]) == A


def test_first_packet_decides_direction(spark):
    f = features(spark, [back(1, 0), packet(2, 1), packet(3, 2)])[0]
    assert (f["src_ip"], f["src_port"]) == B
    assert (f["Total Fwd Packets"], f["Total Backward Packets"]) == (1, 2)


def test_running_stats(spark):
    rows = [packet(i, i, payload=v) for i, v in enumerate([2, 4, 4, 4, 5, 5, 7, 9])]
    f = features(spark, rows)[0]
    assert f["Packet Length Mean"] == 5
    assert abs(f["Packet Length Variance"] - 32 / 7) < 1e-10
    assert abs(f["Fwd Packet Length Std"] - math.sqrt(32 / 7)) < 1e-10
    assert (f["Bwd Packet Length Max"], f["Bwd Packet Length Std"], f["Bwd IAT Total"]) == (0, 0, 0)


def test_single_packet_is_dropped_or_finite(spark):
    assert features(spark, [packet(1, 0, payload=0)]) == []
    f = features(spark, [packet(1, 0, payload=0)], min_packets=1)[0]
    assert all(f[n] is not None and math.isfinite(f[n]) for n in fl.FEATURE_NAMES)


def test_flags(spark):
    rows = [packet(1, 0, flags=fl.TCP_SYN), back(2, 0.1, flags=fl.TCP_SYN | fl.TCP_ACK), packet(3, 0.2, flags=fl.TCP_ACK | fl.TCP_PSH), back(4, 0.3, flags=fl.TCP_PSH | fl.TCP_URG | fl.TCP_RST)]
    r = fl.flag_counts(fl.flow_table(frame(spark, rows))).first()
    assert (r["syn_count"], r["ack_count"], r["urg_count"], r["rst_count"], r["psh_fwd_count"]) == (2, 2, 1, 1, 1)


def test_timeout_is_strict(spark):
    rows = [packet(1, 0), packet(2, 120), back(3, 240.000001), back(4, 241)]
    r = features(spark, rows)
    assert [(x["Total Fwd Packets"], x["Flow Duration"]) for x in r] == [(2, 120e6), (2, 999999)]
    assert r[1]["src_ip"] == B[0]  # a reopened flow has a fresh direction


def test_zero_timeout_splits_every_time_step(spark):
    assert len(features(spark, [packet(1, 0), packet(2, 0), packet(3, 1), packet(4, 1)], timeout_s=0)) == 2


def test_active_and_idle(spark):
    times = [0, 1, 2, 10, 11, 30, 31]
    f = features(spark, [packet(i, t) for i, t in enumerate(times)])[0]
    assert (f["Active Min"], f["Idle Max"]) == (1e6, 19e6)  # the trailing active period is not recorded
    r = fl.active_idle(fl.flow_table(frame(spark, [packet(i, t) for i, t in enumerate(times)]))).first()
    assert (r["idle_count"], r["active_max"], r["idle_min"], r["idle_mean"]) == (2, 2e6, 8e6, 13.5e6)
    exact = features(spark, [packet(1, 0), packet(2, 5)])[0]
    assert exact["Idle Max"] == 0  # a gap of exactly the threshold is not idle


def test_inter_arrival(spark):
    rows = [packet(1, 0), back(2, 1), packet(3, 3), back(4, 6)]
    f = features(spark, rows)[0]
    assert (f["Flow IAT Mean"], f["Flow IAT Max"], f["Flow IAT Min"]) == (2e6, 3e6, 1e6)
    assert (f["Fwd IAT Total"], f["Bwd IAT Total"]) == (3e6, 5e6)
    got = {r["pkt_id"]: (r["iat_us"], r["fwd_iat_us"], r["bwd_iat_us"]) for r in fl.inter_arrival(frame(spark, rows)).collect()}
    assert got == {1: (None, None, None), 2: (1_000_000, None, None), 3: (2_000_000, 3_000_000, None), 4: (3_000_000, None, 5_000_000)}


def test_end_to_end_shape(spark):
    rows = [packet(i, i * 0.01, payload=100 + 50 * i) for i in range(5)] + [back(5 + i, 0.1 + i * 0.01, payload=200) for i in range(3)]
    r = features(spark, rows)
    assert len(r) == 1 and (r[0]["Total Fwd Packets"], r[0]["Total Backward Packets"]) == (5, 3)


def test_same_endpoint_on_both_sides(spark):
    f = features(spark, [packet(1, 0, A, A), packet(2, 1, A, A)])[0]
    assert (f["Total Fwd Packets"], f["Total Backward Packets"]) == (2, 0)


def random_packets(n, seed):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice([0, 0.0001, 0.5, 3, 5, 5.5, 40, 121])
        # one conversation holds most packets
        peer = B if rng.random() < 0.7 else ("10.0.0.9", rng.randint(1, 4))
        src, dst = (A, peer) if rng.random() < 0.6 else (peer, A)
        rows.append(packet(i, t, src, dst, payload=rng.randint(0, 1500), flags=rng.randint(0, 63), window=rng.randint(0, 65535)))
    return rows


@pytest.mark.parametrize("parts,slice_s", [(1, None), (3, 0.5), (17, 0.000001)])
def test_invariant_under_partitioning_order_and_slice(spark, parts, slice_s):
    rows = random_packets(400, 7)
    base = fl.flow_features(frame(spark, rows).coalesce(1)).orderBy("flow_id").collect()
    shuffled = frame(spark, random.Random(1).sample(rows, len(rows))).repartition(parts)
    assert fl.flow_features(shuffled, slice_s=slice_s).orderBy("flow_id").collect() == base


def test_plan_has_no_sort_of_a_whole_conversation(spark):
    plan = fl.flow_features(frame(spark, [packet(1, 0)]))._jdf.queryExecution().toString()
    exchanges = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and sum("slice_us" in e for e in exchanges) == 1


def test_active_flow_count(spark):
    flows = fl.flow_table(frame(spark, [packet(1, 0), packet(2, 10)]), min_packets=1)
    got = {r["at_us"]: r["active_flows"] for r in fl.active_flows(flows, [0, 130_000_000, 130_000_001]).collect()}
    assert got == {0: 1, 130_000_000: 1, 130_000_001: 0}


def test_timestamp_packets(spark):
    df = frame(spark, [packet(1, 0), packet(2, 1)]).withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us")
    assert fl.flow_features(df).first()["Flow Duration"] == 1e6
