import random

import pytest
from pyspark.sql import functions as F

from flowguard.functions import net, text
from flowguard.operators import monitor as mo, ordered, telemetry as tm

COUNTER = "host string, iface string, ts_us bigint, sample_id bigint, rx_bytes bigint, tx_bytes bigint"


def samples(spark, rows):
    return spark.createDataFrame([("h", "eth0", int(t * 1_000_000), i, rx, tx) for i, (t, rx, tx) in enumerate(rows)], COUNTER)


def test_rates_reset_and_first_sample(spark):
    df = samples(spark, [(0, 100, 10), (2, 300, 10), (3, 50, 30), (7200, 50 + 7197, 30)])
    got = [(r["rx_rate"], r["tx_rate"]) for r in tm.counter_rates(df).orderBy("ts_us").collect()]
    assert got == [(0.0, 0.0), (100.0, 0.0), (0.0, 20.0), (1.0, 0.0)]


def test_samples_too_close_are_ignored_against_the_last_accepted(spark):
    # 6 ms apart: 0 accepted, 6 ignored, 12 accepted, 18 ignored, 24 accepted
    df = samples(spark, [(0, 0, 0), (0.006, 6, 0), (0.012, 12, 0), (0.018, 18, 0), (0.024, 24, 0), (1.024, 1024, 0)])
    got = [(r["sample_id"], r["rx_rate"]) for r in tm.counter_rates(df).orderBy("ts_us").collect()]
    assert [g[0] for g in got] == [0, 2, 4, 5]
    assert abs(got[1][1] - 1000) < 1e-6 and abs(got[3][1] - 1000) < 1e-9


def test_history_is_cut_at_sixty(spark):
    df = samples(spark, [(i, i * i, 0) for i in range(75)])
    last = tm.rate_history(tm.counter_rates(df)).orderBy(F.desc("ts_us")).first()
    assert len(last["rx_history"]) == 60 and list(last["rx_history"]) == [2 * i - 1 for i in range(15, 75)]


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_rolling_over_blocks_and_slices(spark, block):
    df = spark.range(50).select(F.lit("k").alias("k"), (F.col("id") * 900_000_000).alias("ts_us"), "id")
    out = ordered.rolling(df, ["k"], ordered.time_slice("ts_us", 3600), ["ts_us"], 3, {"s": lambda w: F.sum("id").over(w)}, block)
    assert {r["id"]: r["s"] for r in out.collect()} == {i: sum(range(max(0, i - 2), i + 1)) for i in range(50)}


def test_row_numbers_with_and_without_keys(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.pmod(F.hash("id"), F.lit(10**9)).cast("long").alias("ts_us"), "id")
    rows = df.collect()
    for keys in ([], ["k"]):
        got = ordered.number_rows(df, keys, F.floor(F.col("ts_us") / 1000).cast("long"), ["ts_us", "id"]).collect()
        for r in got:
            peers = [x for x in rows if (x["ts_us"], x["id"]) <= (r["ts_us"], r["id"]) and (not keys or x["k"] == r["k"])]
            assert r["row_no"] == len(peers)


def test_rate_report(spark):
    df = spark.range(2500).select((F.col("id") * 1000).alias("ts_us"), F.col("id").alias("pkt_id"))
    got = [tuple(r) for r in mo.rate_every_n(df).orderBy("report_no").collect()]
    assert [g[:3] for g in got] == [(1, 1000, 999_000), (2, 2000, 1_999_000)]
    assert abs(got[0][3] - 1000 / 0.999) < 1e-9 and abs(got[1][3] - 1000) < 1e-9


def test_endpoints(spark):
    cases = {"*:*": (None, None), "": (None, None), "[::1]:80": ("::1", "80"), "1.2.3.4:5": ("1.2.3.4", "5"), "*:53": (None, "53"), "1.2.3.4:*": ("1.2.3.4", None), "host": ("host", None), "fe80::1:99": ("fe80::1", "99")}
    df = spark.createDataFrame([(a,) for a in cases], "a string").withColumn("e", net.split_endpoint("a"))
    assert {r["a"]: tuple(r["e"]) for r in df.collect()} == cases


def test_private_addresses(spark):
    private = ["10.0.0.1", "172.16.0.1", "172.31.9.9", "192.168.0.1", "127.0.0.1", "0.0.0.0", "::", "::1", "fe80::1", "fc00::1", "fd12::1", "ff02::1", "169.254.1.1", "224.0.0.1", "239.1.1.1"]
    public = ["172.15.0.1", "172.32.0.1", "11.0.0.1", "192.169.0.1", "8.8.8.8", "2001:db8::1", "225.0.0.1", "100.0.0.0"]
    df = spark.createDataFrame([(a,) for a in private + public], "a string")
    assert [r[0] for r in df.select(net.is_private_ip("a")).collect()] == [True] * len(private) + [False] * len(public)


def test_number_formats(spark):
    values = [0, 999, 1000, 1150, 1250, 1350, 999_949, 1_000_000, 1_500_000_000, 12_345_678_901]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    def want(v):
        for step, unit in ((10**9, "GB"), (10**6, "MB"), (10**3, "KB")):
            if v >= step:
                return f"{v / step:.1f} {unit}"
        return f"{v} B"
    assert [r[0] for r in df.select(text.format_bytes("v")).collect()] == [want(v) for v in values]
    rates = spark.createDataFrame([(0.5,), (1.5,), (999.4,), (1250.0,)], "v double")
    assert [r[0] for r in rates.select(text.format_rate("v")).collect()] == ["0  B/s", "2  B/s", "999  B/s", "1.2 KB/s"]
    probs = [0.0005, 0.0015, 0.1235, 0.9995, 1.0, 0.32517587939698495, 2 / 3]
    df = spark.createDataFrame([(v,) for v in probs], "v double")
    assert [r[0] for r in df.select(text.to_fixed("v", 3)).collect()] == [f"{v:.3f}" for v in probs]


def test_states(spark):
    want = {"ESTAB": "established", "ESTABLISHED": "established", "LISTEN": "listen", "SYN-SENT": "connecting", "TIME-WAIT": "closing", "FIN_WAIT2": "closing", "UNCONN": "other"}
    df = spark.createDataFrame([(s,) for s in want], "s string")
    assert [r[0] for r in df.select(net.state_class("s")).collect()] == list(want.values())
    assert df.select(net.state_class("s", F.lit(False))).first()[0] == "closed"


SOCK = "snap bigint, host string, protocol string, local_addr string, remote_addr string, state string, pid bigint, process_name string, event_id bigint"


def sock(snap, remote, state="ESTABLISHED", pid=1, name="p", eid=0):
    return (snap, "h", "tcp", "l:1", remote, state, pid, name, eid)


def test_lifetimes_keep_first_sighting(spark):
    rows = [sock(1, "a:1", "SYN_SENT", name="first"), sock(2, "a:1"), sock(2, "b:1", pid=None, name=None), sock(3, "b:1", pid=None, name=None), sock(5, "a:1", "TIME_WAIT", name="later"), sock(5, "c:1"), sock(5, "c:1")]
    got = {r["remote_addr"]: r for r in tm.connection_lifetimes(spark.createDataFrame(rows, SOCK)).collect()}
    a, b = got["a:1"], got["b:1"]
    assert (a["first_seen"], a["last_seen"], a["state"], a["process_name"], a["is_active"]) == (1, 5, "TIME_WAIT", "first", True)
    assert (b["first_seen"], b["last_seen"], b["pid"], b["is_active"]) == (2, 3, None, False)
    assert tuple(tm.lifetime_summary(tm.connection_lifetimes(spark.createDataFrame(rows, SOCK))).first()) == (2, 1, 3)


@pytest.mark.parametrize("limit", [0, 3, 6, 50])
def test_eviction(spark, limit):
    rows = [("h", "tcp", "l", f"r{i}", i, i, 100 + i, "X", "p", i % 3 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "host string, protocol string, local_addr string, remote_addr string, pid bigint, first_seen bigint, last_seen bigint, state string, process_name string, is_active boolean")
    kept = {r["pid"] for r in tm.evict_inactive(df, limit, salts=3).collect()}
    active = {i for i in range(20) if i % 3 == 0}
    old_first = [i for i in range(20) if i not in active]
    assert kept == active | set(old_first[min(max(20 - limit, 0), len(old_first)):])


def test_timeline_cells(spark):
    rows = [("h", "tcp", "l", "r", 1, 0, 100, "X", "p", True), ("h", "tcp", "l", "r2", 2, 70, 70, "X", "p", False), ("h", "tcp", "l", "r3", 3, 10, 39, "X", "p", False)]
    df = spark.createDataFrame(rows, "host string, protocol string, local_addr string, remote_addr string, pid bigint, first_seen bigint, last_seen bigint, state string, process_name string, is_active boolean")
    got = {r["pid"]: (r["start_cell"], r["end_cell"]) for r in tm.timeline_cells(df, 100, 60, 6).collect()}
    assert got == {1: (0, 6), 2: (3, 4)}
    assert [r["pid"] for r in tm.timeline(df, 100, 60).collect()] == [1, 2]


def test_health_and_heat(spark):
    rows = [("h", "gw", i, i * 1_000_000, rtt, loss) for i, (rtt, loss) in enumerate([(5.0, 0.0), (50.0, 0.0), (None, 100.0), (100.0, 0.5), (20.0, 60.0)])]
    df = spark.createDataFrame(rows, "host string, target string, probe_id bigint, ts_us bigint, rtt_ms double, loss_pct double")
    got = [(r["severity"], r["link"]) for r in tm.health_level(df).orderBy("probe_id").collect()]
    assert got == [("good", "good"), ("good", "degraded"), ("bad", "none"), ("good", "bad"), ("bad", "bad")]
    heat = [(r["level"], r["band"]) for r in tm.rtt_heat(df).orderBy("probe_id").collect()]
    assert heat == [(7, "critical"), (7, "critical"), (None, "gap"), (7, "critical"), (1, "low")]


def test_interface_views(spark):
    now = spark.createDataFrame([("h", "eth0", 1500.0, 0.0, 2000, 5, 1, 2, 3, 4), ("h", "lo", 9.0, 9.0, 9, 9, 0, 0, 0, 0), ("h", "eth9", 1.0, 2.0, 9, 9, 0, 1, 0, 0)], "host string, iface string, rx_rate double, tx_rate double, rx_bytes bigint, tx_bytes bigint, rx_errors bigint, tx_errors bigint, rx_drops bigint, tx_drops bigint")
    info = spark.createDataFrame([("h", "eth0", "1.2.3.4", None, None, 1500, True), ("h", "lo", "127.0.0.1", None, None, None, True), ("h", "eth1", None, None, None, None, True), ("h", "eth2", "9.9.9.9", None, None, None, True)], "host string, iface string, ipv4 string, ipv6 string, mac string, mtu int, is_up boolean")
    assert tuple(tm.bandwidth_total(now, info).first()) == ("h", 1500.0, 0.0, "eth0")
    table = {r["iface"]: r for r in tm.interface_table(now, info).collect()}
    assert (table["eth0"]["rx_rate"], table["eth0"]["errors"], table["eth0"]["drops"], table["eth0"]["status"]) == ("1.5 KB/s", 3, 7, "UP")
    assert (table["eth9"]["ipv4"], table["eth9"]["status"]) == ("—", "DOWN")
    assert tuple(tm.host_summary(info).first()) == ("h", "1.2.3.4", "eth0 +2")
    assert tuple(tm.total_errors(now).first()) == ("h", 4)


def test_messages(spark):
    d = spark.createDataFrame([("1.1.1.1", 5, "2.2.2.2", 80, 6, 3_725_000_000, 0.98765, True, 12, 0.1, 0.2, 0.3)], "src_ip string, src_port int, dst_ip string, dst_port int, protocol int, close_us bigint, prob double, is_attack boolean, packets bigint, if_score double, ae_score double, svm_score double")
    assert mo.format_alert(d).first()["message"] == "[62:05] 🚨 ATTACK  1.1.1.1:5 → 2.2.2.2:80 TCP | prob=0.988"
    assert mo.format_detection(d).first()["message"].endswith("TCP | 12 pkts | prob=0.988 | IF=0.100 AE=0.200 SVM=0.300")
    s = spark.createDataFrame([(0, 3, 2, 1)], "tick_us bigint, expired bigint, benign bigint, attacks bigint")
    line = mo.format_sweep(s)
    assert line.first()["message"] == "[00:10] ── Sweep: 3 flows expired, 2 benign, 1 attacks ──"
    assert mo.classify_log(line).first()["kind"] == "aggregate"


def test_pages(spark):
    df = spark.range(95)
    ids = lambda **kw: [r[0] for r in mo.page(df, ["id"], 10, **kw).collect()]
    assert ids(start=20) == list(range(20, 30)) and ids(start=500) == list(range(85, 95)) == ids(follow=True) and ids(start=-3) == list(range(10))
    assert [r[0] for r in mo.latest_n(df, 3, ["id"]).collect()] == [94, 93, 92]


def greedy(times, gap):
    kept, last = [], None
    for t, i in sorted(times):
        if last is None or t - last >= gap:
            kept.append(i)
            last = t
    return sorted(kept)


def test_bursts_of_thousands_through_composed_slices(spark, monkeypatch):
    from flowguard.operators import bursts

    monkeypatch.setattr(bursts, "GROUP_SLICES", 4)
    rng = random.Random(12)
    made, t = [], 0
    for i in range(6000):  # chains across many slices, ties, pauses and a dense stretch
        t += rng.choice([0, 1, 300, 900, 4_000, 9_999]) if i % 500 else rng.choice([10_000, 60_000, 900_000])
        made.append((t, i))
    rows = [("h", f"eth{k}", ts + 777 * k, i, i, i) for k in range(2) for ts, i in made[k * 900 :]]
    df = spark.createDataFrame(rows, COUNTER)
    got = tm.accepted_samples(df).select("iface", "sample_id").collect()
    for k in range(2):
        assert sorted(r[1] for r in got if r[0] == f"eth{k}") == greedy([(ts, i) for ts, i in made[k * 900 :]], 10_000)
    direct = bursts.accepted_rows(df.filter("iface = 'eth0'"), ["host", "iface"], ["ts_us", "sample_id"], 2_500, slice_us=20_000)
    assert sorted(r["sample_id"] for r in direct.collect()) == greedy(made, 2_500)
    plan = tm.accepted_samples(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_active_flows_by_events(spark):
    from flowguard.operators.flows import active_flows

    rng = random.Random(3)
    spans = [(a := rng.randrange(500_000_000), a + rng.randrange(90_000_000)) for _ in range(400)]
    moments = sorted({0, *rng.sample(range(800_000_000), 60), spans[0][0], spans[1][1] + 120_000_000, spans[2][1] + 120_000_001})
    flows = spark.createDataFrame(spans, "start_us long, last_us long")
    want = {m: sum(a <= m <= b + 120_000_000 for a, b in spans) for m in moments}
    assert {r[0]: r[1] for r in active_flows(flows, moments).collect()} == want
    table = spark.createDataFrame([(m,) for m in moments * 2], "at_us long")
    assert {r[0]: r[1] for r in active_flows(flows, table, slice_s=37.0).collect()} == want
    plan = active_flows(flows, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "Join Cross" not in plan


def test_any_page_is_the_slice_of_the_sorted_rows(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, 1, 2, 2, 3])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(5)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for start in (0, 3, 700, 711, 1480, 1499, 5000):
        at = min(start, len(want) - 25)
        assert [tuple(r) for r in mo.page(df, ["-v", "id"], 25, start, shallow=50).collect()] == want[at : at + 25]
    assert [tuple(r) for r in mo.page(df, ["-v", "id"], 25, follow=True, shallow=10).collect()] == want[-25:]
    deep = mo.page(df, ["-v", "id"], 25, 700, shallow=50)._jdf.queryExecution().executedPlan().toString()
    assert "_range" in deep and "TakeOrderedAndProject" in deep


def test_short_bursts_need_no_walk(spark, monkeypatch):
    made, t = [], 0
    for i in range(300):  # copies of one moment and samples right after it, now and then a chain that goes on for several gaps
        t += 30_000_000
        made += [(t + (4_000 * k if i % 50 == 7 else 900 * (k // 2)), 10 * i + k) for k in range(8)]
    walked = []
    monkeypatch.setattr(tm, "accepted_rows", lambda rows, *a, real=tm.accepted_rows: (walked.append(rows.count()), real(rows, *a))[1])
    df = spark.createDataFrame([("h", "eth0", ts, i, i, i) for ts, i in made], COUNTER)
    assert sorted(r["sample_id"] for r in tm.accepted_samples(df).collect()) == greedy(made, 10_000)
    assert walked == [6 * 6]  # of each long chain its start and the five samples from 10 ms on


def test_repeated_samples_and_samples_without_time(spark):
    made = [(0, 1), (0, 1), (50_000, 2), (50_000, 2), (50_300, 3), (75_000, 4), (75_000, 4), (79_000, 5), (84_000, 6), (86_000, 7)]
    df = spark.createDataFrame([("h", "eth0", ts, i, i, i) for ts, i in made] + [("h", "eth1", None, 8, 1, 1), ("h", "eth1", 10, 9, 1, 1), ("h", "eth1", 20, 10, 1, 1)], COUNTER)
    got = tm.accepted_samples(df).select("iface", "sample_id").collect()
    assert sorted(r[1] for r in got if r[0] == "eth0") == [1, 2, 4, 7]
    assert [r[1] for r in got if r[0] == "eth1"] == [9]
