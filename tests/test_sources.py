import json

import pytest
from pyspark.sql import functions as F

from flowguard.sources import artifacts, flows, frames, text as tx


def ipv4(proto, body, options=b"", pad=b""):
    head = bytes([0x45 + len(options) // 4, 0]) + (20 + len(options) + len(body)).to_bytes(2, "big") + bytes(5) + bytes([proto]) + bytes(2)
    return bytes(12) + b"\x08\x00" + head + bytes([10, 0, 0, 1]) + bytes([10, 0, 0, 2]) + options + body + pad


def tcp(payload=b"", offset=5):
    return (1234).to_bytes(2, "big") + (80).to_bytes(2, "big") + bytes(8) + bytes([offset << 4, 0x18]) + (513).to_bytes(2, "big") + bytes(4 + 4 * (offset - 5)) + payload


def udp(payload=b"", length=None):
    return (53).to_bytes(2, "big") + (5353).to_bytes(2, "big") + (8 + len(payload) if length is None else length).to_bytes(2, "big") + bytes(2) + payload


def test_frames(spark):
    cases = {
        "tcp": ipv4(6, tcp(b"x" * 10)), "options": ipv4(6, tcp(b"y" * 7, offset=8), options=b"\x01" * 8), "padded": ipv4(6, tcp(), pad=bytes(6)),
        "udp": ipv4(17, udp(b"z" * 5)), "udp_short_length": ipv4(17, udp(b"", length=3)), "bad_offset": ipv4(6, tcp(b"q", offset=5)[:12] + bytes([0xF0]) + tcp(b"q")[13:]),
        "arp": bytes(12) + b"\x08\x06" + bytes(28), "v6": bytes(12) + b"\x86\xdd" + bytes(40), "cut_eth": bytes(13), "cut_ip": ipv4(6, tcp())[:33],
        "cut_tcp": ipv4(6, tcp())[:53], "cut_udp": ipv4(17, udp())[:41], "icmp": ipv4(1, bytes(8)),
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "name string, frame binary")
    got = {r["name"]: r for r in frames.inspect_frames(df).collect()}
    row = lambda n: (got[n]["payload_len"], got[n]["header_len"], got[n]["tcp_flags"], got[n]["window_size"])
    assert row("tcp") == (10, 20, 0x18, 513) and row("options") == (7, 32, 0x18, 513) and row("padded") == (0, 20, 0x18, 513)
    assert row("udp") == (5, 8, 0, 0) and row("udp_short_length") == (0, 8, 0, 0) and row("bad_offset") == (0, 60, 0x18, 513)
    assert (got["tcp"]["src_ip"], got["tcp"]["src_port"], got["tcp"]["dst_ip"], got["tcp"]["dst_port"]) == ("10.0.0.1", 1234, "10.0.0.2", 80)
    reasons = {n: got[n]["reject"] for n in cases if got[n]["reject"]}
    assert reasons == {"arp": "not ipv4", "v6": "not ipv4", "cut_eth": "short ethernet", "cut_ip": "short ipv4", "cut_tcp": "short tcp", "cut_udp": "short udp", "icmp": "not tcp or udp"}
    assert frames.decode_frames(df).count() == 6 and frames.rejected_frames(df).agg(F.sum("n")).first()[0] == 7


def lines(spark, *rows):
    return spark.createDataFrame([("h", r) for r in rows], "host string, line string")


def test_ss(spark):
    df = lines(spark, "Netid State Recv-Q Send-Q Local Peer Process", 'tcp   ESTAB  0 0  10.0.0.1:22   1.2.3.4:5   users:(("sshd",pid=77,fd=3))', "udp UNCONN 0 0 *:68 *:*", 'tcp LISTEN 0 128 [::]:80 [::]:* users:(("nginx",pid=oops,fd=6))', "short line")
    got = [tuple(r)[1:] for r in tx.parse_ss(df).collect()]
    assert got == [("TCP", "10.0.0.1:22", "1.2.3.4:5", "ESTAB", 77, "sshd", "ESTABLISHED"), ("UDP", "*:68", "*:*", "UNCONN", None, None, "UNCONN"), ("TCP", "[::]:80", "[::]:*", "LISTEN", None, "nginx", "LISTEN")]


def test_lsof(spark):
    df = lines(spark, "COMMAND PID USER FD TYPE DEVICE SIZE/OFF NODE NAME", "Google 99 me 3u IPv4 0x1 0t0 TCP 10.0.0.1:5->8.8.8.8:443 (ESTABLISHED)", "mdns 7 me 3u IPv4 0x1 0t0 UDP *:5353", "x y")
    got = [tuple(r)[1:6] for r in tx.parse_lsof(df).collect()]
    assert got == [("TCP", "10.0.0.1:5", "8.8.8.8:443", "ESTABLISHED", 99), ("UDP", "*:5353", "*:*", "", 7)]


def test_netstat(spark):
    df = lines(spark, "Active Connections", "  Proto  Local Address  Foreign Address State PID", "  TCP    1.1.1.1:1   2.2.2.2:2   ESTABLISHED   10", "  UDP    0.0.0.0:53   *:*    20", "  TCP 1.1.1.1:1 2.2.2.2:2 LISTENING")
    procs = tx.parse_processes(spark.createDataFrame([('"a.exe","10","Console","1","12,345 K"',), ("junk",)], "line string"))
    got = sorted(tuple(r)[1:7] for r in tx.parse_netstat(df, procs).collect())
    assert got == [("TCP", "1.1.1.1:1", "2.2.2.2:2", "ESTABLISHED", 10, "a.exe"), ("UDP", "0.0.0.0:53", "*:*", "", 20, None)]


def test_ping(spark):
    cases = [
        ("3 packets transmitted, 3 received, 0% packet loss, time 2003ms\nrtt min/avg/max/mdev = 0.045/0.050/0.055/0.004 ms", (0.050, 0.0)),
        ("3 packets transmitted, 2 packets received, 33.3% packet loss\nround-trip min/avg/max/stddev = 1.2/2.3/3.4/0.5 ms\n", (2.3, 33.3)),
        ("3 sent,12.5% packet loss", (None, 12.5)),
        ("Packets: Sent = 3, Received = 3, Lost = 0 (0% loss),\r\nMinimum = 1ms, Maximum = 3ms, Average = 2ms\r\n", (2.0, 100.0)),
        ("ping: unknown host", (None, 100.0)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    assert [(r["rtt_ms"], r["loss_pct"]) for r in tx.parse_ping(df).orderBy("i").collect()] == [c[1] for c in cases]


def test_counter_files_on_disk(spark, tmp_path):
    for iface, files in {"eth0": {"rx_bytes": "12\n", "rx_dropped": "3"}, "lo": {"tx_bytes": "bad"}}.items():
        folder = tmp_path / iface / "statistics"
        folder.mkdir(parents=True)
        for name, value in files.items():
            (folder / name).write_text(value)
    raw = tx.read_counter_files(spark, f"file://{tmp_path}/*/statistics/*").withColumn("host", F.lit("h"))
    got = {r["iface"]: r for r in tx.parse_counter_files(raw, ["host"]).collect()}
    assert (got["eth0"]["rx_bytes"], got["eth0"]["rx_drops"], got["eth0"]["tx_errors"], got["lo"]["tx_bytes"]) == (12, 3, 0, 0)


def test_counter_files_are_dealt_before_they_are_grouped(spark):
    """No task keeps a table of the interfaces of all files it reads: nothing is grouped below the only exchange."""
    rows = [(h, f"/sys/class/net/eth{h % 2}/statistics/{f}", str(h)) for h in range(50) for f in ("rx_bytes", "tx_dropped", "unknown")]
    out = tx.parse_counter_files(spark.createDataFrame(rows, "host int, path string, text string"), ["host"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan.rsplit("Exchange hashpartitioning", 1)[1]
    assert {(r["host"], r["iface"], r["rx_bytes"], r["tx_drops"], r["rx_drops"]) for r in out.collect()} == {(h, f"eth{h % 2}", h, h, 0) for h in range(50)}


def test_geo_file(spark, tmp_path):
    rows = [{"ip": "1.1.1.1", "status": "success", "countryCode": "AU", "city": None, "as": "AS1"}, {"ip": "2.2.2.2", "status": "fail"}, {"ip": "3.3.3.3", "status": "success"}]
    (tmp_path / "geo.json").write_text("\n".join(json.dumps(r) for r in rows))
    assert [tuple(r) for r in tx.read_geo(spark, f"file://{tmp_path}/geo.json").collect()] == [("1.1.1.1", "AU", "", "AS1")]


def test_read_flows_unites_columns(spark, tmp_path):
    spark.range(2).withColumn("a", F.lit(1.0)).coalesce(1).write.parquet(f"file://{tmp_path}/in/x")
    spark.range(3).withColumn("b", F.lit(2.0)).coalesce(1).write.parquet(f"file://{tmp_path}/in/y")
    df = flows.read_flows(spark, f"file://{tmp_path}/in/*")
    assert set(df.columns) == {"id", "a", "b"} and df.count() == 5 and df.filter("b IS NULL").count() == 2
    with pytest.raises(FileNotFoundError):
        flows.read_flows(spark, f"file://{tmp_path}/nothing")


def test_config_files(spark, tmp_path):
    good = {
        "scaler.json": {"mean": [1.0, 2.0], "scale": [1.0, 0.5], "feature_names": ["a", "b"], "n_features": 2, "log_transformed_columns": ["a"], "dropped_mi_columns": []},
        "normalization_params.json": {"isolation_forest": {"p1": -0.6, "p99": -0.3}, "autoencoder": {"score_min": 0.0, "score_max": 0.1}, "one_class_svm": {"score_min": -4.0, "score_max": 3.0}},
        "ensemble_config.json": {"type": "logistic_regression", "n_models": 3, "coefficients": [1.0, 2.0, 3.0], "intercept": -0.5, "threshold": 0.3, "model_names": ["x", "y", "z"], "optimized": True, "unknown": 1},
    }
    for name, doc in good.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=2))
    folder = f"file://{tmp_path}"
    scaler, bounds, ensemble = artifacts.load_configs(spark, folder)
    assert (scaler.n_features, bounds.p99, ensemble.threshold, ensemble.coefficients) == (2, -0.3, 0.3, [1.0, 2.0, 3.0])
    for bad in ('{"mean": ', json.dumps({**good["scaler.json"], "mean": "text"}), json.dumps({"mean": [1.0]})):
        (tmp_path / "scaler.json").write_text(bad)
        with pytest.raises(ValueError):
            artifacts.load_configs(spark, folder)


def test_long_counters(spark):
    from flowguard.sources.text import _count
    from pyspark.sql import functions as F

    texts = ["1234567890123456789", "9223372036854775807", "+0000000000000000000000012", "99999999999999999999", "12x", None]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(_count(F.col("t")).alias("v")).collect()]
    assert got == [1234567890123456789, 9223372036854775807, 12, 0, 0, 0]
