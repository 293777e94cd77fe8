import random

from pyspark.sql import functions as F

from flowguard.operators import flows as fl
from flowguard.sources.flows import read_packet_stream
from flowguard.streaming import reports as rp
from flowguard.streaming.flows import _CELL, flow_events_stream, flow_features_stream, flow_table_stream, flows_of, late_of, reduce_cells
from flowguard.streaming.runs import drain, drain_to_end

from test_flows import SCHEMA, A, B, back, frame, packet, random_packets


def write_batches(spark, path, batches):
    for i, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.parquet(f"file://{path}/b{i:03d}")


def stream(spark, path):
    return read_packet_stream(spark, f"file://{path}/*", schema=SCHEMA, max_files=1)


def sentinel(t):
    return packet(10**9, t, ("9.9.9.9", 9), ("8.8.8.8", 8))


def run_to_end(packets, build):
    """Rows of a stream drained to its end, and the last progress report."""
    seen = []

    def run(flow, folder):
        table = f"{folder}/table"
        query = flow.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(table)
        query.awaitTermination()
        seen.append(query.lastProgress)
        return flow.sparkSession.read.schema(flow.schema).parquet(table)

    return drain_to_end(packets, build, run).collect(), seen[-1]


def test_stream_equals_batch_in_any_order_within_the_delay(spark, tmp_path):
    rows = random_packets(160, 11)
    rng = random.Random(5)
    delayed = sorted(rows, key=lambda r: r[1] + rng.random() * 25_000_000)  # up to 25 s late
    write_batches(spark, tmp_path, [delayed[i : i + 40] for i in range(0, 160, 40)])
    end = max(r[1] for r in rows)
    got, progress = run_to_end(stream(spark, tmp_path), lambda p: flow_features_stream(p, watermark="25 seconds", buckets=2, end_us=end))
    want = fl.flow_features(frame(spark, rows)).collect()
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r["closed"] for r in got} == {True, False}
    assert sum(s["numRowsTotal"] for s in progress["stateOperators"]) == 0  # nothing is held after the end


def test_boundary_inside_one_batch(spark, tmp_path):
    write_batches(spark, tmp_path, [[packet(1, 10), packet(2, 130), back(3, 251), back(4, 252)]])
    got, _ = run_to_end(stream(spark, tmp_path), flow_table_stream)
    assert sorted((r["flow_id"], r["packets"], r["src_ip"], r["closed"]) for r in got) == [(1, 2, A[0], True), (3, 2, B[0], False)]


def test_late_packets_leave_as_rows_with_their_line(spark, tmp_path):
    batches = [[packet(1, 10), packet(2, 11)], [sentinel(1000)], [packet(3, 12), packet(4, 999.5), packet(5, 994)], [packet(6, 998), packet(7, 991)]]
    write_batches(spark, tmp_path, batches)
    rows, _ = run_to_end(stream(spark, tmp_path), lambda p: flow_events_stream(p, min_packets=1, watermark="0 seconds"))
    found = spark.createDataFrame(rows, flow_events_stream(stream(spark, tmp_path)).schema)
    late = {r["pkt_id"]: (r["ts_us"], r["line_us"], r["ip_a"]) for r in late_of(found).collect()}
    # slices of 5 s: all up to 1000 s have ended when the sentinel of 1000 s has been seen
    assert late == {i: (int(t * 1e6), 1_000_000_000, B[0]) for i, t in ((3, 12), (4, 999.5), (5, 994), (6, 998), (7, 991))}
    assert {r["flow_id"]: r["packets"] for r in flows_of(found).collect()} == {1: 2, 10**9: 1}


def test_cells_of_a_hot_conversation_equal_the_batch_cells(spark):
    rng = random.Random(8)
    rows = [(packet if rng.random() < 0.6 else back)(i, rng.random() * 40, payload=rng.randrange(1500)) for i in range(3000)]
    width = 5_000_000
    keyed = fl.flow_key(frame(spark, rows)).withColumn("slice_us", F.col("ts_us") - F.pmod("ts_us", F.lit(width))).toPandas()
    cells = [dict(zip(_CELL, c.tolist(), strict=True)) for c in reduce_cells(keyed.sample(frac=1, random_state=1))["cell"]]
    want = fl.flow_cells(frame(spark, rows)).orderBy("slice_us").collect()
    assert len(cells) == len(want) == 8
    for c, w in zip(sorted(cells, key=lambda c: c["first_us"]), want, strict=True):
        for n in ("first_us", "last_us", "n_a", "n_b", "bytes_a", "bytes_sq_b", "len_max_a", "psh_b", "gap_n", "gap_sq", "gap_a_max", "gap_b_min", "ack"):
            assert c[n] == w[n], n
        assert (c["win_a"], c["open_pkt"]) == (w["win_a"]["window_size"], w["opening"]["pkt_id"])


def test_sweep_stream(spark, tmp_path):
    times = [1, 3, 9.9, 10, 25, 60]
    write_batches(spark, tmp_path, [[packet(i, t)] for i, t in enumerate(times)])
    d = stream(spark, tmp_path).select(F.col("ts_us").alias("close_us"), (F.col("pkt_id") % 2 == 1).alias("is_attack"))
    got = sorted(tuple(r) for r in drain(rp.sweep_summary_stream(d)).collect())
    assert got == [(0, 3, 2, 1), (10_000_000, 1, 0, 1), (20_000_000, 1, 1, 0)]


SOCKETS = "host string, snap bigint, event_id bigint, protocol string, local_addr string, remote_addr string, pid bigint, state string, process_name string"


def greedy_tracker(batches, limit, keep_for):
    """The same rules on plain dictionaries, one micro-batch after another."""
    known = {}
    for rows in batches:
        for _, snap, event, *key, state, process in sorted(rows, key=lambda r: (r[1], r[2])):
            first, _, name, _ = known.get(tuple(key), (snap, None, process, None))
            known[tuple(key)] = (first, snap, name, state)
        newest = max(v[1] for v in known.values())
        active = {k: v for k, v in known.items() if v[1] == newest}
        idle = sorted(((v[0], k) for k, v in known.items() if v[1] < newest and (keep_for is None or v[1] >= newest - keep_for)), reverse=True)
        known = active | {k: known[k] for _, k in idle[: max(limit - len(active), 0)]}
    return {k: (*v, v[1] == newest) for k, v in known.items()}


def test_tracked_connections_stay_bounded(spark, tmp_path):
    rng = random.Random(4)
    batches = []
    for no in range(5):
        batches.append([("h", no * 3 + s, no * 1000 + s * 100 + i, "TCP", f"10.0.0.1:{rng.randrange(40)}", "1.2.3.4:443", 7, rng.choice(["ESTABLISHED", "CLOSING"]), "p") for s in range(3) for i in range(6)])
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SOCKETS).coalesce(1).write.parquet(f"file://{tmp_path}/in/b{i}")
    for limit, keep_for in ((12, None), (1000, 4), (1000, None)):
        snapshots = read_packet_stream(spark, f"file://{tmp_path}/in/*", schema=SOCKETS, max_files=1)
        path = f"file://{tmp_path}/out{limit}{keep_for}"
        stored = rp.tracked_connections_stream(snapshots, limit=limit, keep_for=keep_for).writeStream.option("checkpointLocation", f"{path}-c").trigger(availableNow=True)

        def save(rows, batch_id):
            rp.save_tracked(rows, batch_id, path)
            rp.save_tracked(rows, batch_id, path)  # as after a failure

        stored.foreachBatch(save).start().awaitTermination()
        got = spark.read.schema(rp.TRACKED).parquet(path).collect()
        want = greedy_tracker(batches, limit, keep_for)
        assert {(r["protocol"], r["local_addr"], r["remote_addr"], r["pid"]): (r["first_seen"], r["last_seen"], r["process_name"], r["state"], r["is_active"]) for r in got} == want
        assert len(got) == len(want) and (limit > 100 or len(got) <= limit)


def test_tracker_brings_its_state_store(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    schema = "snap long, event_id long, host string, protocol string, local_addr string, remote_addr string, state string, pid long, process_name string"
    spark.createDataFrame([(1, 1, "h", "tcp", "a:1", "b:2", "LISTEN", 7, "p")], schema).write.parquet(f"file://{tmp_path}/in")
    try:
        tracked = rp.tracked_connections_stream(read_packet_stream(spark, f"file://{tmp_path}/in", schema=schema))
        assert [(r["pid"], r["is_active"]) for r in drain(tracked).collect()] == [(7, True)]
    finally:
        spark.conf.set(provider, before)


def test_held_packets_are_reduced_in_whole_slices(monkeypatch):
    import numpy as np
    import pandas as pd

    from flowguard.streaming import flows as st

    rng = np.random.default_rng(5)
    n = 3000
    ts = rng.integers(0, 40_000_000, n)
    ts[:900] = rng.integers(15_000_000, 20_000_000, 900)  # one slice with more rows than are taken at once
    packets = pd.DataFrame({"ip_a": "a", "port_a": rng.integers(1, 5, n).astype("int32"), "ip_b": "b", "port_b": np.int32(2), "protocol": np.int32(6), "slice_us": ts - ts % 5_000_000, "ts_us": ts, "pkt_id": np.arange(n), "from_a": rng.integers(0, 2, n) == 1, "payload_len": rng.integers(0, 900, n), "header_len": 20, "tcp_flags": 16, "window_size": 7})

    class Held:
        rows = [st._packed(packets[:1700]), st._packed(packets[1700:])]
        get = exists = clear = put = lambda self, *a: self.rows

    reducer = st.SliceReducer(5_000_000)
    reducer.held, reducer.next = Held(), Held()
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 10**9})()
    sizes = []
    monkeypatch.setattr(st, "REDUCE_ROWS", 700, raising=False)
    monkeypatch.setattr(st, "reduce_cells", lambda rows, real=reduce_cells: (sizes.append((len(rows), rows["slice_us"].nunique())), real(rows))[1])
    got = pd.concat(list(reducer.handleExpiredTimer(None, clock, None)))
    assert all(rows <= 700 or slices == 1 for rows, slices in sizes) and sum(r for r, _ in sizes) == n
    want = reduce_cells(packets)
    assert sorted((p, *c) for p, c in zip(got["port_a"], got["cell"])) == sorted((p, *c) for p, c in zip(want["port_a"], want["cell"]))


class Kept:
    """A state variable and the timers of one key, without Spark."""

    def __init__(self):
        self.rows, self.timers = [], set()

    def get(self):
        return self.rows if self.many else self.rows[0]

    def put(self, rows):
        self.rows, self.many = list(rows), True

    def update(self, row):
        self.rows, self.many = [row], False

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_one_step_merges_the_flows_of_a_whole_bucket(spark):
    import pandas as pd

    from flowguard.streaming import flows as st

    rng = random.Random(3)
    timeout, width, end = 10_000, 5_000_000, 60_000
    rows = []
    for i in range(600):  # gaps whose squares need more than 64 bits, and a port that is missing
        src, dst = rng.choice([(A, B), (B, A), (("1.1.1.1", 7), B), (("1.1.1.1", None), B)])
        rows.append(packet(i, rng.random() * end * rng.random() ** 4, src, dst, payload=rng.randrange(1500), flags=rng.randrange(64), window=rng.randrange(9999)))
    want = fl.flow_features(frame(spark, rows), timeout_s=timeout, end_us=end * 1_000_000)
    keyed = fl.flow_key(frame(spark, rows)).withColumn("slice_us", F.col("ts_us") - F.pmod("ts_us", F.lit(width))).toPandas()
    keyed["from_a"] = [True if x is None else x for x in keyed["from_a"]]
    step = st.FlowProcessor(width, timeout * 1_000_000, 5_000_000, 2, end * 1_000_000)
    step.held, step.next, step.handle = Kept(), Kept(), Kept()
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: self.ms})()
    info = type("Info", (), {"getExpiryTimeInMs": lambda self: min(step.handle.timers)})()
    found = []
    for clock.ms in [*range(5_000, end * 1000, 5_000_000), st.END_US // 1000]:
        on_time = keyed["slice_us"] + width <= clock.ms * 1000
        if on_time.any():
            cells = reduce_cells(keyed[on_time])
            cells["late"], cells["line_ts"] = False, pd.Timestamp(0)
            found += step.handleInputRows(None, iter([cells[: len(cells) // 2], cells[len(cells) // 2 :]]), clock)
        keyed = keyed[~on_time]
        assert len(step.handle.timers) <= 1
        if step.handle.timers and min(step.handle.timers) < clock.ms:
            found += step.handleExpiredTimer(None, clock, info)
            step.handle.timers = {step.next.get()[0]} if step.next.exists() else set()
    assert not step.held.rows and not step.next.rows
    table = pd.concat(found, ignore_index=True)
    events = [(*(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r[:5]), r[5].tolist(), r[6].tolist(), bool(r[7]), bool(r[8]), None, r[10].to_pydatetime()) for r in table.itertuples(index=False, name=None)]
    got = fl.features_of(flows_of(spark.createDataFrame(events, st.EVENT_SCHEMA)))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert got.agg(F.max("Idle Max")).first()[0] > 3.1e9 and got.agg(F.count_if("closed")).first()[0] > 0


def test_arrivals_come_from_one_pass_in_order(spark, tmp_path):
    import datetime

    from flowguard.plans.catalog import streams

    start = datetime.datetime(2024, 1, 1)
    times = [None, *(start + datetime.timedelta(seconds=s) for s in (5_000, 10, 400_000, 310_000, 700_000))]  # packets run a thousand times faster
    rows = [(i, t, i, "click", 1.0, "{}") for i, t in enumerate(times)]
    spark.createDataFrame(rows, streams.EVENTS).write.parquet(f"file://{tmp_path}/events.parquet")
    arrivals = streams.arriving(spark, f"file://{tmp_path}")
    assert arrivals.isStreaming
    seen = []
    query = arrivals.writeStream.trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c")
    query.foreachBatch(lambda rows, no: seen.append(sorted(r["pkt_id"] for r in rows.select("pkt_id").collect()))).start().awaitTermination()
    assert seen == [[1, 2], [3, 4], [5]]  # the packet without a time arrives never
