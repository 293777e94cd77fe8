"""Online flow building in two stateful steps, both closed by event time.

Step one is keyed by (bucket of conversations, lane of time slices). It holds the packets of a slice until the stream's
time line has passed the slice's end, then reduces each conversation's packets in it to one cell of integer moments.
Packets may arrive in any order within that delay. A packet whose slice has already been reduced is late: it leaves as a
row of its own, with the line it missed, instead of being dropped silently.

Step two is keyed by a finer bucket of conversations. It holds one row of constant size per open flow, merges the cells of
all conversations of the bucket into these rows at once, in time order, and emits a flow when the line has passed its timeout.
So no step sorts a conversation's packets, neighbouring slices of a hot conversation are reduced by different tasks, a step is
called per bucket and not per conversation, and the flows equal the batch result on the accepted packets.

``end_of_input`` adds a marker to a stream of packets; when it arrives, all open flows are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from flowguard.operators.flows import (
    FLOW_TIMEOUT_S, IDLE_THRESHOLD_S, KEY, MIN_PACKETS, TCP_ACK, TCP_PSH, TCP_RST, TCP_SYN, TCP_URG,
    features_of, flow_key, slice_width_us, with_micros,
)

SIDES = ("fwd", "bwd")
ENDS = ("a", "b")
#: Conversations are dealt to buckets and their slices to lanes in turn, open flows to buckets of their own; a stream keeps the numbers for life.
BUCKETS, LANES, FLOW_BUCKETS = 16, 4, 64
#: Open flows in one value of the state store.
HELD_FLOWS = 4096
#: Packets reduced at once; whole slices, so a slice with more is one step.
REDUCE_ROWS = 16_384
#: Event time of the end marker (the year 2200); no packet is as new.
END_US = 7_258_118_400_000_000

_KEY_TYPES = {"ip_a": "string", "port_a": "int", "ip_b": "string", "port_b": "int", "protocol": "int"}
_PACKET = ["ts_us", "pkt_id", "from_a", "payload_len", "header_len", "tcp_flags", "window_size"]
_FLAGS = {"syn": TCP_SYN, "ack": TCP_ACK, "urg": TCP_URG, "rst": TCP_RST}
_GAPS = ["n", "sum", "sq", "min", "max"]
_SIDE = ["n", "bytes", "bytes_sq", "len_min", "len_max", "header", "header_min", "data", "psh", "first_us", "last_us", "win"]

#: A cell's numbers; what has no packet or gap is 0 beside a count of 0.
_CELL = (
    ["first_us", "last_us", "open_pkt", "open_from_a"]
    + [f"{n}_{e}" for e in ENDS for n in _SIDE]
    + [f"{g}_{n}" for g in ("gap", "gap_a", "gap_b") for n in _GAPS]
    + list(_FLAGS)
)
#: Numbers travel as one array: a frame of few columns is what a step receives and returns for each key.
#: Of a late packet the cell holds first_us (its time), open_pkt (its id) and last_us (the line it missed).
CELL_SCHEMA = ", ".join(f"{k} {t}" for k, t in _KEY_TYPES.items()) + ", late boolean, cell array<bigint>, line_ts timestamp"

_NUMBERS = ["flow_id", "start_us", "last_us", "packets"]
for _d in SIDES:
    _NUMBERS += [f"{_d}_{n}" for n in ("n", "bytes", "len_min", "len_max", "header", "header_min", "data", "psh", "win")]
for _p in ("iat", "fwd_iat", "bwd_iat"):
    _NUMBERS += [f"{_p}_{n}" for n in ("n", "sum", "min", "max")]
_NUMBERS += [*_FLAGS, "idle_count"]
for _p in ("active", "idle"):
    _NUMBERS += [f"{_p}_{n}" for n in ("min", "max", "sum")]
#: Sums of squares need more than 64 bits.
_SQUARES = ["fwd_bytes_sq", "bwd_bytes_sq", "iat_sq", "fwd_iat_sq", "bwd_iat_sq", "active_sq", "idle_sq"]
_ENDPOINTS = {"src_ip": "string", "src_port": "int", "dst_ip": "string", "dst_port": "int", "protocol": "int"}
#: An open flow is held as one cell of all its packets, with high halves of the squares (2^32), and what a cell does not know.
_HALVES = [n for n in _CELL if n.endswith("_sq") or n.startswith("bytes_sq")]
_PERIOD = ["sum", "min", "max", "sq", "sq_high"]
_OPEN = [*_CELL, *(f"{n}_high" for n in _HALVES), "active_start_us", "idle_count", *(f"{p}_{n}" for p in ("active", "idle") for n in _PERIOD)]
_FLOW = ", ".join(f"{k} {t}" for k, t in _ENDPOINTS.items()) + ", numbers array<bigint>, squares array<bigint>"
EVENT_SCHEMA = f"{_FLOW}, closed boolean, late boolean, line_us bigint, sweep_ts timestamp"
_EVENT = [f.split()[0] for f in EVENT_SCHEMA.split(", ")]
#: A number is unknown where its count is 0.
_COUNTED = {f"{d}_{n}": f"{d}_n" for d in SIDES for n in ("len_min", "len_max", "header_min")}
_COUNTED |= {f"{p}_{n}": f"{p}_n" for p in ("iat", "fwd_iat", "bwd_iat") for n in ("min", "max")}
_COUNTED |= {f"{p}_{n}": "idle_count" for p in ("active", "idle") for n in ("min", "max", "sum")}


def _per_cell(out: dict[str, np.ndarray], prefix: str, values: np.ndarray, cell: np.ndarray, names: dict[str, str]) -> np.ndarray:
    """Counts, sums and extremes of ``values`` by ascending ``cell`` into the columns named; first index of each cell present."""
    at = np.flatnonzero(np.diff(cell, prepend=-1))
    if not len(at):
        return at
    ids = cell[at]
    totals = {
        "n": np.diff(np.append(at, len(cell))),
        "sum": np.add.reduceat(values, at),
        "sq": np.add.reduceat(values * values, at),
        "min": np.minimum.reduceat(values, at),
        "max": np.maximum.reduceat(values, at),
    }
    for total, name in names.items():
        out[name.format(prefix)][ids] = totals[total]
    return at


def reduce_cells(packets: pd.DataFrame) -> pd.DataFrame:
    """Packets -> one cell per (conversation, slice), any order in, one sort for all of them."""
    codes = [pd.factorize(packets[k], use_na_sentinel=False)[0] for k in (*KEY, "slice_us")]
    ts, pkt = packets["ts_us"].to_numpy(np.int64), packets["pkt_id"].to_numpy(np.int64)
    order = np.lexsort((pkt, ts, *codes))
    opens = np.zeros(len(order), dtype=bool)
    opens[:1] = True
    for code in codes:
        opens[1:] |= np.diff(code[order]) != 0
    cell, first = np.cumsum(opens) - 1, np.flatnonzero(opens)
    ts, pkt = ts[order], pkt[order]
    from_a = packets["from_a"].to_numpy(bool)[order]
    length, header, flags, window = (packets[c].to_numpy(np.int64)[order] for c in ("payload_len", "header_len", "tcp_flags", "window_size"))
    out = {n: np.zeros(len(first), dtype=np.int64) for n in _CELL}
    last = np.append(first[1:], len(ts)) - 1
    out["first_us"], out["last_us"], out["open_pkt"], out["open_from_a"] = ts[first], ts[last], pkt[first], from_a[first].astype(np.int64)
    inner = np.flatnonzero(~opens)
    _per_cell(out, "gap", ts[inner] - ts[inner - 1], cell[inner], {n: f"{{}}_{n}" for n in _GAPS})
    for end, mine in (("a", np.flatnonzero(from_a)), ("b", np.flatnonzero(~from_a))):
        own, size = cell[mine], length[mine]
        lead = _per_cell(out, end, size, own, {"n": "n_{}", "sum": "bytes_{}", "sq": "bytes_sq_{}", "min": "len_min_{}", "max": "len_max_{}"})
        if len(lead):
            ids = own[lead]
            _per_cell(out, end, header[mine], own, {"sum": "header_{}", "min": "header_min_{}"})
            _per_cell(out, end, (size > 0).astype(np.int64), own, {"sum": "data_{}"})
            _per_cell(out, end, (flags[mine] & TCP_PSH != 0).astype(np.int64), own, {"sum": "psh_{}"})
            _per_cell(out, end, ts[mine], own, {"min": "first_us_{}", "max": "last_us_{}"})
            out[f"win_{end}"][ids] = window[mine][lead]
        same = np.flatnonzero(np.diff(own) == 0) + 1
        _per_cell(out, f"gap_{end}", ts[mine][same] - ts[mine][same - 1], own[same], {n: f"{{}}_{n}" for n in _GAPS})
    for name, bit in _FLAGS.items():
        out[name] = np.add.reduceat((flags & bit != 0).astype(np.int64), first)
    cells = packets[[*KEY, "slice_us"]].iloc[order[first]].reset_index(drop=True)
    cells["cell"] = list(np.column_stack([out[n] for n in _CELL]))
    return cells


def _stamp(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms * 1_000_000)


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    batch = pa.RecordBatch.from_pandas(rows[[*KEY, "slice_us", *_PACKET]], preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def whole_slices(slices: np.ndarray, rows: int) -> Iterator[slice]:
    """Stretches of ascending ``slices`` that cut none in two, of ``rows`` rows at most unless one slice has more."""
    edges = np.append(np.flatnonzero(np.diff(slices)) + 1, len(slices))
    start = 0
    while start < len(slices):
        last = int(np.searchsorted(edges, start + rows, side="right")) - 1
        end = int(edges[max(last, int(np.searchsorted(edges, start, side="right")))])
        yield slice(start, end)
        start = end


class SliceReducer(StatefulProcessor):
    """(bucket, lane): holds packets until the line passes their slice's end; packets that come later are late."""

    def __init__(self, width_us: int) -> None:
        self.width_us = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.next = handle.getValueState("next", "timer_ms bigint")

    def _ends(self, rows: pd.DataFrame) -> np.ndarray:
        return -(-(rows["slice_us"].to_numpy(np.int64) + self.width_us) // 1000)

    def _wake(self, at: int) -> None:
        """One timer, at the earliest end of a slice that is held."""
        known = self.next.get()[0] if self.next.exists() else None
        if known is None or at < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(at)
            self.next.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        line, wake = timerValues.getCurrentWatermarkInMs(), None
        for part in rows:
            ends = self._ends(part)
            late = ends <= line
            if late.any():
                yield self._late(part[late], line)
            if not late.all():
                self.held.appendValue(_packed(part[~late]))
                wake = min(int(ends[~late].min()), wake or END_US)
        if wake is not None:
            self._wake(wake)

    def _late(self, part: pd.DataFrame, line: int) -> pd.DataFrame:
        out = part[KEY].reset_index(drop=True)
        out["late"] = True
        cell = np.zeros((len(part), len(_CELL)), dtype=np.int64)
        for n, values in (("first_us", part["ts_us"]), ("open_pkt", part["pkt_id"]), ("last_us", line * 1000)):
            cell[:, _CELL.index(n)] = values
        out["cell"] = list(cell)
        out["line_ts"] = _stamp(line + 1)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pa.concat_tables([pa.ipc.open_stream(r[0]).read_all() for r in self.held.get()], promote_options="permissive")
        self.next.clear()
        slices = held["slice_us"].to_numpy()
        ends = -(-(slices + self.width_us) // 1000)
        done = ends <= timerValues.getCurrentWatermarkInMs()
        if done.all():
            self.held.clear()
        else:
            self.held.put([_packed(held.filter(pa.array(~done)).to_pandas())])
            self._wake(int(ends[~done].min()))
        order = np.flatnonzero(done)
        order = order[np.argsort(slices[order], kind="stable")]
        for at in whole_slices(slices[order], REDUCE_ROWS):
            cells = reduce_cells(held.take(pa.array(order[at])).to_pandas())
            cells["line_ts"] = pd.to_datetime(self._ends(cells) * 1_000_000)
            cells = cells.drop(columns="slice_us")
            cells.insert(len(KEY), "late", False)
            yield cells

    def close(self) -> None:
        pass


def _whole(codes: np.ndarray) -> np.ndarray:
    return pd.factorize(codes)[0].astype(np.int64)


def conversation_codes(named: pd.DataFrame) -> np.ndarray:
    """A number for each distinct conversation; missing ends are equal to one another."""
    out = np.zeros(len(named), dtype=np.int64)
    for k in KEY:
        code = pd.factorize(named[k], use_na_sentinel=False)[0].astype(np.int64)
        out = _whole(out * (int(code.max(initial=0)) + 1) + code)
    return out


def _named(rows: pd.DataFrame) -> pd.DataFrame:
    """The ends of a conversation; a frame with a missing number may come with doubles."""
    return pd.DataFrame({k: rows[k].astype(object if t == "string" else "Int64") for k, t in _KEY_TYPES.items()})


def squared(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact squares of numbers from 0 to 2^46 as halves: high * 2^32 + low."""
    a, b = values >> 16, values & 0xFFFF
    middle = 2 * a * b
    low = ((middle & 0xFFFF) << 16) + b * b
    return a * a + (middle >> 16) + (low >> 32), low & 0xFFFFFFFF


class _Rows:
    """Columns of a matrix by name."""

    def __init__(self, names: list[str], values: np.ndarray) -> None:
        self.at, self.values = {n: i for i, n in enumerate(names)}, values

    def __getitem__(self, name: str) -> np.ndarray:
        return self.values[:, self.at[name]]

    def __setitem__(self, name: str, column) -> None:
        self.values[:, self.at[name]] = column


_FEW, _MANY = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def as_open(cells: np.ndarray) -> np.ndarray:
    """Cells as rows of open flows that hold nothing else."""
    out = np.zeros((len(cells), len(_OPEN)), dtype=np.int64)
    out[:, : len(_CELL)] = cells
    rows = _Rows(_OPEN, out)
    for n in _HALVES:
        rows[f"{n}_high"], rows[n] = rows[n] >> 32, rows[n] & 0xFFFFFFFF
    rows["active_start_us"] = rows["first_us"]
    return out


def merge_flows(rows: np.ndarray, conversation: np.ndarray, timeout_us: int, idle_us: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``_OPEN``, by conversation and time, merged to one per flow; only the gaps between rows are new.

    Returns the flows, for each the index of its first row, and whether it is the last of its conversation.
    """
    r = _Rows(_OPEN, rows)
    size = len(rows)
    begins = np.ones(size, dtype=bool)
    link = np.zeros(size, dtype=np.int64)
    link[1:] = r["first_us"][1:] - r["last_us"][:-1]
    begins[1:] = (conversation[1:] != conversation[:-1]) | (link[1:] > timeout_us)
    link[begins] = 0
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], size) - 1
    of = np.cumsum(begins) - 1
    out = _Rows(_OPEN, np.zeros((len(at), len(_OPEN)), dtype=np.int64))
    for n in ("first_us", "open_pkt", "open_from_a"):
        out[n] = r[n][at]
    out["last_us"] = r["last_us"][ends]

    def total(name: str) -> None:
        out[name] = np.add.reduceat(r[name], at)

    def extreme(name: str, known: np.ndarray) -> None:
        pick, empty = (np.minimum, _MANY) if "min" in name or "first" in name else (np.maximum, _FEW)
        found = pick.reduceat(np.where(known, r[name], empty), at)
        out[name] = np.where(found == empty, 0, found)

    def links(name: str, where: np.ndarray, values: np.ndarray) -> None:
        """``values`` at the rows ``where`` as further gaps or periods of their flows."""
        if not len(where):
            return
        ids, (high, low) = of[where], squared(values)
        lead = np.flatnonzero(np.diff(ids, prepend=-1))
        to, known = ids[lead], (out[f"{name}_n"] if f"{name}_n" in out.at else out["idle_count"])[ids[lead]] > 0
        for n, column in (("sum", values), ("sq", low), ("sq_high", high)):
            out.values[to, out.at[f"{name}_{n}"]] += np.add.reduceat(column, lead)
        for n, pick in (("min", np.minimum), ("max", np.maximum)):
            new, old = pick.reduceat(values, lead), out[f"{name}_{n}"][to]
            out.values[to, out.at[f"{name}_{n}"]] = np.where(known, pick(old, new), new)
        if f"{name}_n" in out.at:
            out.values[to, out.at[f"{name}_n"]] += np.diff(np.append(lead, len(ids)))

    for e in ENDS:
        here = r[f"n_{e}"] > 0
        for n in ("n", "bytes", "bytes_sq", "header", "data", "psh"):
            total(f"{n}_{e}")
        total(f"bytes_sq_{e}_high")
        for n in ("len_min", "len_max", "header_min", "first_us", "last_us"):
            extreme(f"{n}_{e}", here)
        first = np.minimum.reduceat(np.where(here, np.arange(size), size), at)
        out[f"win_{e}"] = np.where(first < size, r[f"win_{e}"][np.minimum(first, size - 1)], 0)
    for g in ("gap", "gap_a", "gap_b"):
        for n in ("n", "sum", "sq", "sq_high"):
            total(f"{g}_{n}")
        for n in ("min", "max"):
            extreme(f"{g}_{n}", r[f"{g}_n"] > 0)
    inner = np.flatnonzero(~begins)
    links("gap", inner, link[inner])
    for e in ENDS:
        mine = np.flatnonzero(r[f"n_{e}"] > 0)
        next_to = np.flatnonzero(np.diff(of[mine]) == 0) + 1
        links(f"gap_{e}", mine[next_to], r[f"first_us_{e}"][mine[next_to]] - r[f"last_us_{e}"][mine[next_to - 1]])
    for n in _FLAGS:
        total(n)
    total("idle_count")
    for p in ("active", "idle"):
        for n in ("sum", "sq", "sq_high"):
            total(f"{p}_{n}")
        for n in ("min", "max"):
            extreme(f"{p}_{n}", r["idle_count"] > 0)
    idle = link > idle_us
    stretch_at = np.flatnonzero(begins | idle)
    stretch = np.cumsum(begins | idle) - 1
    started = r["active_start_us"][stretch_at]
    wakes = np.flatnonzero(idle)
    links("active", wakes, r["last_us"][wakes - 1] - started[stretch[wakes - 1]])
    links("idle", wakes, link[wakes])
    out["idle_count"] += np.bincount(of[wakes], minlength=len(at))
    out["active_start_us"] = started[stretch[ends]]
    for n in (*_HALVES, "active_sq", "idle_sq"):
        out[f"{n}_high"] += out[n] >> 32
        out[n] &= 0xFFFFFFFF
    last = np.ones(len(at), dtype=bool)
    last[:-1] = conversation[at][1:] != conversation[at][:-1]
    return out.values, at, last


def flow_rows(named: pd.DataFrame, flows: np.ndarray, closed, sweep_ms: np.ndarray) -> pd.DataFrame:
    """Rows of ``_OPEN`` as rows of ``EVENT_SCHEMA``: directions instead of ends."""
    f = _Rows(_OPEN, flows)
    from_a = f["open_from_a"] != 0

    def side(name: str, direction: str) -> np.ndarray:
        ends = ENDS if direction == "fwd" else ENDS[::-1]
        return np.where(from_a, *(f[name.format(e)] for e in ends))

    numbers = {"flow_id": f["open_pkt"], "start_us": f["first_us"], "last_us": f["last_us"], "packets": f["n_a"] + f["n_b"]}
    squares = {f"iat_sq{h}": f[f"gap_sq{h}"] for h in ("", "_high")}
    for d in SIDES:
        numbers |= {f"{d}_{n}": side(f"{n}_{{}}", d) for n in ("n", "bytes", "len_min", "len_max", "header", "header_min", "data", "psh", "win")}
        numbers |= {f"{d}_iat_{n}": side(f"gap_{{}}_{n}", d) for n in _GAPS if n != "sq"}
        squares |= {f"{d}_bytes_sq{h}": side(f"bytes_sq_{{}}{h}", d) for h in ("", "_high")}
        squares |= {f"{d}_iat_sq{h}": side(f"gap_{{}}_sq{h}", d) for h in ("", "_high")}
    numbers |= {f"iat_{n}": f[f"gap_{n}"] for n in _GAPS if n != "sq"}
    numbers |= {n: f[n] for n in (*_FLAGS, "idle_count", *(f"{p}_{n}" for p in ("active", "idle") for n in ("min", "max", "sum")))}
    squares |= {f"{p}_sq{h}": f[f"{p}_sq{h}"] for p in ("active", "idle") for h in ("", "_high")}
    out = {}
    for d, (k, m) in (("src", ("a", "b")), ("dst", ("b", "a"))):
        for what in ("ip", "port"):
            out[f"{d}_{what}"] = named[f"{what}_{k}"].where(from_a, named[f"{what}_{m}"])
    out["protocol"] = named["protocol"]
    out = pd.DataFrame(out).reset_index(drop=True)
    out["numbers"] = list(np.column_stack([numbers[n] for n in _NUMBERS]))
    out["squares"] = list(np.column_stack([squares[f"{n}{h}"] for n in _SQUARES for h in ("_high", "")]))
    out["closed"], out["late"] = closed, False
    out["line_us"] = pd.array([None] * len(out), dtype="Int64")
    out["sweep_ts"] = pd.to_datetime(sweep_ms * 1_000_000)
    return out[_EVENT]


def _late_rows(named: pd.DataFrame, cells: np.ndarray, at: pd.Series) -> pd.DataFrame:
    """Late packets as rows of ``EVENT_SCHEMA``, their ends in the conversation's order."""
    c = _Rows(_CELL, cells)
    known = {"flow_id": c["open_pkt"], "start_us": c["first_us"], "last_us": c["first_us"], "packets": 1}
    numbers = np.zeros((len(cells), len(_NUMBERS)), dtype=np.int64)
    for n, column in known.items():
        numbers[:, _NUMBERS.index(n)] = column
    ends = {"ip_a": "src_ip", "port_a": "src_port", "ip_b": "dst_ip", "port_b": "dst_port"}
    out = named.rename(columns=ends).reset_index(drop=True)
    out["numbers"], out["squares"] = list(numbers), [np.zeros(0, dtype=np.int64)] * len(cells)
    out["closed"], out["late"], out["line_us"], out["sweep_ts"] = False, True, c["last_us"], at.to_numpy()
    return out[_EVENT]


class FlowProcessor(StatefulProcessor):
    """A bucket of conversations: merges their cells into its open flows and emits flows; late packets pass through."""

    def __init__(self, width_us: int, timeout_us: int, idle_us: int, min_packets: int, end_us: int | None) -> None:
        self.width_us, self.timeout_us, self.idle_us, self.min_packets, self.end_us = width_us, timeout_us, idle_us, min_packets, end_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("flows", "named binary, numbers binary")
        self.next = handle.getValueState("next", "timer_ms bigint")

    def _load(self) -> tuple[list[pd.DataFrame], list[np.ndarray]]:
        named, flows = [], []
        for ends, numbers in self.held.get():
            named.append(_named(pa.ipc.open_stream(ends).read_all().to_pandas()))
            flows.append(np.frombuffer(numbers, dtype=np.int64).reshape(-1, len(_OPEN)))
        return named, flows

    def _store(self, named: pd.DataFrame, flows: np.ndarray) -> None:
        parts = []
        for at in range(0, len(flows), HELD_FLOWS):
            batch = pa.RecordBatch.from_pandas(named.iloc[at : at + HELD_FLOWS], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            parts.append((sink.getvalue().to_pybytes(), flows[at : at + HELD_FLOWS].tobytes()))
        self.held.put(parts)

    def _wake(self, at: int) -> None:
        """One timer, not later than the first end of a flow that is held."""
        known = self.next.get()[0] if self.next.exists() else None
        if known is None or at < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(at)
            self.next.update((at,))

    def _sweep_ms(self, flows: np.ndarray) -> np.ndarray:
        """End of the slice in which a flow's timeout lies: no packet of it can come after."""
        last = _Rows(_OPEN, flows)["last_us"] + self.timeout_us
        return -(-(last - last % self.width_us + self.width_us) // 1000)

    def _emitted(self, named: pd.DataFrame, flows: np.ndarray, closed) -> Iterator[pd.DataFrame]:
        f = _Rows(_OPEN, flows)
        enough = f["n_a"] + f["n_b"] >= self.min_packets
        if enough.any():
            yield flow_rows(named[enough], flows[enough], closed[enough], self._sweep_ms(flows[enough]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        named, cells = [], []
        for part in rows:
            ends, late = _named(part), part["late"].to_numpy(bool)
            numbers = np.concatenate([np.zeros(0, dtype=np.int64), *part["cell"]]).reshape(-1, len(_CELL))
            if late.any():
                yield _late_rows(ends[late], numbers[late], part["line_ts"][late])
            if not late.all():
                named.append(ends[~late])
                cells.append(as_open(numbers[~late]))
        if not cells:
            return
        held_named, held = self._load() if self.held.exists() else ([], [])
        opened = sum(map(len, held))
        named, flows = pd.concat([*held_named, *named], ignore_index=True), np.concatenate([*held, *cells])
        conversation, first = conversation_codes(named), _Rows(_OPEN, flows)["first_us"]
        order = np.lexsort((first, np.arange(len(flows)) >= opened, conversation))
        merged, at, last = merge_flows(flows[order], conversation[order], self.timeout_us, self.idle_us)
        named = named.iloc[order[at]].reset_index(drop=True)
        yield from self._emitted(named[~last], merged[~last], np.ones(int((~last).sum()), dtype=bool))
        self._store(named[last], merged[last])
        self._wake(int(self._sweep_ms(merged[last]).min()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.next.clear()
        line = timerValues.getCurrentWatermarkInMs()
        named, flows = self._load()
        named, flows = pd.concat(named, ignore_index=True), np.concatenate(flows)
        sweep = self._sweep_ms(flows)
        due = sweep <= max(line - 1, expiredTimerInfo.getExpiryTimeInMs())
        if due.all():
            self.held.clear()
        else:
            self._store(named[~due], flows[~due])
            self._wake(int(sweep[~due].min()))
        closed = np.ones(int(due.sum()), dtype=bool)
        if line * 1000 >= END_US - 1_000_000_000_000:  # the end marker less any delay
            closed = _Rows(_OPEN, flows[due])["last_us"] + self.timeout_us < self.end_us if self.end_us is not None else ~closed
        yield from self._emitted(named[due], flows[due], closed)

    def close(self) -> None:
        pass


STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def end_of_input(packets: DataFrame, folder: str) -> DataFrame:
    """``packets`` (a stream) united with a folder in which ``mark_end`` leaves the end marker."""
    spark = packets.sparkSession
    marks = spark.readStream.schema(packets.schema).option("pathGlobFilter", "*.parquet").parquet(folder)
    return packets.unionByName(marks)


def mark_end(spark: SparkSession, schema: StructType, folder: str) -> None:
    """Leave the end marker: a packet row of the year 2200, which moves the line past every open flow and is left out itself."""
    end = F.lit(END_US)
    time = {"ts_us": end, "ts": F.timestamp_micros(end)}
    columns = [time.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*columns).write.mode("append").parquet(folder)


def flow_events_stream(
    packets: DataFrame,
    timeout_s: float = FLOW_TIMEOUT_S,
    idle_s: float = IDLE_THRESHOLD_S,
    min_packets: int = MIN_PACKETS,
    watermark: str = "1 second",
    slice_s: float | None = None,
    buckets: int = BUCKETS,
    lanes: int = LANES,
    end_us: int | None = None,
    flow_buckets: int = FLOW_BUCKETS,
) -> DataFrame:
    """Packet stream -> flows and late packets (``late``), append mode, with the event time ``sweep_ts``.

    A hot conversation is held and reduced by ``lanes`` tasks, a slice each in turn. ``end_us``, the time the capture ended, tells for
    flows that the end marker flushed whether they had timed out by then (``closed``).
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    width = slice_width_us(timeout_s, idle_s, slice_s)
    timed = with_micros(packets).withColumn("event_ts", F.timestamp_micros("ts_us")).withWatermark("event_ts", watermark)
    # The marker has moved the line by now. Below, time is a plain number, so that Spark drops nothing as late by itself.
    real = flow_key(timed.filter(F.col("event_ts") < F.timestamp_micros(F.lit(END_US))))
    slice_us = F.col("ts_us") - F.pmod("ts_us", F.lit(width))
    used = real.select(
        F.pmod(F.xxhash64(*KEY), F.lit(buckets)).alias("bucket"),
        F.pmod(slice_us / width, F.lit(lanes)).cast("int").alias("lane"),
        slice_us.alias("slice_us"),
        *[F.col(k).cast(t).alias(k) for k, t in _KEY_TYPES.items()],
        "ts_us",
        F.col("pkt_id").cast("long").alias("pkt_id"),
        F.coalesce("from_a", F.lit(True)).alias("from_a"),
        *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in _PACKET[3:]],
    )
    cells = used.groupBy("bucket", "lane").transformWithStateInPandas(
        SliceReducer(width), outputStructType=CELL_SCHEMA, outputMode="Append", timeMode="EventTime", eventTimeColumnName="line_ts"
    )
    dealt = cells.withColumn("flow_bucket", F.pmod(F.xxhash64(*KEY), F.lit(flow_buckets)))
    return dealt.groupBy("flow_bucket").transformWithStateInPandas(
        FlowProcessor(width, int(timeout_s * 1_000_000), int(idle_s * 1_000_000), min_packets, end_us),
        outputStructType=EVENT_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="sweep_ts",
    )


def flows_of(events: DataFrame) -> DataFrame:
    """The flows among ``flow_events_stream``'s rows, as a flow table."""
    numbers = [(F.when(number_of(_COUNTED[n]) > 0, number_of(n)) if n in _COUNTED else number_of(n)).alias(n) for n in _NUMBERS]
    halves = [[F.get("squares", F.lit(2 * i + h)).cast("decimal(19,0)") for h in (0, 1)] for i in range(len(_SQUARES))]
    squares = [(high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(38,0)").alias(n) for n, (high, low) in zip(_SQUARES, halves, strict=True)]
    flows = events.filter(~F.col("late")).select(*_ENDPOINTS, *numbers, *squares, "closed", "sweep_ts")
    return flows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fwd_win", "bwd_win")})


def number_of(name: str):
    """One of the numbers of ``flow_events_stream``'s rows."""
    return F.get("numbers", F.lit(_NUMBERS.index(name)))


def late_of(events: DataFrame) -> DataFrame:
    """The late packets among ``flow_events_stream``'s rows: conversation, packet, its time and the line it missed."""
    ends = {"ip_a": "src_ip", "port_a": "src_port", "ip_b": "dst_ip", "port_b": "dst_port", "protocol": "protocol"}
    named = [F.col(c).alias(k) for k, c in ends.items()]
    return events.filter("late").select(*named, number_of("flow_id").alias("pkt_id"), number_of("start_us").alias("ts_us"), "line_us")


def flow_table_stream(packets: DataFrame, **settings) -> DataFrame:
    """Packet stream -> flow table with ``closed`` and ``sweep_ts`` (append); settings as in ``flow_events_stream``."""
    return flows_of(flow_events_stream(packets, **settings))


def late_packets_stream(packets: DataFrame, **settings) -> DataFrame:
    """Packet stream -> the packets that came after their slice had been reduced."""
    return late_of(flow_events_stream(packets, **settings))


def flow_features_stream(packets: DataFrame, **settings) -> DataFrame:
    """Packet stream -> identity and 54 features of every flow, emitted when it closes or the input ends."""
    return features_of(flow_table_stream(packets, **settings))
