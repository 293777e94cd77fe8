"""Raw Ethernet frames -> packet rows, with column expressions only.

IPv4 header length and total length are honoured, so options are skipped and trailing padding is not
counted. Frames that cannot be decoded keep a reason instead of packet fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Header sizes and protocol numbers.
ETHERNET_BYTES, IPV4_BYTES, TCP_BYTES, UDP_BYTES = 14, 20, 20, 8
ETHERTYPE_IPV4 = 0x0800
TCP, UDP = 6, 17
# Ethernet + longest IPv4 header + fixed TCP header.
HEADER_BYTES = ETHERNET_BYTES + 60 + TCP_BYTES


def _number(at: str, length: int) -> str:
    """SQL text: unsigned big-endian number of ``length`` bytes at byte offset ``at`` of the hex header."""
    return f"CAST(conv(substring(hex, 2 * ({at}) + 1, {2 * length}), 16, 10) AS INT)"


def _dotted(at: int) -> str:
    return "concat_ws('.', " + ", ".join(f"CAST({_number(str(at + i), 1)} AS STRING)" for i in range(4)) + ")"


def _once(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    # A one-row generator: later filters are not rewritten in terms of the expressions below it.
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def inspect_frames(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Packet fields plus ``reject`` (null for a decoded packet)."""
    keep = [c for c in frames.columns if c != frame]
    e = ETHERNET_BYTES
    heads = frames.select(
        *keep,
        F.length(frame).alias("size"),
        F.hex(F.substring(frame, 1, HEADER_BYTES)).alias("hex"),
    )
    ip = _once(heads, keep, ["size", "hex"]).selectExpr(
        *keep, "size", "hex",
        f"if(size >= {e}, {_number('12', 2)}, NULL) AS ethertype",
        f"if(size >= {e + IPV4_BYTES}, ({_number(str(e), 1)} & 15) * 4, NULL) AS ip_header",
        f"if(size >= {e + IPV4_BYTES}, {_number(str(e + 2), 2)}, NULL) AS ip_total",
        f"if(size >= {e + IPV4_BYTES}, {_number(str(e + 9), 1)}, NULL) AS protocol",
    )
    placed = ip.selectExpr(
        *keep, "size", "hex", "ethertype", "protocol",
        f"{e} + greatest(ip_header, {IPV4_BYTES}) AS at",
        f"greatest(least(greatest(ip_total - ip_header, 0), size - {e} - greatest(ip_header, {IPV4_BYTES})), 0) AS carried",
    )
    reason = (
        f"CASE WHEN size < {e} THEN 'short ethernet' WHEN ethertype <> {ETHERTYPE_IPV4} THEN 'not ipv4' "
        f"WHEN size < {e + IPV4_BYTES} THEN 'short ipv4' WHEN protocol NOT IN ({TCP}, {UDP}) THEN 'not tcp or udp' "
        f"WHEN protocol = {TCP} AND carried < {TCP_BYTES} THEN 'short tcp' "
        f"WHEN protocol = {UDP} AND carried < {UDP_BYTES} THEN 'short udp' END AS reject"
    )
    columns = ["size", "hex", "ethertype", "protocol", "at", "carried"]
    judged = _once(placed, keep, columns).selectExpr("*", reason)
    tcp = f"protocol = {TCP}"
    offset = f"shiftright({_number('at + 12', 1)}, 4) * 4"
    fields = {
        "src_ip": _dotted(e + 12),
        "dst_ip": _dotted(e + 16),
        "src_port": _number("at", 2),
        "dst_port": _number("at + 2", 2),
        "protocol": "protocol",
        "payload_len": f"if({tcp}, greatest(carried - {offset}, 0), greatest({_number('at + 4', 2)} - {UDP_BYTES}, 0))",
        "header_len": f"if({tcp}, {offset}, {UDP_BYTES})",
        "tcp_flags": f"if({tcp}, {_number('at + 13', 1)}, 0)",
        "window_size": f"if({tcp}, {_number('at + 14', 2)}, 0)",
    }
    return judged.selectExpr(*keep, *[f"if(reject IS NULL, {text}, NULL) AS {name}" for name, text in fields.items()], "reject")


def decode_frames(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Packets of the decodable frames."""
    return inspect_frames(frames, frame).filter("reject IS NULL").drop("reject")


def rejected_frames(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Frames that gave no packet, counted by reason."""
    return inspect_frames(frames, frame).filter("reject IS NOT NULL").groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


def bytes_of(value: Column, length: int) -> Column:
    """Hex text of an unsigned number in ``length`` bytes (for building frames)."""
    return F.lpad(F.hex(value.cast("long")), 2 * length, "0")
