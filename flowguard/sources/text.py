"""Collected listings and dumps -> rows.

Line parsers take (..., line); document parsers take (..., text) with one whole output per row. Other
columns (host, snapshot time) pass through. A value that does not parse becomes null or the stated default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowguard.functions.net import normalise_state

# Counter names as exported by each platform.
COUNTERS = ["rx_bytes", "tx_bytes", "rx_packets", "tx_packets", "rx_errors", "tx_errors", "rx_drops", "tx_drops"]
COUNTER_FILES = {
    "rx_bytes": "rx_bytes", "tx_bytes": "tx_bytes", "rx_packets": "rx_packets", "tx_packets": "tx_packets",
    "rx_errors": "rx_errors", "tx_errors": "tx_errors", "rx_dropped": "rx_drops", "tx_dropped": "tx_drops",
}
COUNTER_COLUMNS = {
    "rx_packets": 4, "rx_errors": 5, "rx_bytes": 6, "tx_packets": 7, "tx_errors": 8, "tx_bytes": 9,
}
ADAPTER_FIELDS = {
    "rx_bytes": "ReceivedBytes", "tx_bytes": "SentBytes",
    "rx_packets": "ReceivedUnicastPackets", "tx_packets": "SentUnicastPackets",
    "rx_errors": "ReceivedPacketErrors", "tx_errors": "OutboundPacketErrors",
    "rx_drops": "ReceivedDiscards", "tx_drops": "OutboundDiscards",
}
NO_MAC = "00:00:00:00:00:00"
GEO_SCHEMA = "ip string, status string, country string, countryCode string, city string, org string, `as` string"


def _words(line: str = "line") -> Column:
    return F.split(F.trim(F.regexp_replace(F.col(line), r"\s+", " ")), " ")


def _strip(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n"))


def _rest(df: DataFrame, *taken: str) -> list[str]:
    return [c for c in df.columns if c not in taken]


def _unsigned(text: Column, limit: int) -> Column:
    """Digits only, within an unsigned range; anything else is null."""
    n = F.when(text.rlike(r"^\+?[0-9]+$"), F.regexp_replace(text, r"^\+?0*(?=[0-9])", "").try_cast("decimal(20,0)"))
    return F.when(n <= limit, n.cast("long"))


def _pid(text: Column) -> Column:
    return _unsigned(text, 2**32 - 1)


def _found(text: Column | str, pattern: str, group: int = 1) -> Column:
    """First capture or null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


# ---- socket listings ----------------------------------------------------------------------------


def parse_ss(lines: DataFrame) -> DataFrame:
    """``ss -tunap`` lines; raw state kept, ``state_norm`` added."""
    c, user = F.col("_c"), F.get(F.col("_c"), F.lit(6))
    rows = lines.filter(~F.col("line").startswith("Netid")).withColumn("_c", _words()).filter(F.size("_c") >= 6)
    return rows.select(
        *_rest(lines, "line"),
        F.upper(c[0]).alias("protocol"), c[4].alias("local_addr"), c[5].alias("remote_addr"), c[1].alias("state"),
        _pid(_found(user, r"pid=([^,]*)")).alias("pid"),
        _found(user, r'^[^"]*"([^"]*)').alias("process_name"),
        normalise_state(c[1]).alias("state_norm"),
    )


def parse_lsof(lines: DataFrame) -> DataFrame:
    """``lsof -i -n -P`` lines; without an arrow the remote side is ``*:*``."""
    c = F.col("_c")
    name = F.array_join(F.slice(c, F.lit(9), F.size(c)), " ")
    rows = lines.filter(~F.col("line").startswith("COMMAND")).withColumn("_c", _words()).filter(F.size("_c") >= 9)
    rows = rows.withColumn("_name", name)
    addr = F.trim(F.when(F.col("_name").contains("("), F.regexp_extract("_name", r"^(.*)\(", 1)).otherwise(F.col("_name")))
    state = F.when(F.col("_name").contains("("), F.regexp_extract("_name", r"^.*\(([^)]*)\)*$", 1)).otherwise(F.lit(""))
    arrow = addr.contains("->")
    return rows.select(
        *_rest(lines, "line"),
        c[7].alias("protocol"),
        F.when(arrow, F.regexp_extract(addr, r"^(.*?)->", 1)).otherwise(addr).alias("local_addr"),
        F.when(arrow, F.regexp_extract(addr, r"^.*?->(.*)$", 1)).otherwise(F.lit("*:*")).alias("remote_addr"),
        state.alias("state"), _pid(c[1]).alias("pid"), c[0].alias("process_name"), normalise_state(state).alias("state_norm"),
    )


def parse_netstat(lines: DataFrame, processes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``netstat -ano`` lines joined to (pid, process_name); UDP lines have no state."""
    rows = lines.filter(_strip("line").rlike("^(TCP|UDP)")).withColumn("_c", _words())
    c, udp = F.col("_c"), F.col("_c")[0] == "UDP"
    rows = rows.filter(F.size("_c") >= F.when(udp, 4).otherwise(5))
    parsed = rows.select(
        *_rest(lines, "line"),
        c[0].alias("protocol"), c[1].alias("local_addr"), c[2].alias("remote_addr"),
        F.when(udp, F.lit("")).otherwise(c[3]).alias("state"),
        _pid(F.when(udp, c[3]).otherwise(F.get(c, F.lit(4)))).alias("pid"),
    )
    named = processes.select(*(keys or []), "pid", "process_name").dropDuplicates([*(keys or []), "pid"])
    joined = parsed.join(named, [*(keys or []), "pid"], "left")
    return joined.select(*parsed.columns, "process_name", normalise_state(F.col("state")).alias("state_norm"))


def parse_processes(lines: DataFrame) -> DataFrame:
    """``tasklist`` CSV lines -> (pid, process_name)."""
    f = F.split("line", ",")
    quote = r'^"+|"+$'
    rows = lines.filter(F.size(f) >= 2)
    pid = _pid(F.regexp_replace(f[1], quote, ""))
    return rows.select(*_rest(lines, "line"), pid.alias("pid"), F.regexp_replace(f[0], quote, "").alias("process_name")).filter(
        F.col("pid").isNotNull()
    )


# ---- probes -------------------------------------------------------------------------------------


def parse_ping(docs: DataFrame) -> DataFrame:
    """Whole ping output -> ``loss_pct`` (100 when absent) and average ``rtt_ms`` (null when absent)."""
    number = r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"
    lines = F.filter(F.split("text", "\r?\n"), lambda s: s.contains("packet loss") | s.contains("% loss"))
    losses = F.transform(
        lines,
        lambda s: F.coalesce(
            _found(s, rf"(?:^|\s){number}%(?:\s|$)").cast("double"),
            _found(s, rf"(?:^|,)\s*(?:[^,%]*\s)?{number}%[^,]*loss").cast("double"),
        ),
    )
    loss = F.get(F.filter(losses, lambda v: v.isNotNull()), F.lit(0))
    unix = r"(?m)^.*min/avg/max[^=\n]*=[^/=\n]*/([^/=\r\n]*)"
    windows = r"(?m)Average =\s*([^\r\n]*?)(?:ms)*\s*$"
    rtt = F.when(F.col("text").rlike(unix), _strip(F.regexp_extract("text", unix, 1))).when(
        F.col("text").rlike(windows), F.regexp_extract("text", windows, 1)
    )
    return docs.select(
        *_rest(docs, "text"), rtt.try_cast("double").alias("rtt_ms"), F.coalesce(loss, F.lit(100.0)).alias("loss_pct")
    )


# ---- interface counters -------------------------------------------------------------------------


def _count(text: Column) -> Column:
    return F.coalesce(_unsigned(_strip(text), 2**63 - 1), F.lit(0))


def parse_counter_files(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, text) of per-counter files -> one row per interface; unreadable counters are 0."""
    at = r"/([^/]+)/statistics/([^/]+)$"
    named = files.select(
        *keys, F.regexp_extract("path", at, 1).alias("iface"), F.regexp_extract("path", at, 2).alias("file"), _count(F.col("text")).alias("v")
    ).filter("iface <> ''")
    # dealt before it is grouped: a task that reads many files holds no table of all their interfaces
    dealt = named.repartition(*keys, "iface").groupBy(*keys, "iface")
    firsts = {c: F.first(F.when(F.col("file") == f, F.col("v")), ignorenulls=True) for f, c in COUNTER_FILES.items()}
    return dealt.agg(*[F.coalesce(v, F.lit(0)).alias(c) for c, v in firsts.items()])


def read_counter_files(spark: SparkSession, path: str) -> DataFrame:
    """Per-counter files as (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def parse_counter_table(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``netstat -ib`` lines (with ``line_no``): at least 11 columns, first row per interface, no drop counters."""
    rows = lines.filter("line_no > 0").withColumn("_c", _words()).filter(F.size("_c") >= 11)
    first = F.row_number().over(Window.partitionBy(*keys, F.col("_c")[0]).orderBy("line_no"))
    rows = rows.withColumn("_r", first).filter("_r = 1")
    counts = {c: _count(F.col("_c")[i]) for c, i in COUNTER_COLUMNS.items()}
    return rows.select(*keys, F.col("_c")[0].alias("iface"), *[counts.get(c, F.lit(0).cast("long")).alias(c) for c in COUNTERS])


def parse_counter_json(docs: DataFrame) -> DataFrame:
    """Adapter statistics as a JSON object or array; unnamed adapters dropped, missing counters 0."""
    fields = ", ".join(f"`{f}` string" for f in ADAPTER_FIELDS.values())
    body = _strip("text")
    as_array = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    adapters = docs.select(*_rest(docs, "text"), F.explode(F.from_json(as_array, f"array<struct<Name string, {fields}>>")).alias("a"))
    return adapters.filter(F.coalesce(F.col("a.Name"), F.lit("")) != "").select(
        *_rest(docs, "text"), F.col("a.Name").alias("iface"), *[_count(F.col(f"a.{f}")).alias(c) for c, f in ADAPTER_FIELDS.items()]
    )


def parse_counter_totals(docs: DataFrame) -> DataFrame:
    """``netstat -e`` output -> one row for the pseudo interface ``aggregate``."""
    labels = {"bytes": "Bytes", "packets": r"Unicast\s+\S+", "errors": "Errors", "drops": "Discards"}
    sides = {"rx": 1, "tx": 2}
    out = [
        F.coalesce(_count(_found("text", rf"(?m)^\s*{label}\s+(\S+)\s+(\S+)", group)), F.lit(0)).alias(f"{side}_{name}")
        for name, label in labels.items()
        for side, group in sides.items()
    ]
    return docs.select(*_rest(docs, "text"), F.lit("aggregate").alias("iface"), *out).select(*_rest(docs, "text"), "iface", *COUNTERS)


# ---- interface and network configuration --------------------------------------------------------


def parse_ip_addr(docs: DataFrame) -> DataFrame:
    """(…, iface, text of the address listing, operstate, mtu, address) -> interface dimension.

    The last IPv4 and the first IPv6 line win; an all-zero hardware address is no address.
    """
    v4 = F.regexp_extract_all("text", F.lit(r"(?m)^\s*inet ([^\s/]+)"), 1)
    v6 = F.regexp_extract_all("text", F.lit(r"(?m)^\s*inet6 ([^\s/]+)"), 1)
    mac = _strip("address")
    return docs.select(
        *_rest(docs, "text", "operstate", "mtu", "address"),
        F.try_element_at(v4, F.lit(-1)).alias("ipv4"),
        F.get(v6, F.lit(0)).alias("ipv6"),
        F.when(mac != NO_MAC, mac).alias("mac"),
        _unsigned(_strip("mtu"), 2**32 - 1).alias("mtu"),
        (F.coalesce(_strip("operstate"), F.lit("")) == "up").alias("is_up"),
    )


def parse_ifconfig(docs: DataFrame) -> DataFrame:
    """``ifconfig`` output: a block per unindented line with a colon."""
    blocks = docs.select(*_rest(docs, "text"), F.explode(F.split("text", r"\r?\n(?=[^ \t\r\n][^\n]*:)")).alias("b"))
    head = F.regexp_extract("b", r"^([^\n]*)", 1)
    v4 = F.regexp_extract_all("b", F.lit(r"(?m)^\s+inet (\S+)"), 1)
    v6 = F.regexp_extract_all("b", F.lit(r"(?m)^\s+inet6 ([^\s%]+)"), 1)
    mac = F.regexp_extract_all("b", F.lit(r"(?m)^\s+ether (\S+)"), 1)
    return blocks.filter(head.rlike(r"^[^ \t].*:")).select(
        *_rest(docs, "text"),
        F.regexp_extract(head, r"^([^:]*)", 1).alias("iface"),
        F.try_element_at(v4, F.lit(-1)).alias("ipv4"),
        F.get(v6, F.lit(0)).alias("ipv6"),
        F.try_element_at(mac, F.lit(-1)).alias("mac"),
        _unsigned(_found(head, r"(?:^|\s)mtu (\S+)"), 2**32 - 1).alias("mtu"),
        head.contains("UP").alias("is_up"),
    )


def parse_ipconfig(docs: DataFrame, mtus: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """``ipconfig /all`` output: a block per unindented line ending in a colon; optional (iface, mtu) table."""
    body = F.regexp_replace("text", "\r", "")
    blocks = docs.select(*_rest(docs, "text"), F.explode(F.split(body, r"\n(?=[^ \t\n][^\n]*:(?:\n|$))")).alias("b"))
    head = F.regexp_extract("b", r"^([^\n]*)", 1)
    name = F.trim(F.regexp_replace(F.when(head.contains("adapter "), F.regexp_extract(head, r"adapter (.*)$", 1)).otherwise(head), ":+$", ""))
    v4 = _found("b", r"(?m)^.*(?:IPv4 Address|IP Address)[^:\n]*:[ \t]*([^\s(]+)")
    v6 = _found("b", r"(?m)^.*(?:IPv6 Address|Link-local IPv6)[^:\n]*:[ \t]*([^\s%(]+)")
    mac = F.translate(_found("b", r"(?m)^.*Physical Address[^:\n]*:[ \t]*(\S+)"), "-", ":")
    out = blocks.filter(head.rlike(r"^[^ \t].*:$")).select(
        *_rest(docs, "text"), name.alias("iface"), v4.alias("ipv4"), v6.alias("ipv6"), mac.alias("mac"),
        (~F.col("b").contains("Media disconnected")).alias("is_up"),
    )
    if mtus is None:
        out = out.withColumn("mtu", F.lit(None).cast("long"))
    else:
        out = out.join(mtus.select(*(keys or []), "iface", "mtu"), [*(keys or []), "iface"], "left")
    return out.select(*_rest(docs, "text"), "iface", "ipv4", "ipv6", "mac", "mtu", "is_up")


def parse_mtu_table(lines: DataFrame) -> DataFrame:
    """Sub-interface listing -> (iface, mtu): number first, name from the fifth column on."""
    rows = lines.withColumn("_c", _words()).withColumn("mtu", _unsigned(F.col("_c")[0], 2**32 - 1))
    rows = rows.filter((F.size("_c") >= 5) & F.col("mtu").isNotNull())
    return rows.select(*_rest(lines, "line"), F.array_join(F.slice("_c", F.lit(5), F.size("_c")), " ").alias("iface"), "mtu")


def parse_net_config(docs: DataFrame) -> DataFrame:
    """(…, routes text, resolver text) -> ``gateway`` and ``dns_servers``.

    Routes: ``default via G``, ``default G`` or ``0.0.0.0 0.0.0.0 G``. Resolver: ``nameserver A`` lines; without
    one, ``nameserver[i] : A`` or ``DNS Servers : A`` with indented continuation lines (duplicates dropped).
    """
    gateway = F.coalesce(
        _found("routes", r"(?m)^default via (\S+)"),
        _found("routes", r"(?m)^\s*default\s+(?!via\b)(\S+)"),
        _found("routes", r"(?m)^\s*0\.0\.0\.0\s+0\.0\.0\.0\s+(\S+)"),
    )
    plain = F.regexp_extract_all("resolver", F.lit(r"(?m)^\s*nameserver\s+(\S+)"), 1)
    indexed = F.regexp_extract_all("resolver", F.lit(r"(?m)^\s*nameserver\[[^\]]*\][^:\n]*:[ \t]*([^\s:]+)"), 1)
    listed = F.regexp_extract_all("resolver", F.lit(r"(?m)^\s*DNS Servers[^:\n]*:[ \t]*(\S+(?:\s*\n\s+[0-9][0-9.]*(?=\s*(?:\n|$)))*)"), 1)
    several = F.filter(F.flatten(F.transform(listed, lambda s: F.split(s, r"\s+"))), lambda s: s != "")
    dns = F.when(F.size(plain) > 0, plain).when(F.size(indexed) > 0, F.array_distinct(indexed)).otherwise(F.array_distinct(several))
    return docs.select(*_rest(docs, "routes", "resolver"), gateway.alias("gateway"), dns.alias("dns_servers"))


# ---- geo ----------------------------------------------------------------------------------------


def valid_geo(raw: DataFrame) -> DataFrame:
    """Successful lookups with a country; city null -> blank, org falls back to ``as``, then blank."""
    return raw.filter((F.col("status") == "success") & F.col("countryCode").isNotNull()).select(
        "ip",
        F.col("countryCode").alias("country_code"),
        F.coalesce("city", F.lit("")).alias("city"),
        F.coalesce("org", "as", F.lit("")).alias("org"),
    )


def read_geo(spark: SparkSession, path: str) -> DataFrame:
    """Stored lookup records, one JSON object per line with the queried ``ip``."""
    return valid_geo(spark.read.schema(GEO_SCHEMA).json(path))
