"""Endpoint, address and connection-state expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowguard.functions.stats import col

# Address prefixes never looked up, and single addresses.
PRIVATE_PREFIX = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|fe80:|fc|fd|ff|169\.254\.|224\.|239\.)"
PRIVATE_EXACT = ["0.0.0.0", "::", "::1"]

# Protocol numbers with a name.
PROTOCOL_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP"}

# Connection states by class.
STATE_CLASSES = {
    "established": ["ESTABLISHED"],
    "listen": ["LISTEN"],
    "connecting": ["SYN_SENT", "SYN_RECV", "SYN_RECEIVED"],
    "closing": ["CLOSE_WAIT", "TIME_WAIT", "FIN_WAIT_1", "FIN_WAIT_2", "FIN_WAIT1", "FIN_WAIT2"],
}


def split_endpoint(addr: Column | str) -> Column:
    """struct(ip, port): ``*:*`` and empty -> nulls, ``[v6]:p``, ``*`` -> null, no colon -> ip only."""
    a = col(addr)
    bracket = a.contains("]:")
    colon = a.contains(":")
    after_bracket, after_colon = F.substring_index(a, "]:", -1), F.substring_index(a, ":", -1)
    in_bracket = F.substring(a, F.lit(2), F.length(a) - F.length(after_bracket) - 3)
    before_colon = F.left(a, F.length(a) - F.length(after_colon) - 1)
    ip = F.when(bracket, in_bracket).when(colon, before_colon).otherwise(a)
    port = F.when(bracket, after_bracket).when(colon, after_colon)
    blank = a.isNull() | (a == "*:*") | (a == "")
    star = ~bracket & colon
    return F.struct(
        F.when(~blank & ~(star & (ip == "*")), ip).alias("ip"),
        F.when(~blank & ~(star & (port == "*")), port).alias("port"),
    )


def remote_ip(addr: Column | str) -> Column:
    """Address part usable as a remote host; blanks and ``*`` become null."""
    ip = split_endpoint(addr)["ip"]
    return F.when((ip != "") & (ip != "*"), ip)


def is_private_ip(ip: Column | str) -> Column:
    a = col(ip)
    return a.rlike(PRIVATE_PREFIX) | a.isin(PRIVATE_EXACT)


def protocol_name(protocol: Column | str) -> Column:
    p = col(protocol)
    out = F.lit("???")
    for number, name in PROTOCOL_NAMES.items():
        out = F.when(p == number, F.lit(name)).otherwise(out)
    return out


def normalise_state(state: Column | str) -> Column:
    """Listing-tool spellings (``ESTAB``, ``TIME-WAIT``) to the long underscore form."""
    s = F.upper(F.translate(col(state), "-", "_"))
    return F.when(s == "ESTAB", F.lit("ESTABLISHED")).otherwise(s)


def state_class(state: Column | str, is_active: Column | None = None) -> Column:
    """established / listen / connecting / closing / other; ``closed`` once a connection is inactive."""
    s = normalise_state(state)
    out = None
    if is_active is not None:
        out = F.when(~is_active, F.lit("closed"))
    for name, members in STATE_CLASSES.items():
        hit = s.isin(members)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("other"))


def geo_label(country: Column, city: Column, org: Column) -> Column:
    """``CC City, Org`` or ``CC Org``; blank when unresolved."""
    return F.when(country.isNull(), F.lit("")).otherwise(
        F.when(city == "", F.concat_ws(" ", country, org)).otherwise(F.concat(country, F.lit(" "), city, F.lit(", "), org))
    )
