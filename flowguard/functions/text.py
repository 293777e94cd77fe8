"""Fixed-point and human-readable number formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowguard.functions.stats import col


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it several times in an expression."""
    return F.transform(F.array(value), use)[0]


def to_fixed(value: Column | str, digits: int) -> Column:
    """``%.{digits}f`` of the exact binary value, ties to even (JVM formatting rounds the shortest decimal half up)."""
    unit = 10**digits
    twice = 2.0 * unit

    def rounded(v: Column) -> Column:
        # v * twice = product + error exactly (split product), so a tie can be told from a near tie.
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return _bind(F.struct((v * twice).alias("p"), high.alias("h"), v.alias("v")), half_even)

    def half_even(s: Column) -> Column:
        p, h, v = s["p"], s["h"], s["v"]
        down = F.floor(p / 2)
        rest = p - down.cast("double") * 2
        error = (h * twice - p) + (v - h) * twice
        up = F.when(rest == 1, (error > 0) | ((error == 0) & (down % 2 == 1))).otherwise(rest > 1)
        return down + up.cast("long")

    def shown(n: Column) -> Column:
        if not digits:
            return n.cast("string")
        whole = (n - F.pmod(n, F.lit(unit))) / unit
        return F.concat(whole.cast("long").cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(unit)).cast("string"), digits, "0"))

    v = col(value).cast("double")
    text = _bind(_bind(F.abs(v), rounded), shown)
    return F.when(v < 0, F.concat(F.lit("-"), text)).otherwise(text)


# Decimal unit steps and suffixes.
UNITS = [(1_000_000_000, "GB"), (1_000_000, "MB"), (1_000, "KB")]


def _scaled(v: Column) -> tuple[Column, Column]:
    """Value in its largest fitting unit, and that unit; both null below the first step."""
    value = unit = None
    for step, name in UNITS:
        at = v >= step
        scaled = v.cast("double") / float(step)
        value = F.when(at, scaled) if value is None else value.when(at, scaled)
        unit = F.when(at, F.lit(name)) if unit is None else unit.when(at, F.lit(name))
    return value, unit


def format_bytes(total: Column | str) -> Column:
    """Byte total with one decimal above 1000: ``1.5 MB``, ``999 B``."""
    v = col(total)
    value, unit = _scaled(v)
    return F.coalesce(F.concat(to_fixed(value, 1), F.lit(" "), unit), F.concat(v.cast("string"), F.lit(" B")))


def format_rate(rate: Column | str) -> Column:
    """Byte rate; below 1000 two blanks precede the unit: ``12  B/s``."""
    v = col(rate).cast("double")
    value, unit = _scaled(v)
    return F.coalesce(F.concat(to_fixed(value, 1), F.lit(" "), unit, F.lit("/s")), F.concat(to_fixed(v, 0), F.lit("  B/s")))
