"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsentry.dims import ENCRYPTED_PROTOCOLS

MICROS = 1_000_000

# Bit and name of the TCP flags, in the order they are printed.
FLAG_BITS = [(2, "SYN"), (16, "ACK"), (4, "RST"), (1, "FIN"), (8, "PSH"), (32, "URG")]


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def int_div(value, divisor) -> Column:
    """Integer division (BIGINT)."""
    divisor = divisor if isinstance(divisor, Column) else F.lit(divisor)
    return F.call_function("div", _col(value), divisor)


def time_bucket(ts_us, seconds: int) -> Column:
    """Start of the bucket of ``seconds`` a time lies in, as epoch seconds (BIGINT)."""
    return int_div(ts_us, F.lit(seconds * MICROS)) * F.lit(seconds)


def timestamp_of(ts_us="ts_us") -> Column:
    return F.timestamp_micros(_col(ts_us))


def round_half_even(value, digits: int = 0) -> Column:
    return F.bround(_col(value), digits)


def truthy_default(value, default) -> Column:
    """The value, or the default where it is NULL or zero."""
    return F.coalesce(F.nullif(_col(value), F.lit(0)), F.lit(default))


def is_truthy_port(port) -> Column:
    """True for ports other than 0 and NULL."""
    return F.coalesce(_col(port) != 0, F.lit(False))


def parse_flags(bits) -> Column:
    """Names of the set TCP flag bits, joined by ``|``; ``NONE`` if none is set."""
    bits = _col(bits)
    names = [F.when(bits.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in FLAG_BITS]
    return F.coalesce(F.nullif(F.concat_ws("|", *names), F.lit("")), F.lit("NONE"))


def is_encrypted(protocol) -> Column:
    return F.coalesce(_col(protocol).isin(ENCRYPTED_PROTOCOLS), F.lit(False))


def alert_title(threat_type) -> Column:
    """``dns_recon`` becomes ``Dns Recon``."""
    return F.initcap(F.replace(_col(threat_type), F.lit("_"), F.lit(" ")))


def alert_key(packet_id, rule) -> Column:
    """Key of the alert a rule raises on a packet; the same on every replay, 128 bits as hex."""
    return F.md5(F.concat_ws("|", _col(packet_id).cast("string"), _col(rule)))


def like_contains(column, text: str, wildcards: bool = True) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` in the text are wildcards unless switched off.

    A backslash is an ordinary character, so it is doubled for Spark, which takes it as an escape.
    """
    if wildcards:
        escaped = text.replace("\\", "\\\\")
        return _col(column).ilike(f"%{escaped}%")
    return F.contains(F.lower(_col(column)), F.lit(text.lower()))
