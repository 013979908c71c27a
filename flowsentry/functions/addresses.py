"""IP address functions, as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_GROUPS_PATTERN = r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"

# The IPv4 blocks that are not globally reachable, by the start of the dotted text.
# Of 192.0.0.0/24 the addresses .9 and .10 are reachable.
PRIVATE_IPV4 = [
    r"0\.",
    r"10\.",
    r"127\.",
    r"169\.254\.",
    r"172\.(1[6-9]|2[0-9]|3[01])\.",
    r"192\.0\.0\.(?!(9|10)$)",
    r"192\.0\.2\.",
    r"192\.168\.",
    r"198\.1[89]\.",
    r"198\.51\.100\.",
    r"203\.0\.113\.",
    r"2(4[0-9]|5[0-5])\.",
]
PRIVATE_IPV4_PATTERN = rf"^({'|'.join(PRIVATE_IPV4)})"

# Prefix (hex digits) and its length in bits.
PRIVATE_IPV6 = [
    ("00000000000000000000000000000000", 128),
    ("00000000000000000000000000000001", 128),
    ("0064ff9b0001", 48),
    ("0100000000000000", 64),
    ("20010000", 23),
    ("20010db8", 32),
    ("2002", 16),
    ("fc00", 7),
    ("fe80", 10),
]
PUBLIC_IPV6 = [
    ("20010001000000000000000000000001", 128),
    ("20010001000000000000000000000002", 128),
    ("20010003", 32),
    ("200100040112", 48),
    ("20010020", 28),
    ("20010030", 28),
]
_MAPPED_PREFIX = "00000000000000000000ffff"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def ipv4_number(ip) -> Column:
    """The address as a BIGINT, NULL unless the text is a valid IPv4 address."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    octets = F.transform(F.split(ip, r"\."), lambda part: part.cast("bigint"))
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda total, octet: total * 256 + octet)
    return F.when(ip.rlike(IPV4_PATTERN), number)


def _private_ipv4(ip: Column) -> Column:
    return ip.rlike(IPV4_PATTERN) & ip.rlike(PRIVATE_IPV4_PATTERN)


def _without_dots(address: Column) -> Column:
    """Dotted IPv4 digits at the end become two hex groups; NULL if they are no address."""
    head = F.regexp_extract(address, r"^(.*:)[0-9.]+$", 1)
    number = ipv4_number(F.regexp_extract(address, r":([0-9.]+)$", 1))
    groups = _let(
        number,
        lambda n: F.when(
            n.isNotNull(),
            F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535)))),
        ),
    )
    return F.when(address.contains("."), F.concat(head, groups)).otherwise(address)


def _expand(halves: Column) -> Column:
    shortened = F.size(halves) == 2
    left, right = F.element_at(halves, 1), F.coalesce(F.get(halves, F.lit(1)), F.lit(""))

    def groups(half: Column) -> Column:
        filled = F.filter(F.split(half, ":"), lambda group: group != "")
        return F.transform(filled, lambda group: F.lpad(group, 4, "0"))

    wellformed = (F.size(halves) <= 2) & left.rlike(_GROUPS_PATTERN) & right.rlike(_GROUPS_PATTERN)

    def fill(parts: Column) -> Column:
        missing = F.lit(8) - F.size(parts["head"]) - F.size(parts["tail"])
        fits = F.when(shortened, missing >= 1).otherwise(missing == 0)
        zeros = F.array_repeat(F.lit("0000"), F.greatest(missing, F.lit(0)))
        return F.when(fits, F.concat_ws("", parts["head"], zeros, parts["tail"]))

    pieces = F.struct(groups(left).alias("head"), groups(right).alias("tail"))
    return F.when(wellformed, _let(pieces, fill))


def ipv6_hex(ip) -> Column:
    """The address as 32 hex digits, NULL unless the text is a valid IPv6 address."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    # A zone id is allowed behind one percent sign.
    address = F.lower(F.regexp_extract(ip, r"^([^%]*)(%[^%]+)?$", 1))
    plain = _let(address, _without_dots)
    return F.when(ip.contains(":"), _let(F.split(plain, "::"), _expand))


def _private_ipv6(digits: Column) -> Column:
    def block(prefix: str, bits: int) -> Column:
        low = int(prefix.ljust(32, "0"), 16)
        high = low | ((1 << (128 - bits)) - 1)
        return digits.between(f"{low:032x}", f"{high:032x}")

    private = _any([block(*entry) for entry in PRIVATE_IPV6])
    public = _any([block(*entry) for entry in PUBLIC_IPV6])
    dotted = F.concat_ws(".", *[F.conv(F.substring(digits, at, 2), 16, 10) for at in (25, 27, 29, 31)])
    return F.when(digits.startswith(_MAPPED_PREFIX), _private_ipv4(dotted)).otherwise(private & ~public)


def is_private(ip) -> Column:
    """True for addresses that are not globally reachable; false for bad input."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    private = F.when(ip.contains(":"), _let(ipv6_hex(ip), _private_ipv6)).otherwise(_private_ipv4(ip))
    return F.coalesce(private, F.lit(False))
