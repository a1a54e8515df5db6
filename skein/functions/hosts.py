"""Addresses that must not be fetched."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# IPv4 networks that are not public.
BLOCKED_IPV4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
#: IPv6: unspecified, loopback, link-local and unique local addresses.
BLOCKED_IPV6 = r"^(?:::1?|fe[89ab].*|f[cd].*)$"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
IPV4 = rf"^{_V4}$"


def _ipv6() -> str:
    """Every written form of an address: eight groups, or fewer around one gap; the last two may be dotted; a zone may follow."""
    h = "[0-9a-f]{1,4}"
    forms = [rf"(?:{h}:){{7}}{h}", rf"(?:{h}:){{6}}{_V4}"]
    for left in range(8):
        head = rf"{h}(?::{h}){{{left - 1}}}" if left else ""
        for right in range(8 - left):
            forms.append(head + "::" + (rf"{h}(?::{h}){{{right - 1}}}" if right else ""))
        for right in range(6 - left):
            forms.append(head + "::" + rf"(?:{h}:){{{right}}}{_V4}")
    return "^(?:" + "|".join(forms) + ")(?:%[0-9a-z._~-]+)?$"


IPV6 = _ipv6()


def _number(ip: str) -> int:
    return sum(int(x) << 8 * (3 - i) for i, x in enumerate(ip.split(".")))


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as BIGINT; NULL for anything else."""
    parts = F.split(ip, r"\.")
    n = sum(((parts[i].cast("bigint") * (1 << 8 * (3 - i))) for i in range(1, 4)), parts[0].cast("bigint") * (1 << 24))
    return F.when(ip.rlike(IPV4), n)


def _blocked_v4(n: Column) -> Column:
    def hit(x: Column) -> Column:
        out = F.lit(False)
        for base, bits in BLOCKED_IPV4:
            lo = _number(base)
            out = out | x.between(lo, lo + (1 << 32 - bits) - 1)
        return out

    return F.exists(F.array(n), hit)  # n is evaluated once


def is_blocked(ip: Column) -> Column:
    """Whether an address is not public; what is no valid address is blocked, and so is NULL. Mapped dotted IPv4 is unwrapped."""
    low = F.lower(ip)
    inner = F.regexp_extract(low, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    v6 = low.rlike(BLOCKED_IPV6) | F.coalesce(F.when(inner != "", _blocked_v4(ipv4_number(inner))), F.lit(False))
    return F.coalesce(F.when(ip.rlike(IPV4), _blocked_v4(ipv4_number(ip))).when(low.rlike(IPV6), v6), F.lit(True))


def blocked(ip: str | None) -> bool:
    """is_blocked() of one address, for fetchers."""
    low = (ip or "").lower()
    if re.match(IPV4, low):
        n = _number(low)
        return any(_number(base) <= n < _number(base) + (1 << 32 - bits) for base, bits in BLOCKED_IPV4)
    if not re.match(IPV6, low):
        return True
    inner = re.match(r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", low)
    return bool(re.match(BLOCKED_IPV6, low)) or bool(inner and blocked(inner.group(1)))


def public_hosts(hosts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(host, blocked): a host is blocked if any address of it is, or if it has none."""
    per = resolved.groupBy("host").agg(F.bool_or(is_blocked(F.col("address"))).alias("any_blocked"))
    return hosts.select("host").distinct().join(per, "host", "left").select("host", F.coalesce("any_blocked", F.lit(True)).alias("blocked"))
