"""IP address flags as native column expressions.

An address becomes one comparable value (a number for version 4, 32 hex digits for
version 6), and membership of a network is a range test on it. No Python worker.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Special-purpose networks of the public registries. Addresses in PRIVATE_*
# that are not in GLOBAL_* count as internal.
PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
]
GLOBAL_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
PRIVATE_V6 = [
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32",
    "2002::/16", "fc00::/7", "fe80::/10",
]
GLOBAL_V6 = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
]
# End of fixed values.

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_V4_TAIL = rf"^(.*:){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _inside(value: Column, networks: list[str], bound) -> Column:
    """Whether a value column lies in one of the networks."""
    nets = [ipaddress.ip_network(text) for text in networks]
    ranges = F.array(*[F.struct(F.lit(bound(n[0])).alias("lo"), F.lit(bound(n[-1])).alias("hi")) for n in nets])
    return F.exists(ranges, lambda r: value.between(r["lo"], r["hi"]))


def _octets(text: Column, pattern: str, first: int) -> Column:
    octet = [F.regexp_extract(text, pattern, first + i).cast("bigint") for i in range(4)]
    return ((octet[0] * 256 + octet[1]) * 256 + octet[2]) * 256 + octet[3]


def _hex128(address) -> str:
    return f"{int(address):032x}"


def with_ipv4_value(df: DataFrame, host: str, out: str) -> DataFrame:
    """Add the address as a number, null when ``host`` is no dotted version 4 address."""
    text = F.col(host)
    return df.withColumn(out, F.when(text.rlike(_V4), _octets(text, _V4, 1)))


def with_ipv6_value(df: DataFrame, host: str, out: str) -> DataFrame:
    """Add the address as 32 lower-case hex digits, null when ``host`` is no version 6 address.

    Each step is a column of its own, so that later steps refer to it by name.
    """
    text = F.col(host)
    low = F.col("_low")
    scope_ok = ~text.contains("%") | text.rlike("^[^%]+%[^%]+$")
    df = df.withColumn("_low", F.when(text.contains(":") & scope_ok, F.lower(F.split_part(text, F.lit("%"), F.lit(1)))))
    df = df.withColumn("_tail", F.when(low.rlike(_V4_TAIL), _octets(low, _V4_TAIL, 2)))
    tail = F.col("_tail")
    rewritten = F.concat(
        F.regexp_extract(low, _V4_TAIL, 1),
        F.lower(F.hex(F.shiftright(tail, 16))), F.lit(":"), F.lower(F.hex(tail.bitwiseAND(F.lit(65535)))),
    )
    df = df.withColumn("_plain", F.when(tail.isNotNull(), rewritten).otherwise(low))
    df = df.withColumn("_halves", F.split("_plain", "::"))
    halves = F.col("_halves")

    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    df = df.withColumns({
        "_left": groups(F.get(halves, 0)),
        "_right": F.coalesce(groups(F.get(halves, 1)), F.array().cast("array<string>")),
    })
    missing = F.lit(8) - F.size("_left") - F.size("_right")
    zeros = F.array_repeat(F.lit("0"), missing)
    full = F.when((F.size(halves) == 2) & (missing >= 1), F.concat("_left", zeros, "_right")).when(
        F.size(halves) == 1, F.col("_left")
    )
    df = df.withColumn("_full", full)
    valid = (F.size("_full") == 8) & F.forall("_full", lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    digits = F.array_join(F.transform("_full", lambda g: F.lpad(g, 4, "0")), "")
    return df.withColumn(out, F.when(valid, digits)).drop("_low", "_tail", "_plain", "_halves", "_left", "_right", "_full")


def with_address_flags(df: DataFrame, host: str = "host") -> DataFrame:
    """Add the six flags; a host name or malformed address gets all false."""
    df = with_ipv6_value(with_ipv4_value(df, host, "_v4"), host, "_v6")
    v6 = F.col("_v6")
    mapped = v6.startswith("00000000000000000000ffff")
    # the version 4 address itself, or the one a mapped version 6 address stands for
    df = df.withColumn("_as4", F.coalesce(F.col("_v4"), F.when(mapped, F.conv(F.substring(v6, 25, 8), 16, 10).cast("bigint"))))
    as4 = F.col("_as4")
    internal = F.when(as4.isNotNull(), _inside(as4, PRIVATE_V4, int) & ~_inside(as4, GLOBAL_V4, int)).otherwise(
        _inside(v6, PRIVATE_V6, _hex128) & ~_inside(v6, GLOBAL_V6, _hex128)
    )
    v4 = F.col("_v4")
    multicast = F.when(v4.isNotNull(), _inside(v4, ["224.0.0.0/4"], int)).otherwise(v6.startswith("ff"))
    is_v4, is_v6 = F.col("_v4").isNotNull(), v6.isNotNull()
    flags = {
        "internal": internal, "broadcast": F.col("_v4") == F.lit(4294967295), "multicast": multicast,
        "ipv4": is_v4, "ipv6": is_v6, "valid": is_v4 | is_v6,
    }
    return df.withColumns({n: F.coalesce(f, F.lit(False)) for n, f in flags.items()}).drop("_v4", "_v6", "_as4")
