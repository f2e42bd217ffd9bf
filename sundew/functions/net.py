"""Addresses: IPv4 as a long, IPv6 as 32 hex digits, networks of both as leading hex digits with a length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
CIDR4 = rf"^{_OCTET}(\.{_OCTET}){{3}}/(3[0-2]|[12]?[0-9])$"


def is_ipv4(ip: Column) -> Column:
    """Four decimal octets without leading zeros; null is false."""
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def ipv4_long(ip: Column) -> Column:
    """The address as a number; null if it isn't one."""
    octet = lambda i: F.element_at(F.split(ip, r"\."), i).cast("long")
    return F.when(is_ipv4(ip), octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4))


def ipv4_text(number: Column) -> Column:
    part = lambda n: F.shiftright(number, n).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


@F.pandas_udf(StringType())
def _ipv6_hex(values: pd.Series) -> pd.Series:
    import ipaddress

    def one(x):
        try:
            return f"{int(ipaddress.IPv6Address(x)):032x}"
        except ValueError:
            return None

    return values.map(one, na_action="ignore")


def ipv6_hex(ip: Column) -> Column:
    """32 hex digits; null if it isn't an IPv6 address. Only rows with a colon are parsed."""
    return _ipv6_hex(F.when(ip.contains(":"), ip))


@F.pandas_udf(StructType([StructField("base", StringType()), StructField("len", IntegerType())]))
def _ipv6_network(values: pd.Series) -> pd.DataFrame:
    import ipaddress

    def one(x):
        try:
            net = ipaddress.IPv6Network(x, strict=False)
            return f"{int(net.network_address):032x}", net.prefixlen
        except (ValueError, TypeError):
            return None, None

    return pd.DataFrame([one(x) for x in values], columns=["base", "len"]).astype({"len": "Int32"})


def address_hex(ip: Column) -> Column:
    """8 hex digits of an IPv4 address, 32 of an IPv6 address; null for anything else. Only rows with a colon are parsed in Python."""
    return F.coalesce(F.lower(F.lpad(F.hex(ipv4_long(ip)), 8, "0")), ipv6_hex(ip))


def network_of(text: Column) -> Column:
    """Struct ``base`` (hex digits as in ``address_hex``, bits behind the prefix cleared) and ``len`` of an address or network of either kind; null for anything else."""
    four = prefix_length(text)
    own = F.struct(F.lower(F.lpad(F.hex(keep_prefix(ipv4_long(F.substring_index(text, "/", 1)), four)), 8, "0")).alias("base"), four.alias("len"))
    six = _ipv6_network(F.when(text.contains(":"), text))
    return F.when(four.isNotNull(), own).when(six["base"].isNotNull(), six)


def hex_prefix(digits: Column, length: Column) -> Column:
    """``digits`` with all bits behind ``length`` cleared: whole digits, and the high bits of one more."""
    whole = F.floor(length / 4).cast("int")
    unit = F.pow(F.lit(2.0), F.lit(4) - length % 4).cast("int")
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    part = F.when(length % 4 == 0, F.lit("")).otherwise(F.lower(F.conv((digit - digit % unit).cast("string"), 10, 16)))
    return F.rpad(F.concat(F.substring(digits, F.lit(1), whole), part), F.length(digits), F.lit("0"))


def hex_last(digits: Column, length: Column) -> Column:
    """``digits`` with all bits behind ``length`` set, the last address of a network."""
    whole = F.floor(length / 4).cast("int")
    unit = F.pow(F.lit(2.0), F.lit(4) - length % 4).cast("int")
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    part = F.when(length % 4 == 0, F.lit("")).otherwise(F.lower(F.conv((digit - digit % unit + unit - 1).cast("string"), 10, 16)))
    return F.rpad(F.concat(F.substring(digits, F.lit(1), whole), part), F.length(digits), F.lit("f"))


def is_ip(ip: Column, v6: bool = False) -> Column:
    """An address; with ``v6`` also IPv6, at the price of an Arrow pass."""
    return is_ipv4(ip) | ipv6_hex(ip).isNotNull() if v6 else is_ipv4(ip)


def is_ip_or_cidr(text: Column, v6: bool = False) -> Column:
    """An address or network; with ``v6`` also of IPv6."""
    four = F.coalesce(is_ipv4(text) | text.rlike(CIDR4), F.lit(False))
    return four | _ipv6_network(F.when(text.contains(":"), text))["base"].isNotNull() if v6 else four


def prefix_length(text: Column) -> Column:
    """Of an IPv4 network, 32 for an address; null if it is neither."""
    return F.when(is_ipv4(text), 32).when(text.rlike(CIDR4), F.substring_index(text, "/", -1).cast("int"))


def keep_prefix(number: Column, length: Column) -> Column:
    """The number with all bits behind the prefix cleared."""
    low = F.pow(F.lit(2.0), F.lit(32) - length).cast("long")
    return number - F.pmod(number, low)


def network_text(text: Column) -> Column:
    """Non-strict normal form ``a.b.c.d/len`` of an IPv4 address or network."""
    length = prefix_length(text)
    return F.concat(ipv4_text(keep_prefix(ipv4_long(F.substring_index(text, "/", 1)), length)), F.lit("/"), length.cast("string"))


def is_internal(ip: Column) -> Column:
    """10/8, 172.16/12, 192.168/16 and 127/8; anything malformed is not."""
    inside = ip.startswith("10.") | ip.startswith("127.") | ip.startswith("192.168.") | ip.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\.")
    return F.coalesce(is_ipv4(ip) & inside, F.lit(False))


def is_private(ip: Column, v6: bool = False) -> Column:
    """The internal networks and 169.254/16; with ``v6`` also ::1 and fc00::/7."""
    four = is_internal(ip) | F.coalesce(is_ipv4(ip) & ip.startswith("169.254."), F.lit(False))
    if not v6:
        return four
    digits = ipv6_hex(ip)
    return four | F.coalesce((digits == "0" * 31 + "1") | F.substring(digits, 1, 2).isin("fc", "fd"), F.lit(False))


def slash24(ip: Column) -> Column:
    """The first three of four dotted parts, whatever they hold; null for other shapes."""
    return F.when(F.size(F.split(ip, r"\.")) == 4, F.substring_index(ip, ".", 3))


def slash28(ip: Column) -> Column:
    return keep_prefix(ipv4_long(ip), F.lit(28))
