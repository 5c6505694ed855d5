"""IP addresses as Column expressions: canonical form, class and reverse name.

Spark SQL has no address type. An address is parsed to its digits in base 16, 8 of them
for IPv4 and 32 for IPv6; ranges are ranges of such text.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ws_strip

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
GROUP = "^[0-9A-Fa-f]{1,4}$"

# The registries' ranges, in the order in which a class is asked for.
RANGES_4 = {
    "unspecified": ["0.0.0.0/32"],
    "loopback": ["127.0.0.0/8"],
    "link_local": ["169.254.0.0/16"],
    "multicast": ["224.0.0.0/4"],
    "reserved": ["240.0.0.0/4"],
    "private": [
        "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16",
        "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
    ],
}
PUBLIC_4 = ["192.0.0.9/32", "192.0.0.10/32"]  # within private ones
RANGES_6 = {
    "unspecified": ["::/128"],
    "loopback": ["::1/128", "::ffff:7f00:0/104"],
    "link_local": ["fe80::/10"],
    "multicast": ["ff00::/8"],
    "reserved": ["::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9"],
    "private": ["::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10"],
}
PUBLIC_6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _hex(n: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(n)), width, "0")


def _digits_4(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, "[.]"), lambda o: _hex(o.cast("int"), 2)), "")


def _undotted(b: Column) -> Column:
    """An IPv4 address at the end as two groups; null where what has dots is none."""
    last = F.regexp_extract(b, "([^:]*)$", 1)
    two = _let(_digits_4(last), lambda d: F.concat(F.regexp_replace(b, "[^:]*$", ""), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))
    return F.when(~F.contains(b, F.lit(".")), b).when(last.rlike(V4), two)


def _digits_6(x: Column) -> Column:
    groups = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":"))

    def joined(halves: Column) -> Column:
        left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        given = F.size(left) + F.size(right)
        ok = ((F.size(halves) == 1) & (given == 8)) | ((F.size(halves) == 2) & (given <= 7))
        ok = ok & F.forall(F.concat(left, right), lambda g: g.rlike(GROUP))
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - given, F.lit(0))), right)
        return F.when(ok, F.array_join(F.transform(whole, lambda g: F.lpad(F.lower(g), 4, "0")), ""))

    zone_ok = ~F.contains(x, F.lit("%")) | x.rlike("^[^%]*%[^%]+$")
    return F.when(zone_ok, _let(F.split(_undotted(F.substring_index(x, "%", 1)), "::", -1), joined))


def ip_digits(text: Column) -> Column:
    """The digits of an address, whatever white space is around it; null for what is none."""
    return _let(ws_strip(text), lambda x: F.when(x.rlike(V4), _digits_4(x)).when(F.contains(x, F.lit(":")), _digits_6(x)))


def _dotted(d: Column, at: int = 1) -> Column:
    return F.concat_ws(".", *(F.conv(F.substring(d, at + 2 * k, 2), 16, 10) for k in range(4)))


def is_mapped(digits: Column) -> Column:
    """An IPv4 address within IPv6."""
    return F.startswith(digits, F.lit("0" * 20 + "ffff"))


def _canonical_6(d: Column) -> Column:
    """Groups without zeros in front; of the longest runs of zero groups the first is left out."""
    joined = F.concat_ws(":", *(F.regexp_replace(F.substring(d, 4 * k + 1, 4), "^0{1,3}", "") for k in range(8)))

    def shortened(j: Column) -> Column:
        out = j
        for k in range(2, 9):  # the longest counts: it is asked for first
            out = F.when(j.rlike(rf"(?:^|:)0(?::0){{{k - 1}}}(?:$|:)"), F.regexp_replace(j, rf"^(.*?)(?:^|:)0(?::0){{{k - 1}}}(?:$|:)(.*)$", "$1::$2")).otherwise(out)
        return out

    return F.when(is_mapped(d), F.concat(F.lit("::ffff:"), _dotted(d, 25))).otherwise(_let(joined, shortened))


def canonical_ip(text: Column | str) -> Column:
    """The shortest form in lower case; null for what is no address. A zone stays."""
    text = F.col(text) if isinstance(text, str) else text
    zone = _let(ws_strip(text), lambda x: F.when(F.contains(x, F.lit("%")), F.concat(F.lit("%"), F.substring_index(x, "%", -1))).otherwise(""))
    return _let(ip_digits(text), lambda d: F.when(F.length(d) == 8, _dotted(d)).when(F.length(d) == 32, F.concat(_canonical_6(d), zone)))


def _within(d: Column, networks: list[str]) -> Column:
    hit = F.lit(False)
    for n in map(ipaddress.ip_network, networks):
        width = n.max_prefixlen // 4
        hit = hit | d.between(f"{int(n.network_address):0{width}x}", f"{int(n.broadcast_address):0{width}x}")
    return hit


def _class_of(d: Column, ranges: dict[str, list[str]], public: list[str]) -> Column:
    out = F.when(F.lit(False), "")
    for name, networks in ranges.items():
        hit = _within(d, networks)
        out = out.when(hit & ~_within(d, public) if name == "private" else hit, name)
    return out.otherwise("global")


def ip_class(text: Column | str) -> Column:
    """unspecified, loopback, link_local, multicast, reserved, private or global; null for
    what is no address. Of IPv4 addresses within IPv6 only the loopback ones have their class."""
    text = F.col(text) if isinstance(text, str) else text
    return _let(ip_digits(text), lambda d: F.when(F.length(d) == 8, _class_of(d, RANGES_4, PUBLIC_4)).when(F.length(d) == 32, _class_of(d, RANGES_6, PUBLIC_6)))


def reverse_name(text: Column | str) -> Column:
    """The name that a reverse lookup asks for; '' for what is no address, null too."""
    text = F.col(text) if isinstance(text, str) else text
    four = lambda d: F.concat_ws(".", *(F.conv(F.substring(d, 7 - 2 * k, 2), 16, 10) for k in range(4)), F.lit("in-addr.arpa."))
    six = lambda d: F.concat(F.array_join(F.split(F.reverse(d), ""), "."), F.lit(".ip6.arpa."))
    named = _let(ip_digits(text), lambda d: F.when(F.length(d) == 8, four(d)).when(F.length(d) == 32, six(d)))
    return F.coalesce(named, F.lit(""))


def _distinct(values: Column, form: Callable[[Column], Column]) -> Column:
    """In order, without what the form makes null."""
    return F.coalesce(F.array_distinct(F.array_compact(F.transform(values, form))), F.array().cast("array<string>"))


def resolved_addresses(values: Column) -> Column:
    """Canonical and distinct, in order; loopback and unspecified (sinkholes) stay."""
    return _distinct(values, canonical_ip)


def routable_addresses(values: Column) -> Column:
    """As ``resolved_addresses``, but only global and private ones."""
    return _distinct(values, lambda v: F.when(ip_class(v).isin("global", "private"), canonical_ip(v)))


def has_sinkhole(resolved: Column) -> Column:
    """Canonical addresses with a loopback or unspecified one."""
    return F.exists(resolved, lambda a: a.rlike(r"^127\.|^0\.0\.0\.0$|^::1?$"))
