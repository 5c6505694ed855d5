import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from hostlens.functions import ip, text
from hostlens.functions.punycode import ascii_labels
from hostlens.operators.entries import cleaned_host


def values(spark, f, xs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def test_normalize_host(spark):
    assert values(spark, text.normalize_host, [" Www.Example.COM. ", "..", "", None, " a.b\t"]) == ["www.example.com", None, None, None, "a.b"]


def test_short_hostname(spark):
    assert values(spark, text.short_hostname, ["HOST-A.EXAMPLE.COM", "host-a.example.com.", ".", None]) == ["host-a", "host-a", "", ""]
    assert values(spark, text.short_hostnames, [["a.x", "A.y", None, "b."], []], "array<string>") == [["a", "b"], []]


def test_labels(spark):
    assert values(spark, text.reverse_labels, ["www.example.com"]) == ["com.example.www"]
    assert values(spark, text.probes, ["a.b"]) == [["a.b", "*.a.b", "b", "*.b"]]
    assert values(spark, text.naive_domain, ["news.bbc.co.uk", "localhost"]) == ["co.uk", None]
    assert values(spark, text.strip_port, ["a.b:80", "[::1]"]) == ["a.b", "["]
    assert values(spark, text.response_code, [" nxdomain ", "  "]) == ["NXDOMAIN", None]


LINES = [
    ("# c", None), ("! c", None), ("[x]", None), ("@@||a.com^", None), ("0.0.0.0 blocked.example.com", "blocked.example.com"), ("::1  B.example.com # x", "b.example.com"), ("", None), ("bad_label", None),
    ("||ads.example.com^$third-party", "ads.example.com"), ("facebook.com", "facebook.com"), ("*.gov", "*.gov"), ("localhost", None), ("-bad.example.com", None), (".a.com. b.com", "a.com"), ("a..b", None),
    ("fe80::1%lo0 x.example.com", "x.example.com"), ("a." * 2000 + "com", "a." * 2000 + "com"),
]


@pytest.mark.parametrize("at", range(len(LINES)))
def test_cleaned_host(spark, at):
    assert values(spark, cleaned_host, [LINES[at][0]]) == [LINES[at][1]]


def test_addresses(spark):
    got = values(spark, ip.resolved_addresses, [["2606:0:0:0:0:0:0:1", "127.0.0.1", "0.0.0.0", "::", "x", "127.0.0.1", None], [], None], "array<string>")
    assert got == [["2606::1", "127.0.0.1", "0.0.0.0", "::"], [], []]
    got = values(spark, ip.routable_addresses, [["fe80::1", "10.100.45.140", "169.254.1.1"], ["fc00::1", "fc00:0:0:0:0:0:0:1"], ["224.0.0.1", "8.8.8.8"]], "array<string>")
    assert got == [["10.100.45.140"], ["fc00::1"], ["8.8.8.8"]]
    assert values(spark, ip.reverse_name, ["192.0.2.1", "::1", "x"]) == ["1.2.0.192.in-addr.arpa.", "1." + "0." * 31 + "ip6.arpa.", ""]
    assert values(spark, ip.canonical_ip, ["010.0.0.1", None]) == [None, None]


def test_addresses_are_those_of_the_standard_library(spark):
    r = random.Random(3)
    v4 = lambda: ".".join(str(r.choice([0, 1, 10, 127, 169, 172, 192, 168, 198, 224, 240, 255, 256, "01", r.randrange(256)])) for _ in range(r.choice([4] * 9 + [3, 5])))

    def v6():
        parts = [r.choice(["0", "0", "0000", "1", "ff", "FE80", "fc00", "2001", "db8", "ffff", "12345", "g", ""][: r.choice([10, 13])]) for _ in range(r.choice([8, 8, 7, 6, 3, 1, 0, 9]))]
        k = r.randint(0, len(parts))
        text = r.choice([":".join(parts), ":".join(parts[:k]) + "::" + ":".join(parts[k:])])
        return text + r.choice(["", "", "", ":" + v4(), "%eth0", "%", "%a%b"])

    texts = [v6() for _ in range(1500)] + [v4() for _ in range(700)] + ["::", "::1", "::ffff:1.2.3.4", "::ffff:127.0.0.1", " 10.0.0.1\t", "", "::1.2.3.4", "192.0.0.9", "2001:1::1", "1:2:3:4:5:6:7::", "1::2:3:4:5:6:7:8", ":::"]

    def want(t):
        try:
            a = ipaddress.ip_address(t.strip())
        except ValueError:
            return None, None, ""
        kind = next((n for n in ("unspecified", "loopback", "link_local", "multicast", "reserved", "private") if getattr(a, f"is_{n}")), "global")
        return str(a), kind, ipaddress.ip_address(str(a).split("%")[0]).reverse_pointer + "."

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ip.canonical_ip("t"), ip.ip_class("t"), ip.reverse_name("t"))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(x)[1:] for x in df.collect()] == [want(t) for t in texts]


def test_punycode():
    assert ascii_labels("公司.cn") == "xn--55qx5d.cn" and ascii_labels("a.b") is None
