import ipaddress

from chronomesh.functions.addresses import with_address_flags

HOSTS = [
    "10.0.0.1", "8.8.4.4", "224.0.0.1", "255.255.255.255", "fe80::1", "127.0.0.1", "not-an-ip", "", "1.2.3", "1.2.3.4.5",
    "01.2.3.4", "256.1.1.1", "192.0.0.9", "192.0.0.8", "192.0.0.170", "100.64.0.1", "169.254.3.4", "172.15.0.1", "172.31.255.255",
    "198.19.255.255", "198.20.0.0", "240.0.0.1", "0.0.0.0", "::", "::1", "::2", "::ffff:10.0.0.1", "::ffff:8.8.8.8",
    "::ffff:224.0.0.1", "64:ff9b:1::1", "100::1", "2001::1", "2001:db8::5", "2001:1::1", "2001:4:112::9", "2001:20::1", "2002::1",
    "3fff::1", "fc00::1", "fdff:ffff::", "ff02::1", "2a00:1450:4001:81b::200e", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9",
    "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7", "1:2:3:4::5:6:7:8", "FE80::ABCD", "fe80::1%eth0", "fe80::1%",
    "12345::", "g::1", ":::", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4", "1.2.3.4::", "::1.2.3.400", " 10.0.0.1", "10.0.0.1 ", "%eth0", "10.0.0.1%1",
]


def expected(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return (False,) * 6
    return (ip.is_private, ip == ipaddress.IPv4Address("255.255.255.255"), ip.is_multicast, ip.version == 4, ip.version == 6, True)


def test_flags_agree_with_the_standard_library(spark):
    df = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    got = {r["host"]: tuple(r)[1:] for r in with_address_flags(df).collect()}
    assert {h: got[h] for h in HOSTS} == {h: expected(h) for h in HOSTS}
