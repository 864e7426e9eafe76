"""Ethernet frames as binary columns: decoding headers and building frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ethertypes, protocol numbers and the peer addresses of generated frames.
IPV4, IPV6, ARP = 0x0800, 0x86DD, 0x0806
PROTOCOLS = {6: "tcp", 17: "udp"}
PEER, OTHER_PEER = "02:00:00:00:00:01", "02:00:00:00:00:02"
MAC = r"^[0-9a-f]{2}(:[0-9a-f]{2}){5}$"


def uint(b: Column, at: int, size: int) -> Column:
    """Big-endian unsigned integer at a zero-based position."""
    return F.conv(F.hex(F.substring(b, at + 1, size)), 16, 10).cast("bigint")


def mac_text(b: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(b)), "(..)(?!$)", "$1:")


def normalized_mac(text: Column) -> Column:
    """The address in lower case; an error unless it is a nonzero unicast one."""
    mac = F.lower(text)
    unicast = (F.conv(F.substring(mac, 1, 2), 16, 10).cast("int").bitwiseAND(1) == 0) & (mac != "00:00:00:00:00:00")
    return F.when(mac.rlike(MAC) & unicast, mac).otherwise(F.raise_error(F.concat(F.lit("not a nonzero unicast MAC: "), text)).cast("string"))


def peer_mac(target: Column) -> Column:
    return F.when(F.lower(target) == PEER, OTHER_PEER).otherwise(PEER)


def direction(frame: Column, target: Column) -> Column:
    """0 if the target sent the frame, else 1."""
    return F.when(F.substring(frame, 7, 6) == F.unhex(F.regexp_replace(F.lower(target), ":", "")), 0).otherwise(1).cast("tinyint")


def build_frame(direction_: Column, length: Column, target: Column) -> Column:
    t, p = (F.unhex(F.regexp_replace(m, ":", "")) for m in (F.lower(target), peer_mac(target)))
    addresses = F.when(direction_ == 0, F.concat(p, t)).otherwise(F.concat(t, p))
    return F.concat(addresses, F.unhex(F.lit("0800")), F.unhex(F.repeat(F.lit("00"), (length - 14).cast("int"))))


def _ipv4(b: Column, at: int) -> Column:
    return F.concat_ws(".", *(uint(b, at + i, 1).cast("string") for i in range(4)))


def ipv6_text(b: Column) -> Column:
    """Text of 16 bytes: hexadecimal groups without leading zeros, the first of the longest runs of two or more zero groups as ``::``."""
    digits = F.lower(F.hex(b))

    def short(whole: Column) -> Column:
        text = whole
        for zeros in range(2, 9):  # the last that applies is the longest run
            run = f"^((?:[0-9a-f]+:)*?)0(?::0){{{zeros - 1}}}(?::|$)(.*)$"
            text = F.when(whole.rlike(run), F.regexp_replace(whole, run, "$1:$2")).otherwise(text)
        return text

    def named(value: Column, name) -> Column:  # of one element, so that value is computed once
        return F.transform(F.array(value), name)[0]

    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(digits, 4 * i + 1, F.lit(4)), "^0{1,3}", ""))
    text = named(named(F.array_join(groups, ":"), short), lambda t: F.when(t.startswith(":"), F.concat(F.lit(":"), t)).otherwise(t))
    return F.when(F.octet_length(b) == 16, text)


def _protocol(number: Column) -> Column:
    found = F.lit("other")
    for n, name in PROTOCOLS.items():
        found = F.when(number == n, name).otherwise(found)
    return found


def network(frame: Column) -> Column:
    """Struct of source, destination and protocol; malformed or other packets are ``other`` without addresses."""
    kind, size = uint(frame, 12, 2), F.octet_length(frame) - 14
    header = uint(frame, 14, 1).bitwiseAND(15) * 4
    total = uint(frame, 16, 2)
    is4 = (kind == IPV4) & (size >= 20) & (F.shiftright(uint(frame, 14, 1), 4) == 4) & (header >= 20) & (size >= header) & (total >= header) & (total <= size)
    is6 = (kind == IPV6) & (size >= 40) & (F.shiftright(uint(frame, 14, 1), 4) == 6) & (uint(frame, 18, 2) <= size - 40)
    arp = (kind == ARP) & (size >= 28) & (uint(frame, 14, 2) == 1) & (uint(frame, 16, 2) == IPV4) & (uint(frame, 18, 1) == 6) & (uint(frame, 19, 1) == 4)
    v6 = lambda at: ipv6_text(F.when(is6, F.substring(frame, at, 16)))
    source = F.when(is4, _ipv4(frame, 26)).when(is6, v6(23)).when(arp, _ipv4(frame, 28))
    destination = F.when(is4, _ipv4(frame, 30)).when(is6, v6(39)).when(arp, _ipv4(frame, 38))
    protocol = F.when(is4, _protocol(uint(frame, 23, 1))).when(is6, _protocol(uint(frame, 20, 1))).otherwise("other")
    return F.struct(source.alias("source"), destination.alias("destination"), protocol.alias("protocol"))
