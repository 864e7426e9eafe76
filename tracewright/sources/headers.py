"""HTTP response headers of ranged transfers, as DataFrame functions: blocks, fields and the checks of a transfer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blocks(files: DataFrame) -> DataFrame:
    """files(transfer_id, content) to (transfer_id, block, status, lines)."""
    text = F.decode("content", "ISO-8859-1")
    raw = F.filter(F.split(text, "\r\n\r\n"), lambda b: b != "")
    rows = files.select("transfer_id", F.posexplode(raw).alias("block", "raw")).withColumn("lines", F.split("raw", "\r\n"))
    status = F.regexp_extract(F.element_at("lines", 1), r"^HTTP/1\.1[ \t]+(\d{3})(?:[ \t].*)?$", 1)
    return rows.select("transfer_id", "block", F.when(status != "", status.cast("int")).alias("status"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("lines"))


def fields(rows: DataFrame) -> DataFrame:
    """(transfer_id, block, name, values): names in lower case, values in their order."""
    line = rows.select("transfer_id", "block", F.posexplode("lines").alias("at", "line"))
    split = line.select("transfer_id", "block", "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("name"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"), (F.instr("line", ":") > 1).alias("ok"))
    return split.where("ok").groupBy("transfer_id", "block", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))


def transfers(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Per transfer: the final status, range and length, and what is wrong, if anything.

    expected(transfer_id, range_start, range_end, object_size). At most three redirects, each with one Location; the
    final response is 206 with exactly the requested Content-Range and Content-Length.
    """
    b = blocks(files)
    f = fields(b).where(F.col("name").isin("location", "content-range", "content-length"))
    one = f.groupBy("transfer_id", "block").pivot("name", ["location", "content-range", "content-length"]).agg(F.first("values"))
    wide = b.join(one, ["transfer_id", "block"], "left").withColumn("last", F.max("block").over(Window.partitionBy("transfer_id")) == F.col("block"))
    single = lambda c: F.when(F.size(F.col(f"`{c}`")) == 1, F.element_at(F.col(f"`{c}`"), 1))
    bad_hop = ~F.col("last") & (~F.coalesce(F.col("status").between(300, 399), F.lit(False)) | single("location").isNull())
    final = wide.groupBy("transfer_id").agg(
        F.count("*").alias("blocks"), F.count_if(bad_hop).alias("bad_redirects"), F.count_if(F.col("status").isNull()).alias("bad_status_lines"),
        *(F.max(F.when(F.col("last"), e)).alias(n) for n, e in (("status", F.col("status")), ("content_range", single("content-range")), ("length_text", single("content-length")))),
    )
    joined = expected.join(final, "transfer_id", "left")
    want = F.concat(F.lit("bytes "), "range_start", F.lit("-"), "range_end", F.lit("/"), "object_size")
    size = F.when(F.col("length_text").rlike("^[0-9]+$"), F.col("length_text").cast("bigint"))
    problem = (
        F.when(F.col("blocks").isNull(), "no response")
        .when(F.col("bad_status_lines") > 0, "status line")
        .when(F.col("blocks") > 4, "redirects")
        .when(F.col("bad_redirects") > 0, "redirect")
        .when(F.col("status") != 206, "status")
        .when(~F.col("content_range").eqNullSafe(want), "range")
        .when(~size.eqNullSafe(F.col("range_end") - F.col("range_start") + 1), "length")
    )
    return joined.select("transfer_id", "status", "content_range", size.alias("content_length"), problem.alias("problem"))


LABEL = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def valid_url(column):
    """Whether a column holds an http or https address with a DNS host: no white space, no IP address, a port up to 65535."""
    place = F.regexp_extract(column, r"^(?i:https?)://([^/?#]*)", 1)
    end = F.regexp_extract(place, "([^@]*)$", 1)  # what follows user information
    host = F.regexp_replace(F.regexp_extract(end, r"^([^:\[\]]*)(:[0-9]*)?$", 1), r"\.$", "")
    port = F.regexp_extract(end, r"^[^:\[\]]*:0*([0-9]*)$", 1)
    named = host.rlike(rf"^{LABEL}(\.{LABEL})*$") & (F.length(host) <= 253) & ~host.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$")
    return ~column.rlike(r"(?U)[\s\x1c-\x1f]") & named & ((F.length(port) < 5) | (F.length(port) == 5) & (port <= "65535"))


def is_url(text: str) -> bool:
    """The same of one string."""
    place = re.match("(?i:https?)://([^/?#]*)", text)
    end = re.fullmatch(r"([^:\[\]]*?)\.?(?::0*([0-9]*))?", place[1].rpartition("@")[2]) if place and not re.search(r"[\s\x1c-\x1f]", text) else None
    if not end or len(end[1]) > 253 or re.fullmatch(rf"{OCTET}(\.{OCTET}){{3}}", end[1]):
        return False
    return bool(re.fullmatch(rf"{LABEL}(\.{LABEL})*", end[1])) and len(end[2] or "") <= 5 and int(end[2] or 0) <= 65535
