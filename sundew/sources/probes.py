"""Captured probe bytes as columns, over whole payload tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
RDP_BITS = ((1, "ssl"), (2, "hybrid"), (4, "rdstls"), (8, "hybrid_ex"))
FTP_REPLIES = {
    "USER": 331, "PASS": 530, "SYST": 215, "FEAT": 211, "PWD": 257, "TYPE": 200, "NOOP": 200, "PASV": 425,
    "LIST": 550, "NLST": 550, "RETR": 550, "STOR": 550, "DELE": 550, "MKD": 550, "RMD": 550, "CWD": 550, "QUIT": 221,
}
REDIS_RECON = ("info", "config", "slaveof", "replicaof", "keys", "scan", "debug", "monitor", "flushall", "flushdb", "save", "bgsave", "client", "cluster", "acl", "latency")


def preview(data: Column, n: int = 64) -> Column:
    """Hex of the first ``n`` bytes."""
    return F.lower(F.hex(F.substring(data, 1, n)))


def short_digest(data: Column) -> Column:
    return F.substring(F.sha2(data, 256), 1, 16)


def rdp_protocols(data: Column) -> Column:
    """Names of the protocols that a negotiation request asks for; empty without the marker or with a cut mask."""
    digits = F.lower(F.hex(data))
    # hex digits are searched at even places only
    at = F.length(F.regexp_extract(digits, "^((?:[0-9a-f]{2})*?)01000800[0-9a-f]{8}", 1))
    found = digits.rlike("^(?:[0-9a-f]{2})*?01000800[0-9a-f]{8}")
    raw = F.substring(digits, at + 9, F.lit(8))
    little = F.concat(*(F.substring(raw, i, 2) for i in (7, 5, 3, 1)))
    mask = F.conv(little, 16, 10).cast("long")
    names = F.filter(F.array(*(F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in RDP_BITS)), lambda x: x.isNotNull())
    unknown = F.array(F.concat(F.lit("unknown_mask:0x"), little))
    return F.when(~found, F.array().cast("array<string>")).when((F.size(names) == 0) & (mask != 0), unknown).otherwise(names)


def ftp_commands(lines: DataFrame) -> DataFrame:
    """``session, seq, line`` with command, argument, reply code, and the user that the session has named so far."""
    parts = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+", 2)
    command = F.upper(F.get(parts, 0))
    replies = F.create_map(*(F.lit(x) for pair in FTP_REPLIES.items() for x in pair))
    rows = lines.withColumns({"command": F.coalesce(command, F.lit("")), "argument": F.coalesce(F.get(parts, 1), F.lit(""))})
    user = F.when(F.col("command") == "USER", F.when(F.col("argument") == "", "anonymous").otherwise(F.col("argument")))
    carried = F.last(user, ignorenulls=True).over(Window.partitionBy("session").orderBy("seq"))
    name = F.when(F.col("command").isin("USER", "PASS"), F.coalesce(carried, F.lit("anonymous"))).otherwise(carried)
    return rows.withColumns({"reply": F.coalesce(replies[F.col("command")], F.lit(500)), "username": name})


def redis_parts(data: Column) -> Column:
    """Commands as arrays of parts: one RESP array, or a command on every line."""
    lines = F.split(F.replace(data.cast("string"), F.lit("\r\n"), F.lit("\n")), "\n")
    # in an array the parts stand behind their lengths
    resp = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~x.startswith("$") & (x != ""))
    count = F.get(lines, 0).substr(F.lit(2), F.lit(9)).try_cast("int")
    inline = F.transform(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.split(x, r"\s+"))
    none = F.array().cast("array<array<string>>")
    one = F.slice(resp, 1, F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)))
    return F.when(data.cast("string").startswith("*"), F.when(F.size(one) > 0, F.array(one)).otherwise(none)).otherwise(inline)


def redis_commands(rows: DataFrame, data: str = "data") -> DataFrame:
    """One row per command with ``parts``, ``kind``, ``username`` and ``password``."""
    spread = rows.select("*", F.explode(redis_parts(F.col(data))).alias("parts"))
    name, n = F.upper(F.get("parts", 0)), F.size("parts")
    kind = F.when(name == "PING", "ping").when(name == "AUTH", "auth_attempt").when(name == "QUIT", "disconnect").when(F.lower(name).isin(*REDIS_RECON), "recon").otherwise("unauthenticated")
    auth = name == "AUTH"
    return spread.withColumns({
        "kind": kind,
        "username": F.when(auth, F.when(n > 2, F.get("parts", 1)).otherwise("")),
        "password": F.when(auth, F.when(n > 2, F.get("parts", 2)).otherwise(F.coalesce(F.get("parts", 1), F.lit("")))),
    })


def mysql_login(data: Column) -> Column:
    """Struct ``username, auth`` of a login packet: a name up to a zero at byte 36, then the answer behind its length, as hex."""
    digits = F.lower(F.hex(F.substring(data, 37, 1 << 30)))
    name = F.regexp_extract(digits, "^((?:(?!00)[0-9a-f]{2})*)", 1)
    rest = F.substring(digits, F.length(name) + 3, F.lit(1 << 30))
    size = F.coalesce(F.conv(F.nullif(F.substring(rest, 1, 2), F.lit("")), 16, 10).cast("int"), F.lit(0))
    long = F.octet_length(data) >= 36
    text = F.decode(F.unhex(name), "UTF-8")
    return F.struct(F.when(long, text).otherwise("").alias("username"), F.when(long, F.substring(rest, F.lit(3), size * 2)).otherwise("").alias("auth"))
