"""Fields of events: masking, aliases, times, keys, classes, levels and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID4 = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
MASKED = r"^\[masked:len=[0-9]+,hash_prefix=[0-9a-f]{8}\]$"

# Fixed values of the contract and of the rules.
SERVICES = ("ssh", "http", "api", "ftp", "rdp")
CREDENTIAL_PATHS = ("/login", "/signin", "/auth", "/api/login", "/api/auth", "/wp-login.php", "/admin", "/administrator", "/xmlrpc.php")
CONTRACT_FIELDS = ("timestamp", "service", "source_ip", "source_port", "username", "credential_observed", "path", "method", "user_agent", "metadata")
AUTH_ENDPOINTS = ("/auth/token", "/api/v1/auth", "/oauth/token", "/api/keys/validate", "/v1/authenticate", "/login", "/signin")


def mask_credential(c: Column) -> Column:
    """``[masked:len=N,hash_prefix=8 hex]``; null, empty and masked values stay as they are."""
    masked = F.concat(F.lit("[masked:len="), F.char_length(c).cast("string"), F.lit(",hash_prefix="), F.substring(F.sha2(c, 256), 1, 8), F.lit("]"))
    return F.when(c.isNull() | (c == "") | c.startswith("[masked:"), c).otherwise(masked)


def first_text(*columns: Column) -> Column:
    """The first non-empty text, trimmed after it is chosen: blanks alone stop the search and give an empty text."""
    return F.coalesce(*(F.trim(F.when(c != "", c)) for c in columns), F.lit(""))


def first_int(*columns: Column) -> Column:
    return F.coalesce(*(c.try_cast("int") for c in columns))


def parsed_time(*columns: Column) -> Column:
    """The first value that is a time: seconds since 1970 (not 0) or ISO text; a trailing Z is dropped, and times without a zone are UTC."""
    out = []
    for c in columns:
        seconds = c.try_cast("double")
        out.append(F.when(seconds.isNotNull(), F.when(seconds != 0, F.timestamp_micros((seconds * 1000000).cast("long")))).otherwise(F.try_to_timestamp(F.regexp_replace(c, "Z$", ""))))
    return F.coalesce(*out)


def event_id(c: Column, *content: Column) -> Column:
    """A valid version 4 id is kept. Others get one: random, or, if ``content`` is named, made of its digest, so that a replay agrees."""
    if not content:
        return F.when(c.rlike(UUID4), c).otherwise(F.uuid())
    d = F.sha2(F.concat_ws("\x1f", *content), 256)
    made = F.concat(F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-4"), F.substring(d, 14, 3), F.lit("-a"), F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12))
    return F.when(c.rlike(UUID4), c).otherwise(made)


def violations(required: list[Column], names: list[str], service: Column, port: Column, credential: Column) -> Column:
    """What a row breaks of the event contract, in a fixed order; empty if nothing."""
    tests = [F.when(c.isNull(), F.lit(f"missing:{n}")) for c, n in zip(required, names, strict=True)]
    tests += [
        F.when(~service.isin(*SERVICES), F.lit("service")),
        F.when(~port.between(0, 65535), F.lit("port")),
        F.when((credential != "") & ~credential.rlike(MASKED), F.lit("credential")),
    ]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def unknown_fields(names: Column, known: tuple[str, ...] = CONTRACT_FIELDS) -> Column:
    """Names of an event's fields that the contract doesn't have, sorted; empty if none. ``names`` is an array, as of ``json_object_keys``."""
    return F.array_sort(F.filter(names, lambda n: ~n.isin(*known)))


def api_request(body: Column) -> tuple[Column, Column]:
    """User name and masked credential of an API request's parsed body: of the fields that may hold one, the first that isn't empty; else null."""
    first = lambda *names: F.coalesce(*(F.nullif(body[n], F.lit("")) for n in names))
    return first("client_id", "username"), mask_credential(first("client_secret", "password", "api_key", "credential_header"))


def credential_key(c: Column) -> Column:
    """For dedup: the hash prefix, else the text, else a constant."""
    return F.coalesce(F.nullif(F.regexp_extract(c, "hash_prefix=([0-9a-f]+)", 1), F.lit("")), F.nullif(c, F.lit("")), F.lit("__no_cred__"))


def credential_hash(c: Column) -> Column:
    """For metrics: the hash prefix or null."""
    return F.nullif(F.regexp_extract(c, "hash_prefix=([0-9a-f]+)", 1), F.lit(""))


def is_common_word(p: Column) -> Column:
    return p.rlike("^[a-z]{1,8}$")


def is_targeted(p: Column) -> Column:
    return p.rlike("20[0-9][0-9]") | p.contains("@")


def level(score: Column, *steps: tuple[int, str], low: str) -> Column:
    out = F
    for least, name in steps:
        out = out.when(score >= least, name)
    return out.otherwise(low)


def campaign_tier(score: Column) -> Column:
    return level(score, (60, "COORDINATED"), (35, "LIKELY_COORDINATED"), (15, "SUSPICIOUS"), low="ISOLATED")


def lateral_level(score: Column) -> Column:
    return level(score, (70, "CRITICAL"), (40, "HIGH"), (15, "MEDIUM"), low="LOW")


def session_severity(score: Column) -> Column:
    return level(score, (80, "CRITICAL"), (60, "HIGH"), (40, "MEDIUM"), (20, "LOW"), low="INFO")


def geo_level(score: Column) -> Column:
    return level(score, (80, "CRITICAL"), (55, "HIGH"), (35, "MEDIUM"), (15, "LOW"), low="INFO")


def token_fingerprint(token_id: Column, value: Column) -> Column:
    return F.substring(F.sha2(F.concat(token_id, value), 256), 1, 16)


def callback_url(kind: Column, value: Column, token_id: Column, base: str) -> Column:
    return F.when(kind == "HTTP_URL", value).otherwise(F.concat(F.lit(f"{base}/alert/"), token_id))


def anonymised(ip: Column, ts_ms: Column, now_ms: int, days: int = 90, salt: str = "") -> Column:
    """The address, or its salted digest once the row is older than ``days``."""
    return F.when(ts_ms < now_ms - days * 86_400_000, F.sha2(F.concat(F.lit(salt), ip), 256)).otherwise(ip)


def session_seconds(start_ms: Column, end_ms: Column) -> Column:
    return F.greatest(F.lit(0.0), (end_ms - start_ms) / 1000.0)
