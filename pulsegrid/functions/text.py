"""Message fingerprints, signatures, cursors and other small column functions."""

from __future__ import annotations

import base64
import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions.parsing import strip
from pulsegrid.params import ERROR_LEVELS


def is_error(level: Column) -> Column:
    return level.isin(*ERROR_LEVELS)


def normalize_message(message: Column) -> Column:
    """Lower case, trimmed, every run of digits as one N."""
    return F.regexp_replace(strip(F.lower(message)), r"\p{Nd}+", "N")


def fingerprint(message: Column) -> Column:
    """The first 16 hex digits of the normalised message's SHA-256; no message counts as an empty one."""
    return F.substring(F.sha2(normalize_message(F.coalesce(message, F.lit(""))), 256), 1, 16)


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:00")


def client_ip(forwarded: Column, peer: Column | None = None) -> Column:
    """The first address of an X-Forwarded-For value, else the peer's."""
    first = strip(F.split(forwarded, ",")[0])
    other = peer if peer is not None else F.lit(None).cast("string")
    return F.when(F.coalesce(forwarded, F.lit("")) != "", first).otherwise(other)


def iso_utc(ts: Column) -> Column:
    """ISO text with offset; the fraction appears only when there is one."""
    fraction = F.when(
        F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")
    ).otherwise(F.lit(""))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def uuid_of(*parts: Column) -> Column:
    """A UUID-shaped id derived from the parts, so that a replay gives the same id."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    cut = lambda start, n: F.substring(h, start, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


# -- HMAC --------------------------------------------------------------------


def signing_pads(secret: str) -> tuple[bytes, bytes]:
    """The two key pads of HMAC-SHA256, to be shipped instead of the secret."""
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def signature(payload: Column, inner_pad: Column, outer_pad: Column) -> Column:
    """`sha256=<hex>` of HMAC-SHA256 over the payload; empty without a secret."""
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(payload, "UTF-8")), 256))
    digest = F.sha2(F.concat(outer_pad, inner), 256)
    return F.when(inner_pad.isNull(), F.lit("")).otherwise(F.concat(F.lit("sha256="), digest))


def signature_valid(payload: Column, inner_pad: Column, outer_pad: Column, received: Column) -> Column:
    """A delivery passes if either side has no signature or both agree."""
    unchecked = inner_pad.isNull() | (F.coalesce(received, F.lit("")) == "")
    return unchecked | (signature(payload, inner_pad, outer_pad) == received)


# -- page cursors ------------------------------------------------------------


def cursor_column(detected_at: Column, alert_id: Column) -> Column:
    """The page cursor of a row: URL-safe base64 of a small JSON object."""
    body = F.to_json(F.struct(iso_utc(detected_at).alias("detected_at"), alert_id.alias("id")))
    return F.translate(F.regexp_replace(F.base64(body), r"\s", ""), "+/", "-_")


def encode_cursor(at: datetime, alert_id: str) -> str:
    """The same cursor for one row on the driver. A time without zone is taken as UTC."""
    at = at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)
    text = json.dumps({"detected_at": at.isoformat(), "id": alert_id}, separators=(",", ":"))
    return base64.b64encode(text.encode(), b"-_").decode()


def decode_cursor(cursor: str | None) -> tuple[datetime, str] | None:
    """(time with zone, id) that a cursor names; None if it is malformed or none is given."""
    if not cursor:
        return None
    try:
        fields = json.loads(base64.b64decode(cursor, b"-_", validate=True))
        at = datetime.fromisoformat(fields["detected_at"])
        alert_id = fields["id"]
    except (ValueError, KeyError, TypeError):
        return None
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)), str(alert_id)
