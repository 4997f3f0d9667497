"""Names derived from content, equal in every run."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """RFC 4122 version 5 in SQL: SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def fingerprint(*columns: Column, length: int = 12) -> Column:
    """The first hex digits of SHA-256 over the values joined by bars; null is empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256), 1, length)


def seeded_order(seed: int | str, *key: Column) -> Column:
    """A random-looking order that any engine reproduces: MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in key)))


def config_hash(config: dict, secret: tuple[str, ...] = ("api_key",)) -> str:
    """SHA-256 of a configuration as sorted JSON, secrets left out."""
    kept = {k: v for k, v in config.items() if k not in secret}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()
