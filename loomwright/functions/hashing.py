"""Keys: content, occurrence, recipe and snapshot identities, and deterministic folds."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_key(text: Column) -> Column:
    """Hex sha256 of the text's UTF-8 bytes; NULL for NULL."""
    return F.sha2(text, 256)


def occ_key(path: Column, symbol: Column, start: Column, end: Column, key: Column) -> Column:
    """Hex sha256 of the five parts, joined by zero bytes: independent of repository and commit."""
    return F.sha2(F.concat_ws("\0", path, symbol, start.cast("string"), end.cast("string"), key), 256)


def recipe_id(recipe: dict) -> str:
    """First 16 hex digits of the sha256 of the recipe's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(recipe, sort_keys=True).encode()).hexdigest()[:16]


def snapshot_id(repo: Column, commit: Column, mode: Column) -> Column:
    """repo@commit:mode, with the first 12 digits of the commit, as the tables have it."""
    return F.concat(repo, F.lit("@"), F.substring(commit, 1, 12), F.lit(":"), mode)


def fold(identifier: Column, n: int = 5) -> Column:
    """The 256-bit sha256 of the id, modulo n, taken four hex digits at a time."""
    digest = F.sha2(identifier, 256)
    value = F.lit(0).cast("long")
    for i in range(16):
        value = F.pmod(value * (65536 % n) + F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("long"), F.lit(n))
    return value.cast("int")
