"""Canonical JSON, content digests and seeded draws, all as column expressions.

Canonical JSON has sorted keys, no blanks and raw Unicode; a draw is 53 bits of the SHA-256 of [seed, namespace, key].
Hashed structs hold strings, integers and booleans only: JVM and other writers print doubles differently.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def canonical(fields: dict[str, Column]) -> Column:
    """Canonical JSON of an object; keys are sorted here, nulls are written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), KEEP_NULLS)


def json_array(*cols: Column | str) -> Column:
    """Canonical JSON of an array of strings."""
    return F.to_json(F.array(*cols))


def digest(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical(fields), 256)


def seeded(seed: int, namespace: str, key_json: Column) -> Column:
    """Hex digest of [seed, namespace, key]; key_json is the key's canonical JSON."""
    head = f"[{seed},{json.dumps(namespace, ensure_ascii=False)},"
    return F.sha2(F.concat(F.lit(head), key_json, F.lit("]")), 256)


def uniform(seed: int, namespace: str, key_json: Column) -> Column:
    """A draw in [0, 1), the same on every engine that hashes the same bytes."""
    bits = F.conv(F.substring(seeded(seed, namespace, key_json), 1, 16), 16, -10).cast("bigint")
    return F.shiftrightunsigned(bits, 11) / F.lit(float(1 << 53))


def string_json(c: Column | str) -> Column:
    """Canonical JSON of one string."""
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def split_for(tenant: Column | str, group: Column | str, seed: int = 42) -> Column:
    """train below 0.7, calibration below 0.85, else test; null if a part is null."""
    u = uniform(seed, "split-v1", json_array(tenant, group))
    c = lambda x: F.col(x) if isinstance(x, str) else x
    s = F.when(u < 0.7, "train").when(u < 0.85, "calibration").otherwise("test")
    return F.when(c(tenant).isNotNull() & c(group).isNotNull(), s)
