"""Seeds, identifiers and fingerprints: pure expressions, equal on every engine that has SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED_RANGE = 2**31 - 1
SEPARATOR = "|"
# Fixed value: the fields of a sample's identity, in order.
SAMPLE_FIELDS = ("source", "problem_key", "language", "model_id", "method", "config_hash", "key_id", "sample_index", "parent_id", "attack_id", "attack_params_hash")


def _joined(parts, missing: str) -> Column:
    text = lambda p: F.coalesce(p.cast("string"), F.lit(missing)) if isinstance(p, Column) else F.lit(missing if p is None else str(p))
    return F.concat_ws(SEPARATOR, *[text(p) for p in parts])


def seed(*parts) -> Column:
    """A number below 2^31 - 1 from the parts; a null part counts as the word None."""
    digest = F.sha2(_joined(parts, "None"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(SEED_RANGE)).cast("long")


def unit(*parts) -> Column:
    """A number in [0, 1) from the parts."""
    return seed(*parts) / F.lit(float(SEED_RANGE + 1))


def sample_id(**fields: Column) -> Column:
    """Identity of a sample: 32 hex digits over its fields in fixed order, null as empty."""
    return F.md5(_joined([fields.get(name) for name in SAMPLE_FIELDS], ""))


def canonical_json(entries: Column) -> Column:
    """Compact JSON of a map with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def json_hash(entries: Column) -> Column:
    return F.sha2(canonical_json(entries), 256)


def config_hash(hparams: Column, contract: str = "1", commit: str = "") -> Column:
    """12 hex digits over the parameters, the contract's version and the commit."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, canonical_json(hparams), F.lit(contract), F.lit(commit)), 256), 1, 12)


def params_hash(attack_id: Column, params: Column, version: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, attack_id, canonical_json(params), version), 256), 1, 12)


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\x09-\x0D\x1C-\x20\x85\xA0]+", " "))


def fingerprint(text: Column) -> Column:
    """Equal for texts that differ in white space only."""
    return F.md5(collapsed(text))


def key_family(key: Column) -> Column:
    return F.substring_index(key, "/", 1)


def problem_key(family: Column, name: Column) -> Column:
    return F.concat_ws("/", family, name)


def cell_key(*axes: Column) -> Column:
    """Axes that are there, in order."""
    return F.concat_ws("__", *axes)


def slug(key: Column) -> Column:
    return F.regexp_replace(key, r"[^A-Za-z0-9_.=-]+", "-")


def flattened(entries: Column) -> Column:
    """k=v;k=v by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def message_bits(number: Column, width: int = 12) -> Column:
    """The low bits of a seed as a string of 0 and 1."""
    return F.lpad(F.conv(F.pmod(number, F.lit(2**width)).cast("string"), 10, 2), width, "0")
