"""Stable identifiers, hashes and splits, all as Column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prefix of the names that ids are made from; another system's ids need its own.
NAMESPACE = "onomast"


def stable_id(kind: str, *parts: Column, namespace: str = NAMESPACE) -> Column:
    """Version 5 UUID of ``<namespace>:kind:part|part`` in the URL namespace."""
    name = F.concat(F.lit(f"{namespace}:{kind}:"), F.concat_ws("|", *[p.cast("string") for p in parts]))
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def content_hash(json: Column) -> Column:
    return F.substring(F.sha2(json, 256), 1, 16)


def bucket(json: Column) -> Column:
    """0 to 99, from the first 8 digits of the content hash."""
    return (F.conv(F.substring(F.sha2(json, 256), 1, 8), 16, 10).cast("long") % 100).cast("int")


def split(canonical: Column, template: Column) -> Column:
    """TEST_UNSEEN by family, then TEST_KNOWN and CALIBRATION by family and template, else TRAIN."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    family = bucket(F.concat(F.lit('{"canonical": '), quoted(canonical), F.lit("}")))
    within = bucket(F.concat(F.lit('{"canonical": '), quoted(canonical), F.lit(', "template": '), quoted(template), F.lit("}")))
    return F.when(family < 15, "TEST_UNSEEN").when(within < 15, "TEST_KNOWN").when(within < 30, "CALIBRATION").otherwise("TRAIN")


def incoming_id(name: Column) -> Column:
    return F.concat(F.lit("incoming-"), F.substring(F.sha2(F.lower(name), 256), 1, 16))


def shard(index: Column, size: int = 100) -> Column:
    return F.floor(index / size).cast("int")
