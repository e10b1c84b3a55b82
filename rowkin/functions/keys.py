"""Derived keys: pair ids, cluster ids, phonetic keys and the hold-out split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespace of the cluster ids, and how many tenths of the persons are for training.
CLUSTER_NAMESPACE = "6f1c2d8e-5b1a-4c3e-9a57-3d2f0e8b7c41"
DEV_TENTHS = 6


def entity_key(source: str, source_id: Column) -> Column:
    return F.concat_ws(":", F.lit(source), source_id)


def pair_id(left: Column, right: Column) -> Column:
    return F.substring(F.sha1(F.concat(left, F.lit("|"), right)), 1, 16)


def family_key(family_norm: Column) -> Column:
    """Soundex of the first family name."""
    return F.soundex(F.substring_index(family_norm, " ", 1))


def cluster_id(min_member: Column) -> Column:
    """Name-based UUID (version 5, RFC 9562) of the smallest member key."""
    namespace = F.unhex(F.lit(CLUSTER_NAMESPACE.replace("-", "")))
    digest = F.sha1(F.concat(namespace, F.encode(min_member, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def holdout_split(person_id: Column) -> Column:
    """``dev`` or ``test`` by the last decimal digit of the MD5 of the person, as one number."""
    digest = F.md5(person_id)

    def last_digit(half: Column) -> Column:
        return F.right(F.conv(half, 16, 10), F.lit(1)).cast("int")

    # 2**64 ends in 6, so the upper half counts six times.
    high = last_digit(F.substring(digest, 1, 16))
    low = last_digit(F.substring(digest, 17, 16))
    return F.when((high * 6 + low) % 10 < DEV_TENTHS, "dev").otherwise("test")
