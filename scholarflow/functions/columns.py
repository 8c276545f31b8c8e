"""Column functions of the scholarly model."""

from __future__ import annotations

import difflib
import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def int_or_zero(c: Column) -> Column:
    """A whole number, or 0 for null, empty and unreadable strings."""
    return F.coalesce(F.trim(c.cast("string")).try_cast("bigint"), F.lit(0).cast("bigint"))


def int_or_zero_json(c: Column) -> Column:
    """The text of a JSON value: numbers are cut to whole ones, anything unreadable is 0."""
    return F.coalesce(F.trim(c).try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def slugify(c: Column) -> Column:
    """Lower case; runs of all but a-z and 0-9 become one underscore, none at the ends; 'unknown' if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def normalized_title(c: Column) -> Column:
    """The a-z and 0-9 tokens of the lower-case title, with single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def last_segment(c: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(c, "/", -1)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def age_bin(age: Column) -> Column:
    return F.when(age < 0, "pre_publication").when(age <= 2, "0-2").when(age <= 5, "3-5").when(age <= 10, "6-10").when(age <= 20, "11-20").otherwise("21+")


def md5_bucket(c: Column, buckets: int) -> Column:
    """The same bucket on every engine: the first 32 bits of the md5 sum."""
    return (F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets).cast("bigint")


@F.pandas_udf(T.LongType())
def _blake2b(values: pd.Series, buckets: pd.Series) -> pd.Series:
    return pd.Series([int.from_bytes(hashlib.blake2b(str(v).encode(), digest_size=8).digest(), "big") % b for v, b in zip(values, buckets, strict=True)])


def blake2b_bucket(c: Column, buckets: int) -> Column:
    """The bucket of an 8-byte blake2b digest, read as a big-endian number."""
    return _blake2b(c.cast("string"), F.lit(buckets))


def similarity_ratio(a: str, b: str) -> float:
    """Share of characters in matching blocks, from 0 to 1."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def similar(a: str, b: str, ratio: float) -> bool:
    """If similarity_ratio is ratio at least; the characters in common, in any order, settle most that aren't."""
    m = difflib.SequenceMatcher(None, a, b)
    return m.quick_ratio() >= ratio and m.ratio() >= ratio


def smoothed_ratio(actual: Column, expected: Column, prior: float = 0.1) -> Column:
    return (actual + prior) / (expected + prior)


def split_share(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator; null where that is 0."""
    return numerator / F.nullif(denominator, F.lit(0))
