"""Version expressions: `a[.b[.c]][-qualifier]` as a struct of numbers. Unreadable versions give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lowest major version served, by module.
MINIMUM_MAJOR = {"spring-boot": 4, "spring-framework": 7, "spring-security": 6, "spring-data": 4, "spring-cloud": 4, "spring-ai": 1, "github-wiki": 0}


def parse_version(text: Column) -> Column:
    """struct(major, minor, patch, qualifier): missing numbers are 0, a missing qualifier is null."""
    pattern = r"^(\d{1,9})(?:\.(\d{1,9}))?(?:\.(\d{1,9}))?(?:[.-](.+))?$"
    number = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int"), F.lit(0))
    parsed = F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), F.nullif(F.regexp_extract(text, pattern, 4), F.lit("")).alias("qualifier"))
    return F.when(text.rlike(pattern), parsed)


def version_key(v: Column) -> Column:
    """What versions are compared by: the numbers without the qualifier."""
    return F.struct(v["major"].alias("major"), v["minor"].alias("minor"), v["patch"].alias("patch"))


def version_string(major: Column, minor: Column, patch: Column) -> Column:
    return F.concat_ws(".", major, minor, patch)


def in_range(v: Column, low: Column, high: Column) -> Column:
    """Inclusive; a null bound is open."""
    return (low.isNull() | (version_key(v) >= version_key(low))) & (high.isNull() | (version_key(v) <= version_key(high)))


def range_string(module: Column, low: Column, high: Column) -> Column:
    return F.concat(module, F.lit(":["), F.coalesce(low, F.lit("*")), F.lit(", "), F.coalesce(high, F.lit("*")), F.lit("]"))


def meets_minimum(module: Column, major: Column) -> Column:
    """Whether a module's major version is served; unknown modules start at 1."""
    least = F.lit(1)
    for name, value in MINIMUM_MAJOR.items():
        least = F.when(module == name, value).otherwise(least)
    return major >= least


def compare_versions(module: Column, a: Column, other: Column, b: Column) -> Column:
    """struct(order, error): -1, 0 or 1 by the numbers of two versions of one module; versions of different modules have no order."""
    x, y = version_key(a), version_key(b)
    order = F.when(module == other, F.when(x < y, -1).when(x > y, 1).otherwise(0))
    return F.struct(order.alias("order"), F.when(module != other, "different modules").alias("error"))


def is_removed(removed_in: Column, current: Column) -> Column:
    """Whether a feature is gone by the current version; false where no removal is known."""
    gone, now = parse_version(removed_in), parse_version(current)
    return F.coalesce(gone.isNotNull() & now.isNotNull() & (version_key(gone) <= version_key(now)), F.lit(False))
