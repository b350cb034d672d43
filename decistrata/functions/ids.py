"""Canonical forms of the identifiers that the tables write in several ways.

Everything here is a JVM-side column expression; nothing triggers a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The full-width forms of printable ASCII lie at a fixed distance from it.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))

NETWORK_PATTERN = r"(?:^|[^A-Z0-9])NW[^A-Z0-9]*([0-9O]+)[^A-Z0-9]*([A-Z]{2})[^A-Z0-9]*$"


def narrow(c: Column) -> Column:
    """Full-width characters as ASCII, format characters removed."""
    return F.regexp_replace(F.translate(c, _WIDE, _NARROW), r"\p{Cf}", "")


def name_key(c: Column) -> Column:
    """Case, blanks and punctuation don't count: ``Grocer South`` = ``grocer_south``. Null stays null."""
    usual = c.rlike(r"^[a-z0-9_.]+$")  # most names need no look at single characters
    return F.when(usual, F.translate(c, "_.", "")).otherwise(F.regexp_replace(F.lower(narrow(c)), r"[^\p{L}\p{N}]+", ""))


def network_key(c: Column) -> Column:
    """``<number>-<LETTERS>`` of a network's name, or null for a string that names none.

    A name is ``NW``, a number and two letters with any punctuation between; words or a domain may
    precede it. Leading zeros mean nothing, and a letter O within the number is a zero.
    """
    usual = c.rlike(r"^NW-[0-9]+-[A-Z]{2}$")
    up = F.when(usual, c).otherwise(F.upper(narrow(c)))
    digits = F.translate(F.regexp_extract(up, NETWORK_PATTERN, 1), "O", "0")
    letters = F.regexp_extract(up, NETWORK_PATTERN, 2)
    number = F.regexp_replace(digits, r"^0+(?=[0-9])", "")
    return F.when(usual, F.regexp_replace(F.substring(c, 4, 1_000_000), r"^0+(?=[0-9])", "")).otherwise(F.when(letters != "", F.concat(number, F.lit("-"), letters)))


def with_domain(df: DataFrame, domains: DataFrame, column: str = "domain_id", to: str = "domain") -> DataFrame:
    """Add the proper ``domain_id`` of ``domains`` as column ``to``, in the place of a column of that
    name if there is one; null where none fits.

    ``domains`` is a catalog table: the plan leaves the join side to Catalyst, which broadcasts it
    by its file size and else joins by shuffle.
    """
    names = domains.select(name_key(F.col("domain_id")).alias("_dk"), F.col("domain_id").alias("_dn")).groupBy("_dk").agg(F.min("_dn").alias(to))
    own = F.col(column).alias("_dc")
    return df.select(own, *[F.col(f"`{c}`") for c in df.columns if c not in (to, "_dk", "_dc")]).withColumn("_dk", name_key(F.col("_dc"))).drop("_dc").join(names, "_dk", "left").drop("_dk")


def time_key(c: Column) -> Column:
    """Weeks as ``yyyy-Www``; ``2011W06``, ``W06/2011`` and ``2011-w6`` are the same week, else null."""
    s = F.upper(narrow(c))
    y = F.regexp_extract(s, r"([0-9]{4})", 1)
    w = F.regexp_extract(s, r"W\s*([0-9]{1,2})(?![0-9])", 1)
    return F.when(c.rlike(r"^[0-9]{4}-W[0-9]{2}$"), c).otherwise(F.when((y != "") & (w != ""), F.concat(y, F.lit("-W"), F.lpad(w, 2, "0"))))
