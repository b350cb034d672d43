"""Reading numbers and yes/no words out of text, JVM-side and without errors under ANSI mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import narrow

TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")

_PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"
_GROUPED = r"^[+-]?[1-9][0-9]{0,2}(,[0-9]{3})+(\.[0-9]+)?$"
_GAPPED = r"^[+-]?[1-9][0-9]{0,2}([ '’][0-9]{3})+([.,][0-9]+)?$"
_POINTED = r"^[+-]?[1-9][0-9]{0,2}(\.[0-9]{3})+,[0-9]+$"
_COMMA = r"^[+-]?[0-9]+,[0-9]+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def tidy(c: Column) -> Column:
    """Lower case, ASCII digits and minus, no blanks at the ends, single blanks within."""
    s = F.regexp_replace(F.lower(narrow(c)), "[−–]", "-")
    return F.trim(F.regexp_replace(s, r"[\s   　]+", " "))


def _bare(tidied: Column, unit: Column) -> Column:
    """Without the feature's own unit behind the number."""
    u = F.lower(unit)
    return F.when(u.isNotNull() & (u != "") & tidied.endswith(u), F.rtrim(F.substring(tidied, F.lit(1), F.length(tidied) - F.length(u)))).otherwise(tidied)


def _digits(n: Column) -> Column:
    """A number's usual form, which casts read; null for what is no number."""
    return (
        F.when(n.rlike(_PLAIN), n)
        .when(n.rlike(_GROUPED), F.translate(n, ",", ""))
        .when(n.rlike(_COMMA), F.translate(n, ",", "."))
        .when(n.rlike(_POINTED), F.translate(F.translate(n, ".", ""), ",", "."))
        .when(n.rlike(_GAPPED), F.translate(F.translate(n, " '’", ""), ",", "."))
    )


def _without_percent(n: Column) -> Column:
    return F.when(n.endswith("%"), F.rtrim(F.substring(n, F.lit(1), F.length(n) - 1))).otherwise(n)


def _finite(v: Column) -> Column:
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def read_number(tidied: Column, unit: Column) -> Column:
    """The double that a text means, else null.

    Read are signs, exponents, grouping by comma, blank or apostrophe, a decimal comma, the
    feature's own unit after the number and a percent sign (hundredths). ``1,234`` is grouping;
    a comma with another number of digits behind it is a decimal comma. Words, ``nan``, broken
    numbers (``1e``, ``12..5``, ``1.2.3``) and foreign units give null.
    """
    number = lambda n: let(_digits(_without_percent(n)).try_cast("double"), _finite)
    return let(_bare(tidied, unit), lambda n: F.when(n.endswith("%"), F.round(number(n) / 100, 12)).otherwise(number(n)))


def read_whole(tidied: Column, unit: Column) -> Column:
    """The whole number that a text means, exactly, over the range of ``bigint``; else null."""

    def whole(n: Column) -> Column:
        return let(_digits(_without_percent(n)), lambda t: F.when(n.endswith("%"), _as_whole(F.concat(t, F.lit("e-2")))).otherwise(_as_whole(t)))

    return let(_bare(tidied, unit), whole)


def _as_whole(text: Column) -> Column:
    """Decimals keep every digit of the range; a text with more than ten digits behind the point is whole
    only if its double is."""
    exact, near = text.try_cast("decimal(38,10)"), text.try_cast("double")
    return F.when((exact == F.floor(exact)) & (near == F.floor(near)), exact.try_cast("bigint"))


def read_boolean(tidied: Column) -> Column:
    """1.0 or 0.0 for a yes or no word (or 1 and 0), else null."""
    return F.when(tidied.isin(*TRUE_WORDS), F.lit(1.0)).when(tidied.isin(*FALSE_WORDS), F.lit(0.0))


def read_typed(raw: Column, value_type: Column, unit: Column) -> Column:
    """``value`` (double) and, of a ``long`` feature, ``whole`` (bigint, exact) by ``value_type``: ``double``,
    ``long`` (whole numbers within the range of bigint only) or ``boolean``; both null for what can't be read."""

    def cell(value: Column, whole: Column | None = None) -> Column:
        return F.struct(value.cast("double").alias("value"), (F.lit(None) if whole is None else whole).cast("bigint").alias("whole"))

    def both(whole: Column) -> Column:
        return let(whole, lambda w: cell(w, w))

    def typed(s: Column) -> Column:
        return F.when(value_type == "boolean", cell(read_boolean(s))).when(value_type == "long", both(read_whole(s, unit))).otherwise(cell(read_number(s, unit)))

    # most values are plain numbers, which need no tidying
    usual = (value_type != "boolean") & raw.rlike(r"^-?[0-9]{1,300}(\.[0-9]+)?$")
    return F.when(usual & (value_type == "long"), both(_as_whole(raw))).when(usual, cell(raw.try_cast("double"))).otherwise(let(tidy(raw), typed))
