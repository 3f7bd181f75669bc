"""String helpers shared by the URL, archive and storage expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\r\n\f\x0b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once.

    Catalyst copies an expression into every place that uses it. Nested URL expressions
    would grow without bound; a lambda variable stands for the value instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(col, F.lit(_BLANKS))


def percent_decode(col: Column) -> Column:
    """Decode ``%xx`` escapes and leave ``+`` and malformed escapes as they are.

    ``url_decode`` turns ``+`` into a space and raises on ``%zz``, so both are
    escaped first. Strings without ``%`` skip the work.
    """


    def decode(text: Column) -> Column:
        protected = F.regexp_replace(
            F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25"
        )
        return F.when(F.contains(text, F.lit("%")), F.url_decode(protected)).otherwise(text)

    return let(col, decode)


def drop_nulls(*cols: Column) -> Column:
    """Array of the non-null values, in order."""
    return F.array_compact(F.array(*cols))
