"""Text rules as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a script engine counts as white space (NBSP and BOM are in, U+0085 is not).
JS_SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def even_spaces(c: Column) -> Column:
    """Runs of white space as one blank, trimmed, lower case: the form in which quotes are compared."""
    return F.lower(F.trim(F.regexp_replace(c, JS_SPACE + "+", " ")))


def script_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units; characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def strip_headings(c: Column) -> Column:
    """Leading # marks of every line removed."""
    return F.regexp_replace(c, r"(?m)^#+[ \t]*", "")


def quote_supported(quote: Column, source: Column) -> Column:
    """Whether quote stands in source once white space and case are evened out; empty or NULL never does."""
    q = even_spaces(quote)
    return F.coalesce((q != "") & F.contains(even_spaces(source), q), F.lit(False))


def strings_match(actual: Column, expected: Column) -> Column:
    """Equal after trim and lower case, inner white space kept; NULL equals NULL only."""
    a, e = F.lower(script_trim(actual)), F.lower(script_trim(expected))
    return F.coalesce(a == e, actual.isNull() & expected.isNull())


def numbers_match(actual: Column, expected: Column) -> Column:
    """Less than 0.01 apart; NaN equals nothing, NULL equals NULL only."""
    near = (F.abs(actual.cast("double") - expected.cast("double")) < 0.01) & ~F.isnan(actual.cast("double")) & ~F.isnan(expected.cast("double"))
    return F.coalesce(near, actual.isNull() & expected.isNull())
