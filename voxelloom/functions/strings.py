"""String helpers, for columns and for the driver."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(s: Column, chars: str = " ") -> Column:
    """Without any of ``chars`` at both ends; nothing is left of a string of them alone."""
    return F.btrim(s, F.lit(chars))


def split(s: Column, delimiter: str) -> Column:
    """Parts between delimiters: empty ones stay, but for one at the end; an empty string has none."""
    parts = F.split(s, "\\Q" + delimiter + "\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def path_join(a: Column, b: Column) -> Column:
    """One separator between two parts of a path."""
    return F.concat(F.rtrim(a, F.lit("/")), F.lit("/"), F.ltrim(b, F.lit("/")))


def join_paths(a: str, b: str) -> str:
    return a.rstrip("/") + "/" + b.lstrip("/")


def replace_extension(path: Column, extension: str) -> Column:
    """The path with another extension: what follows the last dot of its last part goes; a part that only begins with a dot has none."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/.])\.[^/.]*$", ""), F.lit("." + extension.lstrip(".") if extension else ""))


def six_digits(v: Column) -> Column:
    """A number with six significant digits, as C++ streams write it: no zeros at the end, an exponent where it is needed.

    A number that is halfway in its shortest decimal form is rounded up, where C++ goes
    by the binary value.
    """
    shown = F.format_string("%.5e", v.cast("double"))
    exponent = F.regexp_extract(shown, r"e([+-]\d+)$", 1).cast("int")
    fixed = lambda d: F.format_string(f"%.{d}f", v.cast("double"))
    plain = fixed(0)
    for e in range(-4, 6):
        plain = F.when(exponent == e, fixed(5 - e)).otherwise(plain)
    stripped = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    small = F.concat(F.regexp_replace(F.regexp_extract(shown, r"^(.*)e", 1), r"\.?0+$", ""), F.lit("e"), F.regexp_extract(shown, r"e([+-]\d+)$", 1))
    return F.when(F.isnan(v), F.lit("nan")).when(v.isin(float("inf"), float("-inf")), F.when(v > 0, "inf").otherwise("-inf")).when(v == 0, F.lit("0")).when(exponent.between(-4, 5), stripped).otherwise(small)


def volume_name(parts: list[Column], spacing: Column) -> Column:
    """Unambiguous name of a volume: its tags, and its slice spacing with all decimals."""
    return F.concat_ws("_", *[trim(p) for p in parts], F.translate(F.format_string("%.6f", spacing), ".", "_"))
