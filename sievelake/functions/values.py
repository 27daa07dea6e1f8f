"""Functions of values: numbers in texts, weights, cosine similarity and coercion to field types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number as it stands in a text; three digits after a dot, a comma or white space go on with it.
SPACE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NUMBER = rf"-?(?:\d{{1,3}}(?:[,.{SPACE}]\d{{3}})+|\d+(?:\.\d+)?)"


def parsed_number(raw: Column) -> Column:
    """A number as written, as a double; commas, blanks and dots before each three digits group thousands. Null where separators mix."""
    x = F.regexp_replace(raw, "[ \\x{A0}]", "")
    plain = x.rlike(r"^-?\d+$") | (x.rlike(r"^-?\d+\.\d+$") & ~x.rlike(r"^-?\d{1,3}\.\d{3}$"))
    grouped = x.rlike(r"^-?\d+(?:,\d{3})+$") | x.rlike(r"^-?\d{1,3}\.\d{3}$") | x.rlike(r"^-?\d+(?:\.\d{3}){2,}$")
    return F.when(plain, x).when(grouped, F.regexp_replace(x, "[.,]", "")).try_cast("double")


def spelled_numbers(text: Column) -> Column:
    """All numbers of a text as they are written, in order, with those that can't be read, as in addresses."""
    return F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1)


def numbers(text: Column) -> Column:
    """All numbers of a text as doubles, in order."""
    return F.filter(F.transform(spelled_numbers(text), parsed_number), lambda x: x.isNotNull())


def to_double(s: Column) -> Column:
    """s.try_cast("double"); a text without a digit, inf or nan is told before the cast, which throws and catches for it."""
    return F.when(s.rlike("[0-9]|[iI][nN][fF]|[nN][aA][nN]"), s.try_cast("double"))


def to_number(s: Column) -> Column:
    """A number spelled without separators: digits with a sign, or anything with a dot that reads as a double; else null."""
    t = F.trim(s)
    return F.when(t.rlike(r"^[+-]?\d+$") | F.contains(t, F.lit(".")), t.try_cast("double"))


def number_matches(wanted: Column, found: Column) -> Column:
    """Equal, or apart by less than a millionth of the wanted one."""
    return (wanted == found) | (F.abs(wanted - found) < 1e-6 * F.abs(wanted))


def half_even(x: Column, places: int) -> Column:
    """Rounded, halves to the even digit."""
    return F.bround(x, places)


def effective_weight(confidence: Column, grounding: Column, mode: Column) -> Column:
    """Confidence, capped by grounding unless the mode is none or there is none."""
    return F.when((mode == "none") | grounding.isNull(), confidence).otherwise(F.least(confidence, grounding))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length or of norm zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def to_boolean(s: Column) -> Column:
    """true, yes, 1 and false, no, 0 in any case; else null."""
    low = F.lower(F.trim(s))
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def to_integer(s: Column) -> Column:
    """Commas and spaces dropped, truncated towards zero; else null."""
    return F.regexp_replace(s, "[, ]", "").try_cast("double").cast("long")


def to_float(s: Column) -> Column:
    return to_double(F.regexp_replace(s, "[, ]", ""))


def to_enum(s: Column, values: list[str]) -> Column:
    """The value of the same spelling, else of the same letters in any case, else null."""
    exact = F.when(s.isin(values), s)
    return F.coalesce(exact, *[F.when(F.lower(s) == v.lower(), v) for v in values])


def to_list(s: Column) -> Column:
    """A JSON array's items as strings; any other value as the only item; null for null."""
    return F.when(F.startswith(F.trim(s), F.lit("[")), F.coalesce(F.from_json(s, "array<string>"), F.array(s))).otherwise(F.when(s.isNotNull(), F.array(s)))
