"""Column functions on text: folding, languages, role families, dates, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the two listing languages.
LANGUAGE_ALIASES = {"dutch": "nl", "nederlands": "nl", "nl": "nl", "english": "en", "engels": "en", "en": "en"}


def clean(x: Column) -> Column:
    """Trimmed text with single spaces; null if nothing is left. Unicode spaces count as spaces."""
    return F.nullif(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit(""))


def fold(x: Column) -> Column:
    """clean() without case. Full case folding differs from lower() in few letters; of these only sharp s is handled."""
    return F.replace(F.lower(clean(x)), F.lit("ß"), F.lit("ss"))


def stringify(x: Column, most: int = 2_000_000) -> Column:
    """Any value as clean text without NUL, cut to `most` characters."""
    return F.nullif(F.substring(clean(F.translate(x.cast("string"), "\x00", " ")), 1, most), F.lit(""))


def language(x: Column) -> Column:
    """Two-letter code of a language name or tag; null for blank values."""
    v = F.nullif(F.translate(F.lower(F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))), "_", "-"), F.lit(""))
    pairs = [F.lit(t) for kv in LANGUAGE_ALIASES.items() for t in kv]
    return F.regexp_replace(F.coalesce(F.create_map(*pairs)[v], v), "(?s)^(nl|en)-.*$", "$1")


def choose_language(*options: Column) -> Column:
    """The first option that is not empty, as a code; English if there is none."""
    return F.coalesce(language(F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit("English"))), F.lit("en"))


def role_family(x: Column) -> Column:
    slug = F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_")
    return F.nullif(F.regexp_replace(slug, "^_+|_+$", ""), F.lit(""))


def csv_items(x: Column) -> Column:
    """Distinct non-blank items of a comma-separated value, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(x, ","), lambda i: F.trim(i)), lambda i: i != ""))


def iso_date(x: Column) -> Column:
    """Date of an ISO date or date-time, taken as written (not moved to UTC); null for anything else.

    The form is checked before any cast, as casts accept trailing text and single digits.
    """
    v = F.trim(x)
    form = r"^\d{4}-\d{2}-\d{2}([T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d{1,6}\d*)?)?)?(Z|[+-]([01]\d|2[0-3])(:?[0-5]\d(:?[0-5]\d)?)?)?)?$"
    return F.when((F.length(x) >= 10) & v.rlike(form), F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd"))


def finite(x: Column) -> Column:
    """A number, or null for NaN and infinities."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def variant_number(v: Column) -> Column:
    """Finite number of a VARIANT that holds a number; null for text, booleans and the rest."""
    kind = F.schema_of_variant(v)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), finite(F.try_variant_get(v, "$", "double")))


def is_true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))
