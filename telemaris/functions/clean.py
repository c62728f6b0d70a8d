"""Cleaning of raw fields: columns in, columns out, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

ISO_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
HUMAN_TIME = "MMM d, yyyy '@' HH:mm:ss.SSSSSS"


def of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def printable(c: str | Column) -> Column:
    """Only printable ASCII, tabs and line ends stay."""
    return F.regexp_replace(of(c), r"[^\x20-\x7E\t\n\r]", "")


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def safe_int(c: str | Column) -> Column:
    """A number's whole part; null for what is no finite number."""
    return F.trim(of(c)).try_cast("double").try_cast("bigint")


def clean_guid(c: str | Column) -> Column:
    """Without outer white space and braces; null if nothing is left."""
    return null_if_empty(F.regexp_replace(F.trim(of(c)), r"^[{}]+|[{}]+$", ""))


def clean_text(c: str | Column) -> Column:
    return null_if_empty(F.trim(of(c)))


def clean_strings(df: DataFrame) -> DataFrame:
    """All string columns trimmed, empty ones null."""
    return df.withColumns({f.name: clean_text(f.name) for f in df.schema if f.dataType == T.StringType()})


def iso_time(c: str | Column) -> Column:
    """An ISO time as text with microseconds; its zone letter is dropped; null if it is none."""
    return F.date_format(F.try_to_timestamp(F.regexp_replace(of(c), "Z", "")), ISO_MICROS)


def human_time(c: str | Column) -> Column:
    """A time like `Jan 29, 2025 @ 04:24:54.863 (UTC)`."""
    return F.try_to_timestamp(F.regexp_replace(of(c), r" \(UTC\).*", ""), F.lit(HUMAN_TIME))


def lenient_time(c: str | Column) -> Column:
    return F.try_to_timestamp(of(c))


def epoch_ms(c: str | Column) -> Column:
    return F.unix_millis(of(c).cast("timestamp"))


def seconds(nanoseconds: str | Column) -> Column:
    return of(nanoseconds) / 1e9


def scaled_bytes(c: str | Column, unit: str) -> Column:
    return of(c) / 1024 ** ("B", "KB", "MB", "GB").index(unit)


def binary_label(c: str | Column, benign: str) -> Column:
    """0 for the benign label, whatever its case and outer white space; 1 for all others and for null."""
    return F.when(F.lower(F.trim(of(c).cast("string"))).eqNullSafe(F.lit(benign)), 0).otherwise(1)


def fill_nulls(df: DataFrame, text: list[str], numeric: list[str], fill: str = "missing") -> DataFrame:
    """Text columns filled with `fill`, numeric ones as float with 0."""
    columns = {c: F.coalesce(F.col(c).cast("string"), F.lit(fill)) for c in text}
    return df.withColumns(columns | {c: F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in numeric})


def calendar(c: str | Column) -> dict[str, Column]:
    ts = of(c)
    return {"hour": F.hour(ts), "day": F.to_date(ts), "weekday": F.date_format(ts, "EEEE")}


def short_host(c: str | Column, suffix: str) -> Column:
    """A host name without the domain suffix."""
    return F.regexp_replace(of(c), "(?i)" + suffix.replace(".", r"\.") + "$", "")


def preview(c: str | Column, n: int) -> Column:
    return F.when(F.length(of(c)) > n, F.concat(F.left(of(c), F.lit(n)), F.lit("..."))).otherwise(of(c))


def first_element(c: str | Column) -> Column:
    return F.get(of(c), F.lit(0))


def as_array(c: str | Column) -> Column:
    """null as the empty array."""
    return F.coalesce(of(c), F.array().cast("array<string>"))


def wrapped(variant: str | Column) -> Column:
    """A JSON value as an array of texts: a list as it is, a scalar as one element, null or nothing as the empty array."""
    v = of(variant)
    kind = F.schema_of_variant(v)
    return F.when(v.isNull() | (kind == "VOID"), F.array().cast("array<string>")).when(kind.startswith("ARRAY"), v.try_cast("array<string>")).otherwise(F.array(v.cast("string")))


def range_list(c: str | Column) -> Column:
    """`"0-22,24"` as an array of whole numbers."""
    parts = F.transform(F.split(of(c), ","), lambda p: F.split(F.trim(p), "-"))
    return F.flatten(F.transform(parts, lambda p: F.sequence(F.get(p, 0).cast("int"), F.element_at(p, -1).cast("int"))))


def require_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that df has, in that order; an error if it has none."""
    found = [c for c in wanted if c in df.columns]
    if not found:
        raise ValueError(f"none of {wanted} is in {df.columns}")
    return found


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with a column that is worked out once for each row, whatever reads it.

    Filters and projections over a parsed column are otherwise merged with the parsing, which then runs once for each use. The
    optimiser does not look into a generator, here one of a single row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
