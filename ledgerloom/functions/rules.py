"""Column rules shared by all tables: casts, code maps, periods, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fixed

MILLION, THOUSAND = 1e6, 1e3


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


# -- casts -------------------------------------------------------------------------------

def cast(value, kind: str, name: str | None = None) -> Column:
    """Cast that yields NULL for unreadable text instead of failing the job."""
    name = name or (value if isinstance(value, str) else None)
    out = col(value).try_cast(kind)
    return out.alias(name) if name else out


def money(value, name: str | None = None) -> Column:
    return cast(value, "decimal(18,2)", name)


def quantity(value, name: str | None = None) -> Column:
    return cast(value, "decimal(18,3)", name)


def null(kind: str, name: str) -> Column:
    return F.lit(None).cast(kind).alias(name)


def lineage(system: str, table: str, key) -> list[Column]:
    return [F.lit(system).alias("source_system"), F.lit(table).alias("source_table"),
            col(key).cast("string").alias("source_primary_key")]


# -- codes and classes -------------------------------------------------------------------

def coded(value, mapping: dict[str, str], default: Column | str | None) -> Column:
    """Translate a code; anything not in the mapping gets the default."""
    out, value = None, col(value)
    for code, meaning in mapping.items():
        out = F.when(value == code, meaning) if out is None else out.when(value == code, meaning)
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


def region_of(country) -> Column:
    out, country = None, col(country)
    for region, members in fixed.REGION_COUNTRIES.items():
        test = country.isin(members)
        out = F.when(test, region) if out is None else out.when(test, region)
    return out.otherwise(fixed.OTHER_REGION)


def segment_of_company(company) -> Column:
    codes = {company_code: code for code, _, company_code, _ in fixed.SEGMENTS if company_code}
    return coded(company, codes, "OTHER")


def known_segment(segment) -> Column:
    codes = {code: code for code, _, company_code, _ in fixed.SEGMENTS if company_code}
    return coded(segment, codes, "OTHER")


def request_status(code) -> Column:
    return coded(code, fixed.REQUEST_STATUS, F.lower(col(code)))


def direct_or_indirect(account_type) -> Column:
    """Direct if the account bears cost of goods; an unknown account is Indirect."""
    return F.when(col(account_type) == "COGS", "Direct").otherwise("Indirect")


def addressability(regulated) -> Column:
    return F.when(F.coalesce(col(regulated), F.lit(False)), "Non-Addressable").otherwise("Addressable")


def bucket(value, bounds: list[tuple[float, str]], rest: str) -> Column:
    out, value = None, col(value)
    for upper, label in bounds:
        out = F.when(value < upper, label) if out is None else out.when(value < upper, label)
    return out.otherwise(rest)


def or_missing(value) -> Column:
    return F.coalesce(col(value).cast("string"), F.lit(fixed.MISSING))


def is_managed(confidence, threshold: float = fixed.MANAGED_CONFIDENCE) -> Column:
    return F.coalesce(col(confidence) >= threshold, F.lit(False))


# -- dates and periods -------------------------------------------------------------------

def fiscal(date) -> list[Column]:
    date = cast(date, "date")
    return [F.year(date).alias("fiscal_year"), F.quarter(date).alias("fiscal_quarter")]


def period_key(year="fiscal_year", quarter="fiscal_quarter") -> Column:
    return col(year) * 10 + col(quarter)


def quarter_label(year="fiscal_year", quarter="fiscal_quarter") -> Column:
    return F.concat(col(year).cast("string"), F.lit("Q"), col(quarter).cast("string"))


def quarter_start(year="fiscal_year", quarter="fiscal_quarter") -> Column:
    return F.make_date(col(year), col(quarter) * 3 - 2, F.lit(1))


def quarter_end(year="fiscal_year", quarter="fiscal_quarter") -> Column:
    return F.last_day(F.make_date(col(year), col(quarter) * 3, F.lit(1)))


def month_name(date) -> Column:
    return F.date_format(col(date), "yyyy-MM")


def due_date(invoice_date, terms) -> Column:
    """Invoice date plus the days its payment terms allow; unknown terms give NULL."""
    days = {term: str(count) for term, count in fixed.PAYMENT_TERMS_DAYS.items()}
    return F.date_add(col(invoice_date), coded(terms, days, F.lit(None)).cast("int"))


def paid_on_time(payment_date, due) -> Column:
    """Three-valued: NULL while unpaid."""
    return F.when(col(payment_date).isNull(), None).otherwise(
        F.coalesce(col(payment_date) <= col(due), F.lit(False)))


def days_to_pay(payment_date, invoice_date) -> Column:
    return F.datediff(col(payment_date), col(invoice_date))


def file_quarter(path) -> Column:
    """The YYYYQq label in the name of a landing file, or of a folder of files that stands for one."""
    return F.regexp_extract(col(path), r"(\d{4}Q[1-4])\.[a-z]+(?:/[^/]*)?$", 1)


# -- numbers -----------------------------------------------------------------------------

def exact_sum(value) -> Column:
    """Order-independent sum of money."""
    return F.sum(col(value)).cast("decimal(28,2)")


def total(value, unit: float = MILLION, digits: int = 2) -> Column:
    """Aggregate: a money sum shown in millions (or another unit)."""
    return F.round(F.sum(col(value)).cast("double") / unit, digits)


def in_units(value, unit: float = MILLION, digits: int = 2) -> Column:
    return F.round(col(value).cast("double") / unit, digits)


def mean(value) -> Column:
    """Aggregate: average through an exact decimal sum, so it does not depend on row order."""
    value = col(value)
    return F.sum(value.cast("decimal(24,6)")).cast("double") / F.nullif(F.count(value), F.lit(0))


def ratio(part, whole) -> Column:
    """part / whole as double; NULL where whole is 0 or NULL."""
    return col(part).cast("double") / F.nullif(col(whole).cast("double"), F.lit(0.0))


def percent(part, whole, digits: int = 1) -> Column:
    return F.round(100.0 * ratio(part, whole), digits)


def log_amount(value) -> Column:
    return F.log1p(F.greatest(col(value).cast("double"), F.lit(0.0)))


def overall_rating(on_time, quality, responsiveness) -> Column:
    return F.round((col(on_time) / 20 + col(quality) + col(responsiveness)) / 3, 2)


def code_list(json_text) -> Column:
    """A JSON array of codes, as the supplier master stores secondary categories."""
    return F.from_json(col(json_text), "array<string>")


def text_key(value) -> Column:
    return F.sha2(col(value), 256)


def hash_percent(key) -> Column:
    """0..99 from the key alone: the same row lands in the same split under any partitioning."""
    head = F.substring(F.md5(col(key).cast("string")), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % 100
