"""Dates out of text, repaired dates, classes of dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import col

#: Spanish month names.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
#: Spanish numbers of days.
DAYS = ("uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce", "quince", "dieciséis", "diecisiete", "dieciocho", "diecinueve", "veinte", "veintiuno", "veintidós", "veintitrés", "veinticuatro", "veinticinco", "veintiséis", "veintisiete", "veintiocho", "veintinueve", "treinta", "treinta y uno")
_MONTH = "|".join(MONTHS)
_SHORT = "|".join(m[:3] for m in MONTHS)
#: Spanish numbers of tens and hundreds.
TENS = {"treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90}
HUNDREDS = {"cien": 100, "ciento": 100, "doscientos": 200, "trescientos": 300, "cuatrocientos": 400, "quinientos": 500, "seiscientos": 600, "setecientos": 700, "ochocientos": 800, "novecientos": 900}


def _number(names: tuple[str, ...], name: Column) -> Column:
    return F.create_map(*[F.lit(x) for i, n in enumerate(names, 1) for x in (n, i)])[F.lower(name)]


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%s-%s-%s", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def full_date(c: Column | str) -> Column:
    """The first whole date of a text by kind: ISO, day/month/year or day-month-year, d de mes de año; else null."""
    c = col(c)
    part = lambda pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    iso, dmy = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b"
    long = rf"(?iu)\b(\d{{1,2}}) de ({_MONTH}) (?:de|del) (\d{{4}})\b"
    return F.coalesce(
        _date(part(iso, 1), part(iso, 2), part(iso, 3)), _date(part(dmy, 3), part(dmy, 2), part(dmy, 1)),
        _date(part(long, 3), _number(MONTHS, part(long, 2)), part(long, 1)),
    )


def partial_date(c: Column | str) -> Column:
    """Dates with short months (d-mmm-año), and the first day of año-mes and mes de año; else null."""
    c = col(c)
    part = lambda pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    short = rf"(?iu)\b(\d{{1,2}})[/ -]({_SHORT})\.?[/ -](\d{{4}})\b"
    year_month, month = r"\b(\d{4})-(\d{2})\b(?!-)", rf"(?iu)(?<!\d de )\b({_MONTH}) (?:de|del) (\d{{4}})\b"
    return F.coalesce(
        _date(part(short, 3), _number(tuple(m[:3] for m in MONTHS), part(short, 2)), part(short, 1)),
        _date(part(year_month, 1), part(year_month, 2), F.lit("1")), _date(part(month, 2), _number(MONTHS, part(month, 1)), F.lit("1")),
    )


def parse_date(c: Column | str) -> Column:
    """The first date of a text, whole ones before partial ones; else null."""
    return F.coalesce(full_date(c), partial_date(c))


def written_year(c: Column | str) -> Column:
    """The number of a year in words, from mil on (dos mil dieciocho); else null."""
    words = F.split(F.lower(F.trim(col(c))), " y | ")
    value = F.create_map(*[F.lit(x) for pair in (*((n, i) for i, n in enumerate(DAYS[:29], 1)), *TENS.items(), *HUNDREDS.items()) for x in pair])

    def add(a: Column, w: Column) -> Column:
        thousand = F.struct(F.lit(0).alias("below"), (F.greatest(a["below"], F.lit(1)) * 1000).alias("total"))
        more = F.struct((a["below"] + F.try_element_at(value, w)).alias("below"), a["total"].alias("total"))
        return F.when(w == "mil", thousand).otherwise(more)

    zero = F.struct(F.lit(0).alias("below"), F.lit(0).alias("total"))
    found = F.aggregate(words, zero, add, lambda a: a["total"] + a["below"])
    return F.when(found.between(1000, 2999), found)


def written_date(c: Column | str) -> Column:
    """Day, month and year in words: cinco de mayo de dos mil veinte; else null."""
    c = col(c)
    shape = rf"(?iuU)^\s*([\w ]+?) de ({_MONTH}) (?:de|del) ([\w ]+?)\s*$"
    part = lambda i: F.nullif(F.regexp_extract(c, shape, i), F.lit(""))
    return _date(written_year(part(3)), _number(MONTHS, part(2)), written_day(part(1)))


def written_day(c: Column | str) -> Column:
    """The number of a day in words; else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(DAYS, 1) for x in (n, i)]), F.lower(F.trim(col(c))))


def plausible(day: Column | str, now: str, first: str = "1990-01-01") -> Column:
    """From first to the end of the year after now."""
    return col(day).between(F.lit(first).cast("date"), F.make_date(F.year(F.lit(now).cast("date")) + 1, F.lit(12), F.lit(31)))


def repaired_year(day: Column | str) -> Column:
    """Years 1940 to 1955 are 70 too early; from 2100 the first 8 of a year stands for a 0."""
    d = col(day)
    y = F.year(d)
    late = F.regexp_replace(y.cast("string"), "^([^8]*)8", "$10").cast("int")
    year = F.when(y.between(1940, 1955), y + 70).when(y >= 2100, late).otherwise(y)
    return F.add_months(d, 12 * (year - y))


def date_class(context: Column | str) -> Column:
    """What a date is about by the words around it, the first class that fits."""
    c = col(context)
    return (
        F.when(c.rlike(r"(?iuU)\b(hechos|ocurri\w*|sucedi\w*)\b"), "facts").when(c.rlike(r"(?iuU)\b(ministerio|fiscal\w*)\b"), "prosecution")
        .when(c.rlike(r"(?iuU)\b(audiencia|juez|jueza)\b"), "hearing").when(c.rlike(r"(?iuU)\bdeclar\w*"), "statement").otherwise("general")
    )
