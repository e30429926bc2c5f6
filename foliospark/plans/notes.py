"""Case notes: a page of Spanish text for each order, put together from its columns.

Extraction reads the texts; SQL states the answers from the columns, without patterns, so that it is an oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.dates import MONTHS
from foliospark.sources.catalog import load

GIVEN, PATERNAL, MATERNAL = ("Ana", "Luis", "Marta", "Pedro", "Rosa"), ("Ruiz", "Mora", "Vega", "Soto"), ("Paz", "Lara", "Cruz")
SHORT = tuple(m[:3] for m in MONTHS)
#: Form of a note by the number of the order modulo FORMS; the last one is null.
FORMS = 10


def _pick(words: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), at.cast("int") + 1)


def notes(spark, root: str) -> DataFrame:
    """page_id, folder, text."""
    o = load(spark, root, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("folder"), F.to_date("o_orderdate").alias("day"))
    f, k, day = F.col("folder"), F.col("page_id") % FORMS, F.col("day")
    name = F.concat_ws(" ", _pick(GIVEN, f % 5), _pick(PATERNAL, F.floor(f / 5) % 4), _pick(MATERNAL, F.floor(f / 20) % 3))
    num, digits = (100 + F.col("page_id") % 900).cast("string"), F.lpad(f.cast("string"), 8, "0")
    d, m, y = F.dayofmonth(day).cast("string"), _pick(MONTHS, F.month(day) - 1), F.year(day).cast("string")
    phone = F.concat(F.lit("55"), digits)
    spaced = F.concat(F.lit("55 "), F.substring(digits, 1, 4), F.lit(" "), F.substring(digits, 5, 4))
    code = F.concat(F.lit("06"), F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"))
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = [
        of("El ", d, " de ", m, " de ", y, " la testigo ", name, " rindió declaración; tel. ", spaced, ". Oficio FGJ/", num, "/", y, "."),
        of("Audiencia del ", F.date_format(day, "dd/MM/yyyy"), " ante el juez. Calle Hidalgo número ", num, ", colonia Centro, C.P. ", code, ". El imputado ", name, "."),
        of("Inspección el ", day.cast("string"), " en avenida Juárez ", num, ", esquina con Morelos. Contacto ", phone, " y ", phone, "."),
        of("EXPEDIENTE ", num, " TOMO ", d, " CARPETA 9"), F.lit(""), num,
        of("El 31/02/", y, " no consta la actuación; ", m, " de ", y, " sin oficio."),
        of("Recibido ", d, "-", _pick(SHORT, F.month(day) - 1), "-", y, "; ver art. 5 y exp. ", num, "."),
        of("Periodo ", F.date_format(day, "yyyy-MM"), ", la agente María Luisa de la Vega y la c0lonia R0ma."), F.lit(None).cast("string"),
    ]
    text = forms[-1]
    for i, form in enumerate(forms[:-1]):
        text = F.when(k == i, form).otherwise(text)
    return o.select("page_id", f.cast("string").alias("folder"), text.alias("text"))


def books(spark, root: str) -> DataFrame:
    """book, text: the notes of each folder, a line that numbers the page before each."""
    rows = notes(spark, root).withColumn("n", F.row_number().over(Window.partitionBy("folder").orderBy("page_id")))
    page = F.concat(F.lit("-- Página "), F.col("n").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    parts = F.sort_array(F.collect_list(F.struct("n", page.alias("page"))))["page"]
    return rows.groupBy(F.col("folder").cast("long").alias("book")).agg(F.array_join(parts, "\n").alias("text"))


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: The columns that the notes are made of.
N = f"""(SELECT o_orderkey AS page_id, o_custkey AS folder_id, o_orderkey % {FORMS} AS k, o_orderdate::DATE AS day, (100 + o_orderkey % 900)::VARCHAR AS num,
    {_list(GIVEN)}[o_custkey % 5 + 1] AS given, {_list(PATERNAL)}[(o_custkey // 5) % 4 + 1] AS paternal, {_list(MATERNAL)}[(o_custkey // 20) % 3 + 1] AS maternal,
    '55' || lpad(o_custkey::VARCHAR, 8, '0') AS phone, day(o_orderdate)::VARCHAR AS d, {_list(MONTHS)}[month(o_orderdate)] AS m, {_list(SHORT)}[month(o_orderdate)] AS mmm, year(o_orderdate)::VARCHAR AS y,
    '06' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') AS code FROM orders) n"""
NAME = "given || ' ' || paternal || ' ' || maternal"
LONG_DAY, SHORT_DAY, DMY = "d || ' de ' || m || ' de ' || y", "d || '-' || mmm || '-' || y", "strftime(day, '%d/%m/%Y')"
#: The text itself, from the columns.
TEXT = f"""CASE k WHEN 0 THEN 'El ' || {LONG_DAY} || ' la testigo ' || {NAME} || ' rindió declaración; tel. 55 ' || substr(phone, 3, 4) || ' ' || substr(phone, 7, 4) || '. Oficio FGJ/' || num || '/' || y || '.'
    WHEN 1 THEN 'Audiencia del ' || {DMY} || ' ante el juez. Calle Hidalgo número ' || num || ', colonia Centro, C.P. ' || code || '. El imputado ' || {NAME} || '.'
    WHEN 2 THEN 'Inspección el ' || day::VARCHAR || ' en avenida Juárez ' || num || ', esquina con Morelos. Contacto ' || phone || ' y ' || phone || '.'
    WHEN 3 THEN 'EXPEDIENTE ' || num || ' TOMO ' || d || ' CARPETA 9' WHEN 4 THEN '' WHEN 5 THEN num
    WHEN 6 THEN 'El 31/02/' || y || ' no consta la actuación; ' || m || ' de ' || y || ' sin oficio.'
    WHEN 7 THEN 'Recibido ' || {SHORT_DAY} || '; ver art. 5 y exp. ' || num || '.'
    WHEN 8 THEN 'Periodo ' || strftime(day, '%Y-%m') || ', la agente María Luisa de la Vega y la c0lonia R0ma.' END"""


def union(*parts: tuple[str, str], names: str) -> str:
    """SQL: of the notes of each form (a condition over k) the columns."""
    head = names.split(", ")
    one = lambda cols: ", ".join(f"{c} AS {n}" for c, n in zip(cols, head, strict=True))
    return " UNION ALL ".join(f"SELECT {one(cols)} FROM {N} WHERE {where}" for where, *cols in parts)
