"""Typed entities out of page texts. Patterns are parameters; the defaults are this library's own small ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import dates as D
from foliospark.functions import text as T
from foliospark.operators import classify, likeness

#: Three, three and four digits; two, four and four; an area code in brackets. Each with or without a blank or hyphen between its parts, and no digit beside it.
PHONES = (r"(?<!\d)\d{3}[ -]?\d{3}[ -]?\d{4}(?!\d)", r"(?<!\d)\d{2}[ -]?\d{4}[ -]?\d{4}(?!\d)", r"\(\d{3}\)[ -]?\d{3}[ -]?\d{4}(?!\d)")
LETTERS = (r"(?iu)\boficio\s+(?:n[uú]mero\s+|no\.?\s*)?([A-Z0-9][A-Z0-9/-]{2,})", r"\b([A-Z]{2,5}/\d{2,6}/\d{4})\b")
NAME = r"\b\p{Lu}\p{Ll}+(?: (?:de |del |la )*\p{Lu}\p{Ll}+){1,4}\b"
PLACES = {
    "street": r"(?iu)\b(?:calle|avenida|calzada)\s+[\p{L} ]{3,40}?\s+(?:n[uú]mero\s+)?\d+", "area": r"(?iu)\bcolonia\s+[\p{L} ]{3,30}",
    "crossing": r"\b[Ee]squina (?:con )?\p{Lu}\p{L}+", "postal": r"\bC\.?P\.? ?\d{5}\b",
}
DATES = {"numeric": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b", "iso": r"\b\d{4}-\d{2}-\d{2}\b", "long": rf"(?iu)\b\d{{1,2}} de (?:{'|'.join(D.MONTHS)}) (?:de|del) \d{{4}}\b", "short": rf"(?iu)\b\d{{1,2}}[/-](?:{'|'.join(m[:3] for m in D.MONTHS)})\.?[/-]\d{{4}}\b", "month": rf"(?iu)(?<!\d de )\b(?:{'|'.join(D.MONTHS)}) (?:de|del) \d{{4}}\b"}
PROCEEDINGS = {"interview": r"(?iu)\bentrevista\b", "inspection": r"(?iu)\binspecci[oó]n\b", "statement": r"(?iu)\bdeclaraci[oó]n\b", "letter": r"(?iu)\boficio\b", "hearing": r"(?iu)\baudiencia\b"}
ROLES = (("victim", r"(?iu)v[ií]ctima"), ("accused", r"(?iu)imputad[oa]|acusad[oa]"), ("witness", r"(?iu)testigo"), ("officer", r"(?iu)agente|polic[ií]a"))


def first_fit(c: Column, classes: tuple[tuple[str, str], ...], otherwise: str | None = None) -> Column:
    """The name of the first pattern that fits."""
    out = F.lit(otherwise)
    for name, pattern in reversed(classes):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def all_matches(text: Column | str, patterns: tuple[str, ...], group: int = 0) -> Column:
    """Distinct matches of several patterns, pattern by pattern, in order of the text."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(T.col(text), F.lit(p), F.lit(group)) for p in patterns])))


def phones(text: Column | str) -> Column:
    """array<string> of distinct numbers of ten digits."""
    digits = F.transform(all_matches(text, PHONES), lambda x: F.regexp_replace(x, r"\D", ""))
    return F.array_distinct(F.filter(digits, lambda x: F.length(x) == 10))


def letter_numbers(text: Column | str) -> Column:
    return all_matches(text, LETTERS, 1)


def spans(pages: DataFrame, patterns: dict[str, str], around: int = 100, keep: tuple[str, ...] = ("page_id",), text: str = "text") -> DataFrame:
    """keep, kind, match, position (from 0), context: a row for each match of each pattern.

    Marks around the matches cut the text into pieces, whose lengths give the positions: one pass per pattern, in
    the JVM, and only over texts that it fits. The marks are two control characters, for which a text that has them gets blanks.
    """
    body = F.translate(text, "\x01\x02", "  ")
    placed = _once(body, lambda b: F.flatten(F.array(*[_placed(b, kind, p) for kind, p in patterns.items()])))
    rows = pages.select(*keep, text, F.inline(placed))
    lo = F.greatest(F.col("at") - around, F.lit(0))
    return rows.select(*keep, "kind", F.col("m").alias("match"), F.col("at").alias("position"), F.substring(F.col(text), lo + 1, F.col("at") + F.length("m") + around - lo).alias("context"))


def _once(value: Column, use) -> Column:
    """The array that use makes of value, which is evaluated once however often use names it: functions of lambdas share no subexpressions."""
    return F.flatten(F.transform(F.array(value), use))


def _placed(body: Column, kind: str, pattern: str) -> Column:
    """array<struct<kind, m, at>> of the matches."""
    none = F.array().cast("array<struct<kind:string,m:string,at:int>>")

    def place(a: Column, x: Column) -> Column:
        found = F.struct(F.lit(kind).alias("kind"), F.substring_index(x, "\x02", 1).alias("m"), a["at"].alias("at"))
        return F.struct((a["at"] + F.length(x) - 1).alias("at"), F.concat(a["all"], F.array(found)).alias("all"))

    def every(pieces: Column) -> Column:
        zero = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), none.alias("all"))
        return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), zero, place, lambda a: a["all"])

    marked = F.split(F.regexp_replace(body, pattern, "\x01$0\x02"), "\x01", -1)
    return F.when(body.rlike(pattern), _once(marked, every)).otherwise(none)


#: Kinds of proceedings, and of what a reader is to look after, by words that name them.
ACTS = {
    "interview": r"entrevistas?", "inspection": r"inspecci(?:[oó]n|ones)", "statement": r"declaraci(?:[oó]n|ones)", "letter": r"oficios?", "hearing": r"audiencias?", "report": r"informes?|dict[aá]men(?:es)?",
    "summons": r"citatorios?|citaci(?:[oó]n|ones)", "notification": r"notificaci(?:[oó]n|ones)", "search": r"cateos?", "arrest": r"detenci(?:[oó]n|ones)|aprehensi(?:[oó]n|ones)", "complaint": r"denuncias?|querellas?",
    "appearance": r"comparecencias?", "certificate": r"constancias?|certificaci(?:[oó]n|ones)", "custody": r"cadenas? de custodia", "agreement": r"acuerdos?",
}
ALERTS = {
    "pending": r"pendientes?|por desahogar|falta(?:n)? recabar", "unserved": r"no (?:se )?(?:pudo|fue posible) notificar|sin notificar", "overdue": r"fuera de plazo|plazo vencido|vencid[oa]s?",
    "missing": r"no constan?|sin (?:oficio|firma|sello|respuesta)",
}


def worded(pages: DataFrame, kinds: dict[str, str], around: int = 100, keep: tuple[str, ...] = ("page_id",), text: str = "text") -> DataFrame:
    """spans() of whole words in any case, with one pass for all kinds: where two begin at one place the first kind has it, and none lie within another."""
    both = rf"(?iu)\b(?:{'|'.join(kinds.values())})\b"
    found = spans(pages, {"word": both}, around, keep, text)
    exact = tuple((k, rf"(?iu)^(?:{p})$") for k, p in kinds.items())
    return found.withColumn("kind", first_fit(F.col("match"), exact))


def alerts_in_text(pages: DataFrame, kinds: dict[str, str] = ALERTS, text: str = "text") -> DataFrame:
    """page_id, alert, n, first: how often a page's text gives reason for an alert, and the words of the first one."""
    found = worded(pages, kinds, 0, text=text)
    return found.groupBy("page_id", F.col("kind").alias("alert")).agg(F.count("*").alias("n"), F.min_by("match", "position").alias("first"))


def scanned_lines(books: DataFrame, kinds: dict[str, str] = ACTS, marker: str = r"(?iu)^\W*p[aá]g(?:ina|\.)?\s+(\d+)", around: int = 5, text: str = "text") -> DataFrame:
    """book, page, line_no, kind, line, context: the first line of each kind on each page of a book (book, text), in one pass over its lines.

    A line that the marker fits says which page the lines from there on are of; null before the first. A line is of the first kind whose word it has. context
    are the lines up to around before and after it. A book is one row, as its text is.
    """
    any_ = rf"(?iu)\b(?:{'|'.join(kinds.values())})\b"
    whole = tuple((k, rf"(?iu)\b(?:{p})\b") for k, p in kinds.items())
    lines_ = books.select("book", F.split(text, "\n", -1).alias("ls"))
    page = lambda x: F.nullif(F.regexp_extract(x, marker, 1), F.lit(""))
    marks = F.transform("ls", lambda x, i: F.struct(i.alias("i"), page(x).alias("page"), x.rlike(any_).alias("hit")))
    told = lines_.select("book", "ls", F.inline(F.filter(marks, lambda m: m["hit"] | m["page"].isNotNull())))
    last = F.last("page", True).over(Window.partitionBy("book").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    low = F.greatest(F.col("i") - around, F.lit(0))
    near = F.array_join(F.slice("ls", low + 1, F.least(F.col("i") + around + 1, F.size("ls")) - low), "\n")
    rows = told.select("book", "i", "page", "hit", F.when(F.col("hit"), F.get("ls", F.col("i"))).alias("line"), F.when(F.col("hit"), near).alias("context"))
    found = rows.withColumn("page", last.cast("long")).where("hit").withColumn("kind", first_fit(F.col("line"), whole))
    first = F.row_number().over(Window.partitionBy("book", "page", "kind").orderBy("i"))
    return found.withColumn("k", first).where("k = 1").select("book", "page", F.col("i").alias("line_no"), "kind", "line", "context")


def dated(pages: DataFrame, now: str, **options) -> DataFrame:
    """spans of dates with day and class, where the day is plausible."""
    found = spans(pages, DATES, **options)
    day = D.parse_date("match")
    return found.withColumns({"day": day, "date_class": D.date_class("context")}).where(D.plausible("day", now))


def places(pages: DataFrame, **options) -> DataFrame:
    """spans of places, trimmed, without those that place_fault() rejects."""
    found = spans(pages, PLACES, **options).withColumn("match", F.trim("match"))
    return found.where(F.col("kind").isin("crossing", "postal") | classify.place_fault("match").isNull())


def persons(pages: DataFrame, around: int = 100, **options) -> DataFrame:
    """Names of two to five capitalised words that name_fault() lets pass, once per page: name, position, and role, age,
    phone and street near them."""
    found = spans(pages, {"person": NAME}, around, **options).where(classify.name_fault("match").isNull())
    first = F.row_number().over(Window.partitionBy("page_id", T.name_key("match")).orderBy("position"))
    part = lambda p, g=0: F.nullif(F.regexp_extract("context", p, g), F.lit(""))
    return found.withColumn("k", first).where("k = 1").select(
        "page_id", F.col("match").alias("name"), "position", first_fit(F.col("context"), ROLES, "mentioned").alias("role"),
        F.get(phones("context"), F.lit(0)).alias("phone"), part(PLACES["street"]).alias("street"), part(r"(?iu)\b(\d{1,2}) años\b", 1).cast("int").alias("age"),
    )


_PERSON = r"(\p{Lu}\p{Ll}+(?: (?:de |del |la |las |los )*\p{Lu}\p{Ll}+)+)"
#: Titles are told in either case of their first letter, names by their capitals.
RESPONSIBLE = (
    rf"\b(?:[Aa]gente|[Ll]icenciad[oa]|[Ll]ic\.) {_PERSON}", rf"\b[Tt]itular,? (?:[Ll]icenciad[oa] |[Ll]ic\. )?{_PERSON}",
    rf"\b[Aa]nte (?:el|la) (?:[Jj]ueza?|[Ff]iscal|[Ss]ecretari[oa]) {_PERSON}",
)


def responsible(text: str) -> Column:
    """Who answers for a page: of the patterns' first finds the first that is the name of a person; null without one."""
    found = F.array(*[F.regexp_extract(text, p, 1) for p in RESPONSIBLE])
    return F.get(F.filter(found, lambda x: (x != "") & classify.name_fault(x).isNull()), F.lit(0))


def candidates(pages: DataFrame) -> DataFrame:
    """page_id, value: what may be a person or an area, each once a page."""
    names = persons(pages).select("page_id", F.col("name").alias("value"))
    areas = spans(pages, {"area": PLACES["area"]}).select("page_id", F.trim("match").alias("value"))
    return names.unionByName(areas).distinct()


def entities(pages: DataFrame) -> DataFrame:
    """page_id, kind, match, position of dates, places and persons, each find once."""
    own = lambda df, kind: df.select("page_id", F.lit(kind).alias("kind"), "match", "position")
    names = persons(pages).withColumnRenamed("name", "match")
    found = own(spans(pages, DATES), "date").unionByName(places(pages).select("page_id", "kind", "match", "position")).unionByName(own(names, "person"))
    return found.distinct()


def distinct_entities(found: DataFrame, least: float = 0.78) -> DataFrame:
    """found (page_id, kind, match, position) without those of a page and kind that are like a longer one, with a ratio of least, or a part of it."""
    placed = found.withColumns({"_of": F.to_json(F.struct("page_id", "kind")), "_at": F.col("position").cast("long") * (1 << 20) + F.length("match")})
    return likeness.greedy(placed, "_of", "match", "_at", likeness.ratcliff(least), longest_first=True).drop("_of", "_at")


def entity_summary(found: DataFrame) -> DataFrame:
    """page_id, n, summary of a page's entities: kinds in order of the alphabet, each with its finds in order of the text."""
    each = found.groupBy("page_id", "kind").agg(F.sort_array(F.collect_list(F.struct("position", "match")))["match"].alias("found"))
    line = F.struct("kind", F.concat_ws(": ", "kind", F.array_join("found", ", ")).alias("line"))
    return each.groupBy("page_id").agg(F.sum(F.size("found")).alias("n"), F.array_join(F.sort_array(F.collect_list(line))["line"], "; ").alias("summary"))


def page_entities(pages: DataFrame) -> DataFrame:
    """page_id, kind, match of the six categories of a page: date, proceeding, person, place, phone, letter."""
    own = lambda df, kind: df.select("page_id", F.lit(kind).alias("kind"), "match")
    lists = F.array(F.struct(F.lit("phone").alias("kind"), phones("text").alias("found")), F.struct(F.lit("letter").alias("kind"), letter_numbers("text").alias("found")))
    out = own(spans(pages, DATES), "date").unionByName(own(spans(pages, PROCEEDINGS), "proceeding")).unionByName(own(places(pages), "place"))
    out = out.unionByName(own(persons(pages).withColumnRenamed("name", "match"), "person"))
    return out.unionByName(pages.select("page_id", F.inline(lists)).select("page_id", "kind", F.explode("found").alias("match")))


ELEMENTS = {"officer": r"\b(?:[Aa]gente|[Ll]icenciad[oa])\s+(\p{Lu}\p{Ll}+)", "holder": r"(?iu)\btitular\s+(\p{L}+)", "letter": LETTERS[1], "date": DATES["numeric"], "name": NAME, "proceeding": "|".join(PROCEEDINGS.values())}
WEIGHTS = {"officer": 2.0, "holder": 2.0, "letter": 1.0, "date": 2.0, "name": 1.0, "proceeding": 1.0}


def paragraphs(pages: DataFrame, least: int = 100, most: int = 3000, text: str = "text") -> DataFrame:
    """page_id, place, paragraph of that many characters, squeezed."""
    each = pages.select("page_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("place", "p"))
    return each.select("page_id", "place", T.squeeze("p").alias("paragraph")).where(F.length("paragraph").between(least, most))


def scored_paragraphs(pages: DataFrame, keywords: tuple[str, ...] = (), least: int = 2, **options) -> DataFrame:
    """Paragraphs with the weights of the elements they have and half a point for each keyword, from least points on."""
    points = sum((F.when(F.col("paragraph").rlike(p), WEIGHTS[e]).otherwise(0.0) for e, p in ELEMENTS.items()), F.lit(0.0))
    points = points + sum((F.when(T.contains_ci("paragraph", k), 0.5).otherwise(0.0) for k in keywords), F.lit(0.0))
    return paragraphs(pages, **options).withColumn("relevance", points.cast("int")).where(F.col("relevance") >= least).withColumns({"confidence": F.least(F.lit(1.0), F.col("relevance") / 10), "summary": T.ellipsis("paragraph", 200)})


def lines(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.select("page_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def line_contexts(pages: DataFrame, around: int = 2, text: str = "text") -> DataFrame:
    """Each line with the lines up to around before and after it."""
    all_ = pages.select("page_id", F.split(text, "\n", -1).alias("ls"))
    near = lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.array_join(F.slice(F.col("ls"), F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)) + around + 1), "\n").alias("context"))
    return all_.select("page_id", F.inline(F.transform("ls", near)))


def head_lines(text: str, n: int = 50) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, n), "\n")


def cell_kinds(cells: DataFrame, value: str = "value") -> DataFrame:
    """cells and the kind of their value: date, phone, number, name, text or empty."""
    v = F.trim(value)
    kind = F.when(F.col(value).isNull() | (v == ""), "empty").when(D.parse_date(v).isNotNull(), "date").when(F.size(phones(v)) > 0, "phone").when(v.rlike(r"^[\d.,]+$"), "number").when(v.rlike(f"^(?:{NAME})$"), "name").otherwise("text")
    return cells.withColumn("kind", kind)


#: Names that are given besides a first one, in lower case and without marks.
GIVEN = ("maria", "luisa", "luis", "jose", "juan", "carlos", "ana", "antonio", "manuel", "guadalupe", "teresa", "isabel", "elena", "alberto", "angel", "jesus", "miguel", "fernanda")


def name_parts(name: str) -> list[Column]:
    """First names, and paternal and maternal name. Particles (de, del, la, las, los) belong to the word after them.

    Of four words or more the last two are family names. Of three the second is one too, unless GIVEN has it; so of two.
    """
    joined = F.regexp_replace(F.col(name), r"(?iu)\b(de|del|la|las|los)\s+(?=\S)", "$1\u0001")
    w = T.tokens(joined)
    n = F.size(w)
    second = F.coalesce(F.lower(T.fold(F.get(w, F.lit(1)))).isin(*GIVEN), F.lit(False))
    given = F.when(n >= 4, n - 2).when((n == 3) & second, 2).otherwise(F.least(n, F.lit(1)))
    spaced = lambda c: F.replace(c, F.lit("\u0001"), F.lit(" "))
    return [
        spaced(F.array_join(F.slice(w, F.lit(1), given), " ")).alias("given"), spaced(F.get(w, given)).alias("paternal"), spaced(F.get(w, given + 1)).alias("maternal"),
    ]


def address_parts(c: str) -> list[Column]:
    part = lambda p, g=1: F.nullif(F.trim(F.regexp_extract(c, p, g)), F.lit(""))
    return [
        part(r"(?iu)\b(calle|avenida|calzada)\b").alias("road_type"), part(r"(?iu)\b(?:calle|avenida|calzada)\s+([\p{L} ]+?)\s+(?:n[uú]mero\s+)?\d").alias("road"),
        part(r"(?iu)\b(?:calle|avenida|calzada)\s+[\p{L} ]+?\s+(?:n[uú]mero\s+)?(\d+)").alias("number"), part(r"(?iu)\bcolonia\s+([\p{L} ]+)").alias("area"), part(r"\b(\d{5})\b").alias("postal_code"),
    ]


def page_alerts(counts: DataFrame) -> DataFrame:
    """page_id, alert for pages with many names, minors or many proceedings. counts: n_names, n_minors, n_proceedings."""
    found = F.array_compact(F.array(F.when(F.col("n_names") > 10, "many names"), F.when(F.col("n_minors") > 0, "minors"), F.when(F.col("n_proceedings") > 5, "many proceedings")))
    return counts.select("page_id", F.explode(found).alias("alert"))


def matched_in_order(wanting: DataFrame, spare: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """The k-th row of a group that lacks a value gets the k-th spare value of the group."""
    k = lambda df: df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return k(wanting).join(k(spare).select(group, "_k", value), [group, "_k"], "left").drop("_k")
