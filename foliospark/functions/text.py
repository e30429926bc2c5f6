"""Text expressions over Columns; all of them run in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the letters below them.
MARKED = "áéíóúàèìòùäëïöüâêîôûñçÁÉÍÓÚÀÈÌÒÙÄËÏÖÜÂÊÎÔÛÑÇ"
PLAIN = "aeiouaeiouaeiouaeiouncAEIOUAEIOUAEIOUAEIOUNC"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_ci(text: Column | str, term: str) -> Column:
    return F.contains(F.lower(col(text)), F.lit(term.lower()))


def like_ci(text: Column | str, term: str) -> Column:
    """The term may hold the wildcards % and _."""
    return col(text).ilike(f"%{term}%")


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def boolean_match(text: Column | str, terms: list[str], operator: str = "AND", phrase: str | None = None, without: tuple[str, ...] = ()) -> Column:
    """Terms joined by AND or OR, and the exact phrase, and none of the excluded words; case-blind."""
    if operator not in ("AND", "OR"):
        raise ValueError("operator is AND or OR")
    found = [contains_ci(text, t) for t in terms]
    base = (all_of if operator == "AND" else any_of)(found) if found else F.lit(True)
    rest = [contains_ci(text, phrase)] if phrase else []
    return all_of([base, *rest, *[~contains_ci(text, w) for w in without]])


def whole_word(text: Column | str, word: str) -> Column:
    return col(text).rlike(rf"(?iuU)\b\Q{word}\E\b")


def snippet(text: Column | str, term: str, around: int = 100, head: int = 200) -> Column:
    """around characters on both sides of the first hit, with dots where cut; without a hit the first head characters."""
    t = col(text)
    at = F.locate(term.lower(), F.lower(t))
    start, end = F.greatest(at - 1 - around, F.lit(0)), F.least(at - 1 + len(term) + around, F.length(t))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(t, start + 1, end - start), F.when(end < F.length(t), "...").otherwise(""))
    first = F.concat(F.substring(t, 1, head), F.when(F.length(t) > head, "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(first)


def positions(text: Column | str, term: str) -> Column:
    """array<int>: offsets from 0 of all occurrences, overlapping ones too, in the lower-cased text.

    Split pieces give the places of separate hits in time linear in the text; a term that can overlap itself
    is looked for at each place instead.
    """
    low, q = F.lower(col(text)), term.lower()
    overlaps = any(q.startswith(q[i:]) for i in range(1, len(q)))
    if overlaps:
        marked = F.regexp_replace(low, rf"(?=\Q{q}\E)", "\x00")
        pieces = F.split(marked, "\x00", -1)
        step = 0
    else:
        pieces, step = F.split(low, rf"\Q{q}\E", -1), len(q)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    heads = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.aggregate(
        heads, zero,
        lambda a, p: F.struct((a["at"] + F.length(p) + step).alias("at"), F.concat(a["all"], F.array(a["at"] + F.length(p))).alias("all")),
        lambda a: a["all"],
    )


def count_hits(text: Column | str, term: str) -> Column:
    return F.regexp_count(F.lower(col(text)), F.lit(rf"\Q{term.lower()}\E"))


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def fold(c: Column | str) -> Column:
    """Without marks on letters."""
    return F.translate(col(c), MARKED, PLAIN)


def name_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.upper(fold(c)), "[^A-Z ]", ""))


def ellipsis(c: Column | str, most: int) -> Column:
    c = col(c)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("..."))).otherwise(c)


def first_sentence(c: Column | str, least: int = 30) -> Column:
    return F.get(F.filter(F.split(col(c), r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) >= least), F.lit(0))


def tokens(c: Column | str, pattern: str = r"\s+") -> Column:
    return F.filter(F.split(col(c), pattern), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(tokens(c))


def char_share(c: Column | str, allowed: str) -> Column:
    """Share of the characters in the class, 0 for an empty text."""
    c = col(c)
    return F.when(F.length(c) == 0, 0.0).otherwise(F.length(F.regexp_replace(c, f"[^{allowed}]", "")) / F.length(c))


def unhyphenated(c: Column | str) -> Column:
    """Words cut at line ends are joined, runs of blank lines become one."""
    joined = F.regexp_replace(col(c), r"(\p{L})-\n(\p{L})", "$1$2")
    return F.regexp_replace(joined, r"\n{3,}", "\n\n")


def without_controls(c: Column | str) -> Column:
    """Control characters go, line ends and tabs stay."""
    return F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def legible_lines(c: Column | str, share: float = 0.4) -> Column:
    """Drops lines that are mostly symbols and have fewer than two words."""
    def keep(line: Column) -> Column:
        words = F.size(F.filter(F.split(line, r"\s+"), lambda w: w.rlike(r"\p{L}{2,}")))
        return (F.trim(line) == "") | (words >= 2) | ((char_share(line, r"\p{L}\p{N} ") >= share) & ((F.length(F.trim(line)) > 8) | (words >= 1)))

    return F.array_join(F.filter(F.split(col(c), "\n", -1), keep), "\n")


def rules(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Regular expressions replaced one after the other."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), pairs, col(c))


def digits_to_letters(c: Column | str) -> Column:
    """Digits that stand between letters become the letters they look like."""
    for digit, letter in (("0", "o"), ("1", "l"), ("5", "s")):
        c = F.regexp_replace(col(c), rf"(?<=\p{{L}}){digit}(?=\p{{L}})", letter)
    return c


def changed_words(a: Column | str, b: Column | str) -> Column:
    """Places at which the words of two texts differ; a missing word differs."""
    return F.size(F.filter(F.zip_with(tokens(a), tokens(b), lambda x, y: ~x.eqNullSafe(y)), lambda x: x))


def browser_label(agent: Column) -> Column:
    """Browser (system) of a user agent. Browsers that name others too are looked for first."""
    browser = F.when(agent.contains("Edg"), "Edge").when(agent.contains("Chrome"), "Chrome").when(agent.contains("Firefox"), "Firefox").when(agent.contains("Safari"), "Safari").otherwise("Other")
    system = F.when(agent.contains("Windows"), "Windows").when(agent.contains("Android"), "Android").when(agent.contains("Mac"), "macOS").when(agent.contains("Linux"), "Linux").otherwise("Other")
    return F.when(agent.isNull(), "-").otherwise(F.concat(browser, F.lit(" ("), system, F.lit(")")))


def masked_number(c: Column | str) -> Column:
    """Long case numbers keep their first eight characters."""
    return F.regexp_replace(col(c), r"\b([A-Z0-9]{8})[A-Z0-9/-]{2,}\b", "$1***")


def initials(c: Column | str) -> Column:
    return F.array_join(F.transform(tokens(c), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), "")


def safe_name(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+", "")


def highlighted(c: Column | str, term: str) -> Column:
    return F.regexp_replace(col(c), rf"(?iu)\Q{term}\E", f"**{term}**")


SECRET = ("password", "token", "secret")


def masked_keys(m: Column | str, secret: tuple[str, ...] = SECRET) -> Column:
    """A map with *** for the values of secret keys, whatever their case."""
    return F.transform_values(col(m), lambda k, v: F.when(F.lower(k).isin(*secret), "***").otherwise(v))
