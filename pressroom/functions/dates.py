"""Human-readable article dates (T6), ISO text (T9) and string timestamps.

The reference hands element text to a natural-language date library with
the time zone set to CET and keeps the naive wall-clock result.  Here a date
is recognised by a few regular layouts and a month-name table; everything is
a built-in expression (``regexp_extract`` + ``try_make_timestamp_ntz``), so
unparseable text gives null instead of an error.  Relative dates ("yesterday
10:32", "2 hours ago") are resolved against a time that the caller gives, such
as that of the crawl: ``parse_relative_date``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Month names (lower case, with common abbreviations) of the
# four languages the corpus sites use, mapped to month numbers.
# ---------------------------------------------------------------------------
MONTHS = {
    # Hungarian
    "január": 1, "február": 2, "március": 3, "április": 4, "május": 5, "június": 6,
    "július": 7, "augusztus": 8, "szeptember": 9, "október": 10, "november": 11, "december": 12,
    "jan": 1, "febr": 2, "márc": 3, "ápr": 4, "máj": 5, "jún": 6, "júl": 7, "aug": 8,
    "szept": 9, "okt": 10, "nov": 11, "dec": 12,
    # Czech, genitive (as in dates) and nominative
    "ledna": 1, "února": 2, "března": 3, "dubna": 4, "května": 5, "června": 6,
    "července": 7, "srpna": 8, "září": 9, "října": 10, "listopadu": 11, "prosince": 12,
    "leden": 1, "únor": 2, "březen": 3, "duben": 4, "květen": 5, "červen": 6,
    "červenec": 7, "srpen": 8, "říjen": 10, "listopad": 11, "prosinec": 12,
    # Slovak, genitive and nominative
    "januára": 1, "februára": 2, "marca": 3, "apríla": 4, "mája": 5, "júna": 6,
    "júla": 7, "augusta": 8, "septembra": 9, "októbra": 10, "novembra": 11, "decembra": 12,
    "marec": 3, "apríl": 4, "august": 8,  # máj, jún, júl: as the Hungarian abbreviations
    # English
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "september": 9, "october": 10,
    "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "sep": 9, "sept": 9, "oct": 10,
}
# a few spellings above coincide across languages (e.g. "november"); the map
# keeps one entry per spelling, all with the same month number.

_NAME = r"(\p{L}+)\.?"
# the time of day may follow a weekday, a preposition, a bar or a dash
_TIME = r"(?:[,\s|–—-]+(?:\p{L}+\.?[,\s|–—-]+)?(\d{1,2}):(\d{2})(?::(\d{2}))?)?"
_ORD = r"(?:st|nd|rd|th)?"

# (pattern, group of year, month, day, hour, minute, second, month-is-name)
LAYOUTS = (
    # 2021-07-24T10:32:00, 2021.07.24. 10:32
    (r"(\d{4})[-./]\s*(\d{1,2})[-./]\s*(\d{1,2})\.?[T\s]+(\d{1,2}):(\d{2})(?::(\d{2}))?", (1, 2, 3, 4, 5, 6), False),
    # 2021.07.24., szombat 10:32
    (r"(\d{4})[-./]\s*(\d{1,2})[-./]\s*(\d{1,2})\.?" + _TIME, (1, 2, 3, 4, 5, 6), False),
    # 2021. július 24. 10:32 (Hungarian)
    (r"(\d{4})\.?\s+" + _NAME + r"\s*(\d{1,2})\.?" + _TIME, (1, 2, 3, 4, 5, 6), True),
    # 24. července 2021 10:32 / 24 July 2021 (Czech, Slovak, English)
    (r"(\d{1,2})" + _ORD + r"\.?\s+(?:of\s+)?" + _NAME + r",?\s+(\d{4})\.?" + _TIME, (3, 2, 1, 4, 5, 6), True),
    # July 24, 2021 10:32 (English)
    (_NAME + r"\s+(\d{1,2})" + _ORD + r",?\s+(\d{4})" + _TIME, (3, 1, 2, 4, 5, 6), True),
    # 24. 7. 2021 10:32 / 24.07.2021 / 24/07/2021 (day first, numeric)
    (r"(\d{1,2})[./]\s*(\d{1,2})[./]\s*(\d{4})\.?" + _TIME, (3, 2, 1, 4, 5, 6), False),
)


def _month_map() -> Column:
    items = []
    for k, v in MONTHS.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def _layout(text: Column, pattern: str, groups, named: bool) -> Column:
    pat = "(?iU)" + pattern
    g = [F.regexp_extract(text, pat, i) for i in groups]
    matched = text.rlike(pat)
    num = lambda c: F.when(c != "", c.cast("int"))
    month = F.try_element_at(_month_map(), F.lower(g[1])) if named else num(g[1])
    ts = F.try_make_timestamp_ntz(
        years=num(g[0]), months=month.cast("int"), days=num(g[2]),
        hours=F.coalesce(num(g[3]), F.lit(0)), mins=F.coalesce(num(g[4]), F.lit(0)),
        secs=F.coalesce(num(g[5]), F.lit(0)).cast("decimal(16,6)"))
    return F.when(matched, ts)


def parse_human_date(text: Column) -> Column:
    """First layout that yields a valid date; null otherwise."""
    t = F.trim(text)
    return F.coalesce(*[_layout(t, p, g, n) for p, g, n in LAYOUTS])


# ---------------------------------------------------------------------------
# How sites write a time before now.  Per language and unit the
# form for one and the form with a number; then the words for today, yesterday
# and the day before.
# ---------------------------------------------------------------------------
AGO_FORMS = {
    "hu": {"second": ("másodperce", "másodperce"), "minute": ("perce", "perce"), "hour": ("órája", "órája"),
           "day": ("napja", "napja"), "week": ("hete", "hete"), "month": ("hónapja", "hónapja"), "year": ("éve", "éve")},
    "cs": {"second": ("sekundou", "sekundami"), "minute": ("minutou", "minutami"), "hour": ("hodinou", "hodinami"),
           "day": ("dnem", "dny"), "week": ("týdnem", "týdny"), "month": ("měsícem", "měsíci"), "year": ("rokem", "lety")},
    "sk": {"second": ("sekundou", "sekundami"), "minute": ("minútou", "minútami"), "hour": ("hodinou", "hodinami"),
           "day": ("dňom", "dňami"), "week": ("týždňom", "týždňami"), "month": ("mesiacom", "mesiacmi"), "year": ("rokom", "rokmi")},
    "en": {"second": ("second", "seconds"), "minute": ("minute", "minutes"), "hour": ("hour", "hours"),
           "day": ("day", "days"), "week": ("week", "weeks"), "month": ("month", "months"), "year": ("year", "years")},
}
#: What stands before and after the number and unit; the word for one.
AGO_FRAMES = {"hu": ("", "", "egy"), "cs": ("před", "", ""), "sk": ("pred", "", ""), "en": ("", "ago", "an?|one")}
DAYS_BACK = {"ma": 0, "tegnap": 1, "tegnapelőtt": 2, "dnes": 0, "včera": 1, "předevčírem": 2, "predvčerom": 2,
             "today": 0, "yesterday": 1}

#: Units as (months, seconds).
UNITS = {"second": (0, 1), "minute": (0, 60), "hour": (0, 3600), "day": (0, 86400), "week": (0, 604800),
         "month": (1, 0), "year": (12, 0)}


#: Stands between the parts of a match; no blank-normalised text holds it.
_BREAK = "\n"


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(text: Column, pattern: str, n: int) -> Column:
    """The ``n`` groups of a pattern that matches a whole text, by one pass over it; another text is
    its own only part."""
    return F.split(F.regexp_replace(text, pattern, _BREAK.join(f"${i}" for i in range(1, n + 1))), _BREAK)


def _ago(text: Column, now: Column) -> Column:
    """One pattern for all languages: frame, number, unit, frame.  Frame and unit together must
    be a language's own."""
    units, alone = {}, []
    for lang, (before, after, _) in AGO_FRAMES.items():
        for unit, (single, plural) in AGO_FORMS[lang].items():
            units |= {f"{before}|{w}|{after}": UNITS[unit] for w in (single, plural)}
            if before:
                alone.append(f"{before}|{single}|{after}")  # "před hodinou": one, without a number
    words = sorted({k.split("|")[1] for k in units}, key=len, reverse=True)
    pat = r"(?iU)^(?:(před|pred)\s+)?(?:(\d{1,3}|an?|one|egy)\s+)?(" + "|".join(words) + r")(?:\s+(ago))?$"
    sizes = F.create_map(*[F.lit(x) for k, v in units.items() for x in (k, F.struct(F.lit(v[0]), F.lit(v[1])))])

    def number(p: Column, key: Column) -> Column:
        said, after = F.get(p, 1), F.get(p, 3)
        return F.when(said.rlike(r"^\d+$"), said.try_cast("int")) \
            .when(said == "", F.when(key.isin(alone), F.lit(1))) \
            .when((said == "egy") == (after == ""), F.lit(1))

    def back(x: Column) -> Column:  # the time less months and seconds
        return now - F.make_ym_interval(F.lit(0), x["n"] * x["size"]["col1"]) \
            - F.make_dt_interval(secs=(x["n"] * x["size"]["col2"]).cast("decimal(18,6)"))

    def resolved(p: Column) -> Column:
        key = F.concat_ws("|", F.get(p, 0), F.get(p, 2), F.get(p, 3))
        sized = _with(key, lambda k: F.struct(number(p, k).alias("n"), F.try_element_at(sizes, k).alias("size")))
        return F.when(F.size(p) == 4, _with(sized, back))

    return _with(_parts(F.lower(text), pat, 4), resolved)


def parse_relative_date(text: Column, now: Column) -> Column:
    """T6: "2 hours ago", "před 3 dny", "egy órája", "yesterday", "tegnap 10:32" as seen at ``now``
    (timestamp_ntz).  A day's word without a time keeps the time of ``now``; a month or year back
    stays within the month.  Other texts, unknown words, and a null ``now`` give null.

    Each pattern passes over a text once."""
    pat = r"(?iU)^(" + "|".join(sorted(DAYS_BACK, key=len, reverse=True)) \
        + r")(?:[,\s|–—-]+(?:(?:at|v|ve|o)\s+)?(\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
    back = F.create_map(*[F.lit(x) for kv in DAYS_BACK.items() for x in kv])

    def at_time(day: Column, p: Column) -> Column:
        part = lambda i: F.get(p, i)
        at = F.try_make_timestamp_ntz(F.year(day), F.month(day), F.day(day), part(1).cast("int"), part(2).cast("int"),
                                      F.coalesce(F.when(part(3) != "", part(3).cast("int")), F.lit(0)).cast("decimal(16,6)"))
        return F.when(part(1) == "", day).otherwise(at)

    def resolved(t: Column, p: Column) -> Column:
        day = now - F.make_dt_interval(days=F.try_element_at(back, F.lower(F.get(p, 0))))
        return F.when(F.size(p) == 4, _with(day, lambda d: at_time(d, p))).otherwise(_ago(t, now))

    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return _with(t, lambda t: _with(_parts(t, pat, 4), lambda p: resolved(t, p)))


def render_ago(n: Column, unit: str, lang: str) -> Column:
    """Write a number of units back as a news site does (inverse of ``parse_relative_date``)."""
    before, after, one = AGO_FRAMES[lang]
    single, plural = AGO_FORMS[lang][unit]
    word = {"hu": "egy", "en": "an" if unit == "hour" else "a"}.get(lang)
    of_one = " ".join(x for x in (before, word, single, after) if x)
    return F.when(n == 1, F.lit(of_one)).otherwise(
        F.concat_ws(" ", *[F.lit(x) for x in (before,) if x], n.cast("string"), *[F.lit(x) for x in (plural, after) if x]))


def iso_text(ts: Column) -> Column:
    """ISO 8601 text as Python's ``isoformat`` (no fraction when zero)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def to_timestamp_column(s: Column) -> Column:
    """String column to a naive timestamp (ISO text, 'T' or blank)."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


# ---------------------------------------------------------------------------
# Month names as they are written in dates (Hungarian
# nominative, Czech and Slovak genitive), used to render test date strings.
# ---------------------------------------------------------------------------
DATE_MONTH_NAMES = {
    "hu": ("január", "február", "március", "április", "május", "június",
           "július", "augusztus", "szeptember", "október", "november", "december"),
    "cs": ("ledna", "února", "března", "dubna", "května", "června",
           "července", "srpna", "září", "října", "listopadu", "prosince"),
    "sk": ("januára", "februára", "marca", "apríla", "mája", "júna",
           "júla", "augusta", "septembra", "októbra", "novembra", "decembra"),
}


def render_date(ts: Column, layout: str) -> Column:
    """Write a timestamp the way a news site of ``layout`` does (inverse of T6)."""
    m = F.month(ts)
    if layout in DATE_MONTH_NAMES:
        name = F.element_at(F.array(*[F.lit(x) for x in DATE_MONTH_NAMES[layout]]), m)
        if layout == "hu":
            return F.concat(F.date_format(ts, "yyyy. "), name, F.date_format(ts, " d. HH:mm"))
        if layout == "cs":
            return F.concat(F.date_format(ts, "d. "), name, F.date_format(ts, " yyyy HH:mm"))
        return F.concat(F.date_format(ts, "d. "), name, F.date_format(ts, " yyyy, HH:mm"))
    if layout == "en":
        return F.date_format(ts, "MMMM d, yyyy HH:mm")
    if layout == "iso":
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    if layout == "numeric":
        return F.date_format(ts, "dd.MM.yyyy HH:mm")
    raise ValueError(layout)


RENDER_LAYOUTS = ("hu", "cs", "sk", "en", "iso", "numeric")
