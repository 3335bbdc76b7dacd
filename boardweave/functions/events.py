"""Event dates, provinces and fairs read from free text."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardweave.functions import dims
from boardweave.functions.titles import text

# How days are written.
YMD = r"(\d{4})\s*[年.\-/]\s*(\d{1,2})\s*[月.\-/]\s*(\d{1,2})"
MD = r"(\d{1,2})\s*月\s*(\d{1,2})\s*日?"
NUMERIC_MD = r"(?<!\d)(\d{1,2})[.\-/](\d{1,2})(?!\d)"


def event_date(when: Column, published: Column, move_all: bool = True) -> Column:
    """ISO day of an event told in free text, '' where there is none.

    A text without a year takes that of publication; a month at least eight before that of publication is next
    year's (``move_all=False``: only where the year was taken from publication). A day that the next year doesn't
    have (29 February) isn't moved.
    """
    t, pub = text(when), text(published)
    found = F.struct(F.regexp_extract(t, YMD, 0).alias("ymd"), F.regexp_extract(t, MD, 0).alias("md"), F.regexp_extract(t, NUMERIC_MD, 0).alias("nmd"))
    return F.get(F.transform(F.array(F.struct(found.alias("f"), pub.alias("pub"))), lambda x: _day(x["f"], x["pub"], move_all)), F.lit(0))


def _day(found: Column, pub: Column, move_all: bool) -> Column:
    """The day of the first way of writing that was found; each is taken apart once, as a list of its numbers."""
    full = found["ymd"] != ""
    said = F.when(full, found["ymd"]).when(found["md"] != "", found["md"]).otherwise(found["nmd"])
    year_of = F.when(pub.rlike(r"^\d{4}"), F.nullif(F.left(pub, F.lit(4)).try_cast("int"), F.lit(0)))
    parts = F.struct(F.regexp_extract_all(said, F.lit("(\\d+)"), F.lit(1)).alias("n"), full.alias("full"), year_of.alias("year"), pub.alias("pub"))

    def dated(x: Column) -> Column:
        at = lambda i: F.get(x["n"], F.when(x["full"], F.lit(i)).otherwise(F.lit(i - 1))).try_cast("int")
        year, month, day = F.when(x["full"], F.get(x["n"], F.lit(0)).try_cast("int")).otherwise(x["year"]), at(1), at(2)
        on = lambda y: F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day), "yyyy-MM-dd")
        published = F.when(x["pub"].rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.left(x["pub"], F.lit(10)), "yyyy-MM-dd"))
        moved = (F.month(published) - month >= 8) & (F.lit(True) if move_all else ~x["full"])
        here = on(year)
        ok = year.isNotNull() & month.between(1, 12) & day.between(1, 31) & here.isNotNull()
        return F.coalesce(F.when(ok, F.date_format(F.coalesce(F.when(moved, on(year + 1)), here), "yyyy-MM-dd")), F.lit(""))

    return F.get(F.transform(F.array(parts), dated), F.lit(0))


def province(location: Column, when: Column, accounts: Column) -> Column:
    """The first province named in the place, then in the time; then by city; then by account; else ''."""
    def scan(pairs, t):
        return reduce(lambda c, p: c.when(F.contains(text(t), F.lit(p[0])), p[1]), pairs[1:], F.when(F.contains(text(t), F.lit(pairs[0][0])), pairs[0][1]))

    names, towns = [(p, p) for p in dims.PROVINCES], list(dims.CITY_PROVINCES.items())
    known = F.create_map(*[F.lit(x) for pair in dims.ACCOUNT_PROVINCES.items() for x in pair])
    by_account = F.get(F.filter(F.transform(F.coalesce(accounts, F.array().cast("array<string>")), lambda a: known[a]), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(scan(names, location), scan(names, when), scan(towns, location), scan(towns, when), by_account, F.lit(""))


def built_fair(is_fair: Column, when: Column, location: Column, multi: Column, published: Column, accounts: Column) -> Column:
    """The fair struct of an extraction, null where it is no fair."""
    t, p = F.trim(text(when)), F.trim(text(location))
    return F.when(F.coalesce(is_fair, F.lit(False)), F.struct(
        F.lit(True).alias("is_fair"), t.alias("time"), p.alias("location"), province(p, t, accounts).alias("province"),
        F.coalesce(multi, F.lit(False)).alias("multi_company"), event_date(t, published).alias("date")))


def fair_like(titles: Column) -> Column:
    """Whether any title speaks of a fair and isn't an invitation to employers."""
    return F.exists(titles, lambda t: text(t).rlike(dims.FAIR_TITLE) & ~text(t).rlike(dims.EMPLOYER_INVITE))


def is_fair(fair_flag: Column, kind: Column, version: Column, titles: Column) -> Column:
    judged = (kind == "skipped") & (version == dims.RESULT_VERSION)
    return F.when(F.coalesce(fair_flag, F.lit(False)), True).when(F.coalesce(judged, F.lit(False)), False).otherwise(fair_like(titles))


def epoch_day(seconds: Column) -> Column:
    """Day at +08:00 of epoch seconds; '' for 0 or null."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "").otherwise(F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), "+08:00"), "yyyy-MM-dd"))
