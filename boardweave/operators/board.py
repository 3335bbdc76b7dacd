"""The board: groups with their screening and clicks, filters, facets, pages and fairs."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardweave.functions import dims
from boardweave.functions.events import event_date, is_fair, province
from boardweave.functions.links import group_id
from boardweave.functions.titles import text


def groups(group_file: DataFrame, prefix: str) -> DataFrame:
    """Board groups of a group file: members with a link of the board; canonical or else first member; '' for missing.

    id is that of the sorted links; of rows with the same links the smallest group_id counts.
    """
    m = F.filter("members", lambda x: x["文章链接"].isNotNull() & F.startswith(x["文章链接"], F.lit(prefix)))
    g = group_file.select("group_id", "canonical", m.alias("members")).where(F.size("members") > 0)
    urls = F.array_sort(F.array_distinct(F.transform("members", lambda x: x["文章链接"])))
    c = F.coalesce("canonical", F.get("members", F.lit(0)))
    g = g.select(group_id(urls).alias("id"), "group_id", text(c["文章标题"]).alias("title"), text(c["文章链接"]).alias("url"), text(c["公众号"]).alias("account"), text(c["发布日期"]).alias("date"), urls.alias("urls"),
                 F.transform("members", lambda x: F.struct(text(x["文章标题"]).alias("title"), text(x["公众号"]).alias("account"))).alias("members"))
    first = F.min_by(F.struct("title", "url", "account", "date", "urls", "members"), "group_id")
    return g.groupBy("id").agg(first.alias("g")).select("id", "g.*")


def screen_index(screens: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """url, s: the entry that counts for each link: first by day, kept before skipped, then by entry_id."""
    s = screens.withColumn("s", F.struct("entry_id", "kind", "unit", "intro", "title", "positions", "locations", "v", "fair", "article_url", *more))
    e = s.select("s", F.explode("urls").alias("url"), F.struct("screened_date", F.col("kind") != "kept", "entry_id").alias("o")).where("url is not null")
    return e.groupBy("url").agg(F.min_by("s", "o").alias("s"))


def with_screen(g: DataFrame, screens: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Each group with the entry of the first of its sorted links that has one; ``more`` names further fields of it."""
    e = g.select("id", F.posexplode("urls").alias("pos", "url")).join(screen_index(screens, more), "url")
    return g.join(e.groupBy("id").agg(F.min_by("s", "pos").alias("screen")), "id", "left")


def with_clicks(g: DataFrame, clicks: DataFrame, user: int) -> DataFrame:
    """Each group with the user's latest stamp on any of its links."""
    c = clicks.where((F.col("user_id") == user) & F.col("clicked_at").isNotNull()).groupBy("url").agg(F.max("clicked_at").alias("at"))
    e = g.select("id", F.explode("urls").alias("url")).join(c, "url")
    return g.join(e.groupBy("id").agg(F.max("at").alias("clicked_at")), "id", "left")


def _titles() -> Column:
    return F.concat(F.array("title"), F.transform("members", lambda m: m["title"]))


def fair_flag() -> Column:
    s = F.col("screen")
    return is_fair(s["fair"]["is_fair"], s["kind"], s["v"], _titles())


def has_cs() -> Column:
    hit = lambda c: text(c).rlike(dims.CS_CATEGORY)
    return F.coalesce(F.exists("screen.positions", lambda p: hit(p["category"]) | hit(p["name"])), F.lit(False))


def keyword_hit(words: list[str]) -> Column:
    """Whether any word is in the entry's text; an empty list hits everything."""
    s = F.col("screen")
    pos = F.array_join(F.transform(F.coalesce(s["positions"], F.array().cast("array<struct<name:string,category:string,location:string>>")), lambda p: F.concat_ws(" ", text(p["name"]), text(p["category"]))), " ")
    hay = F.lower(F.concat_ws(" ", pos, text(s["intro"]), text(s["unit"]), text(F.col("title"))))
    return reduce(lambda a, b: a | b, [F.contains(hay, F.lit(w.lower())) for w in words]) if words else F.lit(True)


def city_hit(cities: list[str]) -> Column:
    """Whether any city is in a place of the entry; an empty list hits everything."""
    s = F.col("screen")
    places = F.concat(F.array(text(s["locations"])), F.coalesce(F.transform(s["positions"], lambda p: text(p["location"])), F.array().cast("array<string>")))
    return F.exists(places, lambda p: reduce(lambda a, b: a | b, [F.contains(p, F.lit(c)) for c in cities])) if cities else F.lit(True)


def context(g: DataFrame, status: str = "unread", account: str = "", query: str = "", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Groups that aren't fairs, by read status (unknown means unread), account and search; the base of facets and pages.

    exclude removes ids, and only where unread groups are asked for.
    """
    out = g.where(~fair_flag())
    if status == "read":
        out = out.where("clicked_at is not null")
    elif status != "all":
        out = out.where("clicked_at is null")
        if exclude:
            out = out.where(~F.col("id").isin(*exclude))
    if account:
        out = out.where(F.col("account") == account)
    if query:
        hay = F.lower(F.concat_ws(" ", "title", "account", F.array_join(F.transform("members", lambda m: F.concat_ws(" ", m["title"], m["account"])), " ")))
        out = out.where(F.contains(hay, F.lit(query[:100].lower())))
    return out


def facets(ctx: DataFrame, keywords: list[str], cities: list[str]) -> DataFrame:
    """Counts per chip in one pass; the first three only among kept entries, so they may overlap."""
    kind = F.coalesce("screen.kind", F.lit(""))
    kept = kind == "kept"
    return ctx.agg(
        F.count_if(kept & has_cs()).alias("cs"), F.count_if(kept & keyword_hit(keywords)).alias("keywords"),
        F.count_if(kept & city_hit(cities)).alias("cities"), F.count_if(kind == "skipped").alias("skipped"),
        F.count_if(~kind.isin("kept", "skipped")).alias("none"))


def chips(ctx: DataFrame, names: list[str], keywords: list[str], cities: list[str]) -> DataFrame:
    """Groups that satisfy every chip."""
    kind = F.coalesce("screen.kind", F.lit(""))
    rule = {"cs": (kind == "kept") & has_cs(), "keywords": (kind == "kept") & keyword_hit(keywords), "cities": (kind == "kept") & city_hit(cities), "skipped": kind == "skipped", "none": ~kind.isin("kept", "skipped")}
    return reduce(lambda d, n: d.where(rule[n]), [n for n in names if n in rule], ctx)


def page(ctx: DataFrame, number: int = 1, size: int = 40) -> DataFrame:
    """One page of groups, latest first: size within 1..100, number within the pages there are."""
    size = min(max(size, 1), 100)
    total = ctx.count()
    number = min(max(number, 1), max(1, -(-total // size)))
    return ctx.orderBy(F.desc("date"), F.desc("title"), "id").offset((number - 1) * size).limit(size)


def stats(g: DataFrame, today: str) -> DataFrame:
    """Totals of the board in one aggregation; fairs count apart, the latest date over all."""
    f = fair_flag()
    day = F.col("screen.fair.date")
    read = F.col("clicked_at").isNotNull()
    upcoming = f & (F.coalesce(day, F.lit("")).isin("") | (day >= today))
    return g.agg(
        F.count_if(~f).alias("total"), F.count_if(~f & read).alias("read"), F.count_if(~f & ~read).alias("unread"),
        F.count_if(~f & F.startswith(F.coalesce("clicked_at", F.lit("")), F.lit(today))).alias("today_read"),
        F.count_if(f).alias("fair_total"), F.count_if(upcoming).alias("fair_upcoming"), F.coalesce(F.max("date"), F.lit("")).alias("latest_date"))


def account_counts(g: DataFrame) -> DataFrame:
    return g.where(~fair_flag()).groupBy("account").agg(F.count(F.lit(1)).alias("n"))


def fairs(g: DataFrame) -> DataFrame:
    """Fairs with day, province ('' for unknown), several companies or not, and read state."""
    s = F.col("screen.fair")
    many = F.coalesce(s["multi_company"], F.exists(_titles(), lambda t: t.rlike(dims.MULTI_COMPANY)))
    return g.where(fair_flag()).select("id", "title", "date", text(s["date"]).alias("fair_date"), text(s["province"]).alias("province"), many.alias("multi_company"), F.col("clicked_at").isNotNull().alias("is_read"))


# Fixed value: the label of fairs whose province isn't known.
NO_PROVINCE = "未标注省份"


def fair_info(g: DataFrame) -> DataFrame:
    """Fairs as their view shows them: the entry's day, else that of the first title that tells one; the entry's
    province, else that of place, time or account; several companies by the entry, by title only where it says nothing."""
    s = F.col("screen.fair")
    told = F.get(F.filter(F.transform(_titles(), lambda t: event_date(t, F.col("date"), False)), lambda x: x != ""), F.lit(0))
    own = text(s["date"])
    many = F.coalesce(s["multi_company"], F.exists(_titles(), lambda t: t.rlike(dims.MULTI_COMPANY)))
    accounts = F.concat(F.array("account"), F.transform("members", lambda m: m["account"]))
    where = F.coalesce(F.nullif(text(s["province"]), F.lit("")), F.nullif(province(s["location"], s["time"], accounts), F.lit("")), F.lit(NO_PROVINCE))
    # the day is read once and then used twice
    f = g.where(fair_flag()).select("id", "title", "account", "date", s.isNotNull().alias("has_fair"), own.alias("own_date"), F.when(own == "", told).alias("told"), where.alias("province"), many.alias("multi_company"), F.col("clicked_at").isNotNull().alias("is_read"))
    return f.withColumns({"fair_date": F.coalesce(F.nullif("own_date", F.lit("")), "told", F.lit("")), "date_from_title": F.col("told").isNotNull()}).drop("told")


def fair_summary(f: DataFrame, today: str) -> DataFrame:
    """Dated fairs to come, unread and undated ones."""
    return f.agg(F.count_if(F.col("fair_date") >= today).alias("upcoming"), F.count_if(~F.col("is_read")).alias("unread"), F.count_if(F.col("fair_date") == "").alias("undated"))


def of_provinces(f: DataFrame, chosen: list[str]) -> DataFrame:
    """Fairs of the chosen provinces, of all where none is chosen."""
    return f.where(F.col("province").isin(chosen)) if chosen else f


def fair_order(f: DataFrame) -> DataFrame:
    """place of each fair within its day and province: several companies first, then the latest published."""
    w = Window.partitionBy("fair_date", "province").orderBy(F.desc("multi_company"), F.desc("date"), "id")
    return f.withColumn("place", F.row_number().over(w).cast("bigint"))


def day_provinces(f: DataFrame) -> DataFrame:
    """Provinces within each day by number of fairs, unknown last."""
    n = f.groupBy("fair_date", "province").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("fair_date").orderBy(F.col("province") == NO_PROVINCE, F.desc("n"), "province")  # a day's provinces
    return n.withColumn("place", F.row_number().over(w).cast("bigint"))


def fair_days(f: DataFrame, today: str) -> DataFrame:
    """Per day: all, unread, read, and whether it is past."""
    return f.groupBy("fair_date").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_read")).alias("unread"), F.count_if("is_read").alias("read")).withColumn("past", (F.col("fair_date") != "") & (F.col("fair_date") < today))


def fair_provinces(f: DataFrame, unknown: str = NO_PROVINCE) -> DataFrame:
    """Provinces by number of fairs, unknown last."""
    n = f.groupBy(F.when(F.col("province") == "", unknown).otherwise(F.col("province")).alias("province")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("province") == unknown, F.desc("n"), "province")  # as many rows as there are provinces
    return n.withColumn("place", F.row_number().over(w).cast("bigint"))


def default_day(f: DataFrame, today: str) -> DataFrame:
    """The day to open: today, else the next, else undated, else the last."""
    d = F.col("fair_date")
    return f.agg(F.coalesce(F.max(F.when(d == today, d)), F.min(F.when(d > today, d)), F.max(F.when(d == "", d)), F.max(d)).alias("day"))
