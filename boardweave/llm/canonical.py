"""One surviving record for each group of duplicates, field by field.

Method: latent two-sided quality. Each usable field value of a member is a claim of that member's source. A
value of a group's field is true or not (several may be); a source has a sensitivity (it claims what is true)
and a specificity (it doesn't claim what isn't). Expectation-maximisation infers both: the chance that a value
is true follows from who claims it and who, also a member of the group, doesn't; a source's quality follows
from the chances of the values of its groups. All values judged true are retained; the survivor's value is the
first by the order asked for, and among members that this order can't tell apart the likeliest.

The sum over a fact's non-claimants is the sum over all sources of the group less that of its claimants, so a
step costs rows in proportion to the claims and never pairs claims with each other. Sources may be skewed (one
may hold a third of all claims): its quality is an aggregate that combines before the shuffle.

Defined results: null members are ignored, as are members without a link; a group with fewer than two different
links has no survivor; a field without a usable value has null; repeated members count once; with no day of
generation any real day is usable; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardweave.functions.width import folded, half_width
from boardweave.llm.common import dropped, salted_join, written

# What stands in for a missing account or title, and how a cut title ends.
NO_ACCOUNT = ("", "n/a", "na", "null", "none", "-", "--", "—", "——", "未知", "待补充", "无", "暂无", "匿名", "佚名", "未命名")
NO_TITLE = NO_ACCOUNT + ("（标题缺失）", "(标题缺失)", "标题缺失", "无标题", "分享图片", "图片", "untitled")
CUT = r"(…|⋯|\.\.|。。|．．)[\s\p{Cf}]*$"

#: Share of values that are true before anything is known, pseudo-counts of a source's two rates, and steps.
PRIOR, RATES, STEPS = 0.7, {"hit": (8.0, 2.0), "pass": (8.0, 2.0)}, 6


def _bare(text: Column) -> Column:
    return F.lower(half_width(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")))


def usable_date(date: Column, generated_at: Column) -> Column:
    """A real calendar day written YYYY-MM-DD that isn't after the day of generated_at."""
    shaped = date.rlike(r"^\d{4}-\d{2}-\d{2}$")
    real = F.when(shaped, F.try_to_date(date, "yyyy-MM-dd")).isNotNull()
    day = F.substring(generated_at, 1, 10)
    bound = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day)
    return F.coalesce(shaped & real & (date <= F.coalesce(bound, F.lit("9999-12-31"))), F.lit(False))


def usable_account(account: Column) -> Column:
    return ~_bare(account).isin(*NO_ACCOUNT)


def usable_title(title: Column) -> Column:
    return ~_bare(title).isin(*NO_TITLE) & (folded(title) != "") & ~F.coalesce(title, F.lit("")).rlike(CUT)


def members(groups: DataFrame) -> DataFrame:
    """One row per different member with a link: group_id, link, and date, account, title where usable."""
    m = groups.select(F.col("group_id").cast("bigint").alias("group_id"), "generated_at", F.explode("members").alias("m")).where("trim(coalesce(m.`文章链接`, '')) <> ''")
    date, account, title = F.col("m.发布日期"), F.col("m.公众号"), F.col("m.文章标题")
    return m.select(
        "group_id",
        F.col("m.文章链接").alias("link"),
        F.when(usable_date(date, F.col("generated_at")), date).alias("date"),
        F.when(usable_account(account), account).alias("account"),
        F.when(usable_title(title), title).alias("title"),
    ).distinct()


def claims(m: DataFrame) -> DataFrame:
    """group_id, source, field, value: what each source says of each field of a group, once."""
    source = F.coalesce("account", F.lit(""))
    fields = F.array(
        F.struct(F.lit("account").alias("field"), F.trim("account").alias("value")),
        F.struct(F.lit("date").alias("field"), F.col("date").alias("value")),
        F.struct(F.lit("title").alias("field"), folded(F.col("title")).alias("value")),
    )
    c = m.select("group_id", source.alias("source"), F.explode(fields).alias("f")).select("group_id", "source", "f.*")
    return c.where("value is not null and value <> ''").distinct()


def truths(claim: DataFrame) -> DataFrame:
    """group_id, field, value, p: the chance that each claimed value is true. A written table."""
    fact, obj = ["group_id", "field", "value"], ["group_id", "field"]
    c = written(claim)
    n = written(c.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    quality = n.withColumns({"sens": F.lit(0.8), "spec": F.lit(0.8)})
    taking = written(c.select(*obj, "source").distinct())
    p = old = None
    for step in range(STEPS):
        # E: log odds of a fact = prior + sum over sources of the object of "doesn't claim" + per claimant what claiming changes
        silent = F.log((1 - F.col("sens")) / F.col("spec"))
        spoken = F.log(F.col("sens") / (1 - F.col("spec")))
        base = salted_join(taking, quality, "source", "n").groupBy(*obj).agg(F.sum(silent).alias("base"))
        own = salted_join(c, quality, "source", "n").groupBy(*fact).agg(F.sum(spoken - silent).alias("own"))
        odds = F.lit(PRIOR / (1 - PRIOR)) * F.exp(F.least(F.greatest(F.col("base") + F.col("own"), F.lit(-30.0)), F.lit(30.0)))
        p = written(own.join(base, obj).select(*fact, (odds / (1 + odds)).alias("p")))
        if old is not None:
            dropped(old)
        old = p
        if step == STEPS - 1:
            break
        # M: claims of true and of false values against all true and all false values of the source's objects
        totals = p.groupBy(*obj).agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("f"))
        seen = taking.join(totals, obj).groupBy("source").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
        said = c.join(p, fact).groupBy("source").agg(F.sum("p").alias("ct"), F.sum(1 - F.col("p")).alias("cf"))
        (a, b), (x, y) = RATES["hit"], RATES["pass"]
        q = seen.join(said, "source").join(n, "source")
        last = quality if step else None
        quality = written(q.select("source", "n", ((F.col("ct") + a) / (F.col("t") + a + b)).alias("sens"), ((F.col("f") - F.col("cf") + x) / (F.col("f") + x + y)).alias("spec")))
        if last is not None:
            dropped(last)
    return p


def survivors(groups: DataFrame) -> DataFrame:
    """group_id, {account,date,title}, their links, and all values judged true, one row per group of two or more links.

    Members are preferred by the later usable date, those without one last, then by the smaller link; the chance
    of a value decides between members of one link.
    """
    m = written(members(groups))
    p = truths(claims(m))
    kept = p.where("p >= 0.5").groupBy("group_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("value")))).alias(f"{f}s_true") for f in ("account", "date", "title")]
    )
    chance = {f: p.where(F.col("field") == f).select("group_id", F.col("value").alias(f"{f}_v"), F.col("p").alias(f"{f}_p")) for f in ("account", "title")}
    r = m.withColumns({"account_v": F.trim("account"), "title_v": folded(F.col("title"))})
    for f in ("account", "title"):
        r = r.join(chance[f], ["group_id", f"{f}_v"], "left")
    # ascending order: days since an unreachable one, negated, so later dates come first and null ones last
    late = F.coalesce(F.datediff(F.lit("9999-12-31"), F.try_to_date("date", "yyyy-MM-dd")), F.lit(1 << 30))
    order = {f: F.struct(late, F.col("link"), -F.coalesce(F.col(f"{f}_p"), F.lit(0.0))) for f in ("account", "title")}
    first = r.groupBy("group_id").agg(
        F.count_distinct("link").alias("k"),
        F.min_by(F.struct("date", "link"), F.struct(late, F.col("link"))).alias("d"),
        *[F.min(F.when(F.col(f).isNotNull(), F.struct(order[f].alias("o"), F.struct(F.col(f).alias("value"), F.col("link"))))).getField("col2").alias(f[0]) for f in ("account", "title")],
    )
    out = first.where("k >= 2").join(kept, "group_id", "left")
    return out.select(
        "group_id",
        F.col("a.value").alias("account"), F.col("d.date").alias("date"), F.col("t.value").alias("title"),
        F.col("a.link").alias("account_link"), F.col("d.link").alias("date_link"), F.col("t.link").alias("title_link"),
        "accounts_true", "dates_true", "titles_true",
    )
