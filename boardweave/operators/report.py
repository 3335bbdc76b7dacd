"""The summary job and its report: three tiers joined into groups, ordered members, lists and their order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardweave.functions import titles as T
from boardweave.functions.titles import text
from boardweave.operators import dedup, graph


def full_groups(articles: DataFrame, decisions: DataFrame, brands: T.Brands) -> DataFrame:
    """root, url of all links that the tiers join: equal titles, unwrapped titles and stored positive verdicts, less vetoed pairs.

    decisions are those of dedup.upsert_decisions(). The tiers' stars are joined by one search for components.
    """
    said = decisions.where("duplicate").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    soft = dedup.unwrap_links(articles).union(said).distinct()
    kept = dedup.vetoed(soft, articles, brands).where("not veto").select("a", "b")
    found = graph.connected(dedup.exact_links(articles).union(kept))
    return found.select("root", F.col("value").alias("url"))


def ordered_members(groups: DataFrame, articles: DataFrame) -> DataFrame:
    """root, url, date, title, place, n: members from the latest down; the first is canonical, the others its "same title" list."""
    t = articles.groupBy("url").agg(F.max(F.struct("date", "title")).alias("x")).select("url", "x.*")
    w = Window.partitionBy("root")
    j = groups.join(t, "url")
    return j.select("root", "url", "date", "title", F.row_number().over(w.orderBy(F.desc("date"), F.desc("title"), F.desc("url"))).cast("bigint").alias("place"), F.count(F.lit(1)).over(w).alias("n"))


def decision_rows(pairs: DataFrame, articles: DataFrame, brands: T.Brands, now: str) -> DataFrame:
    """lo, hi, duplicate, rule, veto, decided_at: the records to store for pairs(a, b, rule) of this run; a vetoed pair is no duplicate."""
    p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rule").where("a <> b")
    p = p.groupBy("a", "b").agg(F.min("rule").alias("rule"))
    v = dedup.vetoed(p.select("a", "b"), articles, brands)
    j = p.join(v, ["a", "b"])
    return j.select(F.col("a").alias("lo"), F.col("b").alias("hi"), (~F.col("veto")).alias("duplicate"), "rule", F.when(F.col("veto"), "brand").alias("veto"), F.lit(now).alias("decided_at"))


def nested(groups: DataFrame) -> DataFrame:
    """date, accounts: the report's days with their accounts and each account's groups, all in order, by the canonical member."""
    lines = groups.groupBy("date", "account").agg(F.array_sort(F.collect_list(F.struct("title", "id", "n_members"))).alias("groups"))
    return lines.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("account", "groups"))).alias("accounts"))


def account_lines(articles: DataFrame) -> DataFrame:
    """account, line, place of the per-account lists, latest first."""
    w = Window.partitionBy("account").orderBy(F.desc("date"), F.desc("title"), "url")
    when = F.when(F.col("date") == "", "日期不明").otherwise(F.col("date"))
    return articles.select("account", F.concat(F.lit("- "), when, F.lit(" ["), "title", F.lit("]("), "url", F.lit(")")).alias("line"), F.row_number().over(w).cast("bigint").alias("place"))


def dated_first(rows: DataFrame) -> DataFrame:
    """Dated rows by date, first sight and title, latest first; then undated ones by first sight and title."""
    return rows.orderBy(F.desc_nulls_last(F.nullif(text(F.col("date")), F.lit(""))), F.desc("first_seen"), F.desc("title"), "url")


def date_range(raw: str, lowest: str = "20260710", highest: str = "99999999") -> tuple[str, str]:
    """Bounds of a typed range: none means all, one day means that day; '20260801..' and '..20260801' leave an end open."""
    s = (raw or "").replace("-", "").strip()
    if not s:
        return lowest, highest
    if ".." not in s:
        return s, s
    lo, hi = (x.strip() for x in s.split("..", 1))
    return lo or lowest, hi or highest


def only(rows: DataFrame, accounts: list[str], configured: list[str] | None = None) -> DataFrame:
    """Rows of some accounts; an empty choice is an error, as is one that names none of the configured accounts.

    A chosen account without rows isn't an error: it gives none.
    """
    wanted = [a.strip() for a in accounts if a.strip()]
    if not wanted or (configured is not None and not set(wanted) & set(configured)):
        raise ValueError(f"no account among {accounts}")
    return rows.where(F.col("account").isin(wanted))


def expired(folders: DataFrame, cutoff: str) -> DataFrame:
    """Cache folders named by eight digits that come before the cutoff; others are never expired."""
    return folders.where(F.col("name").rlike(r"^\d{8}$") & (F.col("name") < cutoff))


def visible(groups: DataFrame, seen_now: DataFrame) -> DataFrame:
    """Unread groups, and those that were read in this session."""
    s = seen_now.select("id").distinct().withColumn("_now", F.lit(True))
    return groups.join(s, "id", "left").where("clicked_at is null or _now").drop("_now")


def log_tail(lines: DataFrame, n: int = 12) -> DataFrame:
    """The last n lines by number, then without blank ones."""
    return lines.orderBy(F.desc("number")).limit(n).where("trim(coalesce(line, '')) <> ''")
