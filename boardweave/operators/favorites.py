"""Favourites, collections and read marks of users, as tables in and tables out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardweave.functions.titles import text
from boardweave.operators.state import upsert

# What a favourite keeps of its screening entry, and the longest link and name and most collections kept.
SNAPSHOT = ("unit", "intro", "recruit_target", "positions", "locations")
LONGEST_LINK, LONGEST_NAME, MOST_COLLECTIONS = 2048, 24, 30


def snapshots(groups: DataFrame) -> DataFrame:
    """id, title, url, account, date, apply_url, snapshot of board groups with their screen: what a favourite keeps.

    snapshot is JSON of the fields that the entry has, '' without an entry.
    """
    s = F.col("screen")
    kept = F.to_json(F.struct(*[s[c].alias(c) for c in SNAPSHOT]))
    link = F.left(text(s["apply_url"]), F.lit(LONGEST_LINK))
    return groups.select("id", "title", "url", "account", "date", F.when(s.isNotNull(), link).otherwise("").alias("apply_url"), F.when(s.isNotNull(), kept).otherwise("").alias("snapshot"))


def set_favorites(state: DataFrame, wanted: DataFrame, groups: DataFrame, now: str) -> DataFrame:
    """State with wanted(user_id, id, collection_id) added or renewed, each with today's snapshot of its group."""
    new = wanted.join(snapshots(groups), "id").withColumn("created_at", F.lit(now))
    return upsert(state, new.select(*state.columns), ["user_id", "id"], ["collection_id", "created_at"])


def read_marks(clicks: DataFrame, wanted: DataFrame, groups: DataFrame, now: str) -> DataFrame:
    """clicks(user_id, url, clicked_at) after favourites were set: a favourite counts as read, by all its links."""
    marks = wanted.select("user_id", "id").distinct().join(groups.select("id", F.explode("urls").alias("url")), "id")
    return upsert(clicks, marks.select("user_id", "url", F.lit(now).alias("clicked_at")), ["user_id", "url"])


def owned(wanted: DataFrame, collections: DataFrame) -> DataFrame:
    """Wanted favourites whose collection is none or one of the user's own."""
    own = collections.select(F.col("id").alias("collection_id"), "user_id", F.lit(True).alias("_own")).distinct()
    return wanted.join(own, ["user_id", "collection_id"], "left").where("collection_id is null or _own").drop("_own").select(*wanted.columns)


def created(collections: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(user_id, name, created_at, seq) with what becomes of each: created, bad_name, too_many or taken.

    Requests count in the order of seq. A user has few collections, and those asked for are ranked by an aggregate
    per user and name and a window over a user's new names, of which only MOST_COLLECTIONS matter.
    """
    from pyspark.sql import Window

    a = asked.withColumn("name", F.trim(text(F.col("name")))).withColumn("ok", F.length("name").between(1, LONGEST_NAME))
    had = collections.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    names = collections.select("user_id", "name", F.lit(True).alias("had")).distinct()
    first = a.where("ok").groupBy("user_id", "name").agg(F.min("seq").alias("first"))
    j = a.join(names, ["user_id", "name"], "left").join(first, ["user_id", "name"], "left").join(had, "user_id", "left")
    new = F.col("ok") & F.col("had").isNull() & (F.col("seq") == F.col("first"))
    place = F.sum(new.cast("int")).over(Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    full = F.coalesce("n", F.lit(0)) + place - new.cast("int") >= MOST_COLLECTIONS
    what = F.when(~F.col("ok"), "bad_name").when(full, "too_many").when(~new, "taken").otherwise("created")
    return j.select("user_id", "seq", "name", what.alias("result"))


def index(favorites: DataFrame, clicks: DataFrame, groups: DataFrame, applied: DataFrame) -> DataFrame:
    """user_id, id, collection_id, is_read, place: a user's favourites, unread first, then latest, then by id.

    A favourite is read with a click on any link of its group or an applied mark.
    """
    from pyspark.sql import Window

    read = clicks.join(groups.select(F.col("id").alias("gid"), F.explode("urls").alias("url")), "url").select("user_id", F.col("gid").alias("id"))
    marks = read.union(applied.select("user_id", "id")).distinct().withColumn("is_read", F.lit(True))
    f = favorites.join(marks, ["user_id", "id"], "left").withColumn("is_read", F.coalesce("is_read", F.lit(False)))
    w = Window.partitionBy("user_id").orderBy("is_read", F.desc("created_at"), "id")  # one user's favourites
    return f.select("user_id", "id", "collection_id", "is_read", F.row_number().over(w).cast("bigint").alias("place"))


def counts(favorites: DataFrame, collections: DataFrame) -> DataFrame:
    """user_id, collection_id, n: every collection with its number of favourites, 0 too; unknown ones count under null."""
    c = collections.select("user_id", F.col("id").alias("collection_id")).distinct()
    f = favorites.join(c.withColumn("_known", F.lit(True)), ["user_id", "collection_id"], "left")
    f = f.groupBy("user_id", F.when(F.col("_known"), F.col("collection_id")).alias("collection_id")).agg(F.count(F.lit(1)).alias("n"))
    empty = c.join(f, ["user_id", "collection_id"], "left_anti").withColumn("n", F.lit(0).cast("bigint"))
    return f.unionByName(empty)


def disabled(users: DataFrame, sessions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """users(user_id, active) and sessions(token_hash, user_id) once users are disabled: their sessions end with them."""
    g = gone.select("user_id").distinct()
    off = users.join(g.withColumn("_gone", F.lit(True)), "user_id", "left").withColumn("active", F.when(F.col("_gone"), F.lit(0)).otherwise(F.col("active"))).drop("_gone")
    return off.select(*users.columns), sessions.join(g, "user_id", "left_anti").select(*sessions.columns)


def imported(clicks: DataFrame, rows: DataFrame, prefix: str) -> DataFrame:
    """Clicks with imported ones of the board's links; an imported stamp replaces the old one."""
    good = rows.where(F.startswith(text(F.col("url")), F.lit(prefix)))
    return upsert(clicks, good.select(*clicks.columns), ["user_id", "url"])
