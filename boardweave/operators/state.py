"""Keyed state as pure functions (state, change) -> new state, for tables without MERGE."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(state: DataFrame, change: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of change replace rows of state with the same keys; within change the greatest by ``order`` counts.

    An aggregate that combines before the shuffle, so hot keys shrink where they are read.
    """
    rest = [c for c in state.columns if c not in keys]
    tag = lambda d, n: d.select(*keys, F.struct(F.lit(n).alias("gen"), F.struct(*[F.col(c) for c in order or rest]).alias("o")).alias("rank"), F.struct(*rest).alias("row"))
    both = tag(state, 0).union(tag(change.select(*state.columns), 1))
    return both.groupBy(*keys).agg(F.max_by("row", "rank").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*state.columns)


def delete(state: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return state.join(keys.select(*on).distinct(), on, "left_anti")


def insert_ignore(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there yet are added."""
    return state.unionByName(rows.join(state.select(*keys), keys, "left_anti"))


def partial_upsert(state: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """Only columns that change supplies (not null) are replaced."""
    cols = [c for c in state.columns if c != key]
    j = state.alias("s").join(change.alias("c"), key, "full")
    return j.select(key, *[(F.coalesce(F.col(f"c.{c}"), F.col(f"s.{c}")) if c in change.columns else F.col(f"s.{c}")).alias(c) for c in cols])


def latest_clicks(clicks: DataFrame) -> DataFrame:
    """The newest stamp of each user and link; stamps compare as text; null stamps only where no other is."""
    return clicks.groupBy("user_id", "url").agg(F.max("clicked_at").alias("clicked_at"))


def propagated(members: DataFrame, clicks: DataFrame) -> DataFrame:
    """group_id, url, clicked_at: a member's own stamp, else the newest of its group, '' where the group has none."""
    c = clicks.groupBy("url").agg(F.max("clicked_at").alias("own"))
    m = members.select("group_id", "url").distinct().join(c, "url", "left")
    newest = m.groupBy("group_id").agg(F.max("own").alias("newest"))
    return m.join(newest, "group_id").select("group_id", "url", F.coalesce("own", "newest", F.lit("")).alias("clicked_at"))


def cleared(state: DataFrame, deleted: DataFrame, column: str) -> DataFrame:
    """The foreign key set to null where its target is deleted."""
    d = deleted.select(F.col("id").alias(column), F.lit(True).alias("_gone")).distinct()
    return state.join(d, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone").select(*state.columns)


def active_sessions(sessions: DataFrame, users: DataFrame, now: str) -> DataFrame:
    """Sessions of active users that haven't expired."""
    u = users.where("active = 1").select(F.col("id").alias("user_id"), "username")
    return sessions.where(F.col("expires_at") > now).join(u, "user_id").select("token_hash", "user_id", "username")


def preferences_or_default(preferences: DataFrame, users: DataFrame, defaults: list[str]) -> DataFrame:
    """Cities of each user: defaults only without a row; an explicit empty list stays empty."""
    p = preferences.select("user_id", "cities", F.lit(True).alias("_row"))
    cities = F.when(F.col("_row").isNull(), F.array(*[F.lit(c) for c in defaults])).otherwise(F.coalesce("cities", F.array().cast("array<string>")))
    return users.select("user_id").join(p, "user_id", "left").select("user_id", cities.alias("cities"))


def violations(table: DataFrame, key: list[str], checks: dict[str, str]) -> DataFrame:
    """rule, n: rows that break the primary key or a named SQL condition."""
    out = table.groupBy(*key).count().where("count > 1").agg(F.lit("primary key").alias("rule"), F.count(F.lit(1)).alias("n"))
    for name, cond in checks.items():
        out = out.union(table.where(f"not coalesce({cond}, true)").agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n")))
    return out
