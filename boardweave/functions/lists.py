"""Lists that users type."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardweave.functions.titles import text

SPLIT = r"[、，,;；/\s]+"


def json_list(raw: Column) -> Column:
    """The strings of a JSON array, trimmed and not blank; [] for anything else."""
    got = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(got, lambda x: F.trim(x)), lambda x: x != "")


def user_list(items: Column, most: int, longest: int) -> Column:
    """Trimmed, without blanks and repeats, truncated and capped, in order."""
    kept = F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(text(x))), lambda x: x != ""))
    return F.slice(F.transform(kept, lambda x: F.left(x, F.lit(longest))), 1, most)


def place_tokens(locations: Column) -> Column:
    return F.filter(F.split(text(locations), SPLIT), lambda x: x != "")


def typed(raw: Column) -> Column:
    """What a user typed into a preference field: parted by list signs, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.split(text(raw), r"[、，,;；\s]+"), lambda x: x != ""))


def first_hit(cities: Column, places: Column) -> Column:
    """The first preferred city, in the order of preference, that some place holds."""
    return F.get(F.filter(cities, lambda c: F.exists(places, lambda p: F.contains(p, c))), F.lit(0))
