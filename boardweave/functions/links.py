"""Application links and identifiers inside pages and links."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardweave.functions.titles import text

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def apply_url(raw: Column, fallback: Column) -> Column:
    """The candidate with the longest path and query (the first of equals), else a mail link, else the fallback."""
    urls = F.regexp_extract_all(text(raw), F.lit("https?://[!-~]+"), F.lit(0))
    # a link glued to another starts again at its own scheme only where a sign outside ASCII parts them
    clean = F.transform(urls, lambda u: F.rtrim(F.regexp_replace(u, r"[.,;:]+$", "")))
    named = F.filter(clean, lambda u: F.regexp_extract(u, r"^https?://([^/?#]*)", 1) != "")
    length = lambda u: F.length(F.regexp_extract(u, r"^https?://[^/?#]*([^?#]*)", 1)) + F.length(F.regexp_extract(u, r"\?([^#]*)", 1))
    best = F.reduce(named, F.struct(F.lit("").alias("u"), F.lit(-1).alias("n")), lambda a, u: F.when(length(u) > a["n"], F.struct(u.alias("u"), length(u).alias("n"))).otherwise(a))["u"]
    mail = F.regexp_extract(text(raw), EMAIL, 0)
    return F.when(best != "", best).when(mail != "", F.concat(F.lit("mailto:"), mail)).otherwise(F.trim(text(fallback)))


def biz_of(page: Column) -> Column:
    """The account identifier of a page or link, URL-decoded; '' where there is none."""
    return F.coalesce(F.try_url_decode(F.regexp_extract(text(page), "__biz=([^&\"'#]+)", 1)), F.lit(""))


def book_id(biz: Column) -> Column:
    """MP_WXS_n of a base64 identifier that holds digits; null otherwise."""
    digits = F.try_to_binary(biz, F.lit("base64")).cast("string")
    return F.when(digits.rlike(r"^[0-9]+$"), F.concat(F.lit("MP_WXS_"), digits))


def group_id(urls: Column) -> Column:
    """24 hex digits that identify a set of links whatever its order."""
    return F.left(F.sha2(F.concat_ws("\n", F.array_sort(F.array_distinct(urls))), 256), F.lit(24))
