"""Text and links of article pages."""

import html
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from boardweave.functions import dims
from boardweave.functions.titles import text

ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def plain_text(fragment: Column) -> Column:
    """The text of an HTML fragment; common entities only, see unescaped() for all."""
    steps = [(r"(?is)<script\b.*?</script>", " "), (r"(?is)<style\b.*?</style>", " "), (r"(?i)<(?:br|/p|/section|/h[1-6]|/li|/tr)[^>]*>", "\n"), (r"<[^>]+>", " ")]
    t = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text(fragment))
    t = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), ENTITIES, t)
    t = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), [("[ \\t\u00a0\u200b]+", " "), (" ?\\n ?", "\n"), ("\\n{2,}", "\n")], t)
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def unescaped(c: Column) -> Column:
    """All HTML entities, by Arrow batches."""

    @F.pandas_udf("string")
    def every(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: html.unescape(x) if x is not None else None)

    return every(c)


def content_block(page: Column) -> Column:
    """The balanced <div> whose id is js_content, to the end of the page where it never closes, '' where it is absent."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tag = regex.compile(r"<(/?)div\b|<(/)div>")

        def one(p):
            at = (p or "").find('id="js_content"')
            if at < 0:
                return ""
            begin, level = p.rfind("<div", 0, at), 0
            begin = max(begin, 0)
            for m in tag.finditer(p, begin):
                closing = m.group(1) == "/" or m.group(2) == "/"
                level += -1 if closing else 1
                if level == 0:
                    return p[begin : p.find(">", m.start()) + 1]
            return p[begin:]

        for s in batches:
            yield s.map(one)

    return cut(c_text(page))


def c_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def image_links(page: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c_text(page), F.lit('data-src="([^"]+)"'), F.lit(1)))


def source_link(page: Column) -> Column:
    return F.regexp_extract(c_text(page), "msg_source_url\\s*=\\s*['\"]([^'\"]*)", 1)


def blocked(page: Column) -> Column:
    """Whether a page is a verification or removal notice."""
    return reduce(lambda a, b: a | b, [F.contains(c_text(page), F.lit(m)) for m in dims.BLOCK_MARKERS])
