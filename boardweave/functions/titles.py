"""Title functions, all built from Spark's own functions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardweave.functions import dims

NON_WORD = r"[^\p{L}\p{N}]+"


def text(c: Column) -> Column:
    """'' for a missing value."""
    return F.coalesce(c, F.lit(""))


def normalized(title: Column) -> Column:
    """Letters and digits of any script, in lower case."""
    return F.lower(F.regexp_replace(text(title), NON_WORD, ""))


def entity(title: Column) -> Column:
    """What remains without signs and stock words, longest words first, equally long ones by code point."""
    words = sorted(dims.ENTITY_STOPWORDS, key=lambda w: (-len(w), w))
    return F.lower(reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), words, F.regexp_replace(text(title), NON_WORD, "")))


def unwrapped(key: Column) -> Column:
    """A normalised title without its first matching column prefix and event suffix, where enough remains.

    Alternatives are tried in their order and one that leaves too little is passed over. A suffix is cut as a
    prefix of the reversed title, as only what lies ahead may be of any length. Two expressions, so the code stays small.
    """
    first = lambda words: f"^(?:{'|'.join(words)})(?=(?s:.{{{dims.UNWRAP_MIN}}}))"
    cut = F.regexp_replace(key, first(dims.WRAP_PREFIXES), "")
    return F.reverse(F.regexp_replace(F.reverse(cut), first([w[::-1] for w in dims.WRAP_SUFFIXES]), ""))


def classified(title: Column) -> Column:
    """Kind of post, by the first rule that applies."""
    t = text(title)
    has = lambda *ws: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in ws])
    return (
        F.when(has("实习"), "实习")
        .when(has("双选", "宣讲"), "双选会/宣讲会")
        .when(has("校招", "校园招聘", "应届生"), "校园招聘")
        .when(has("人才", "博士", "开放日") | F.contains(F.lower(t), F.lit("openday")), "人才引进/开放日")
        .otherwise("招聘")
    )


def date_key(date: Column) -> Column:
    return F.replace(text(date), F.lit("-"), F.lit(""))


class Brands:
    """Brand mentions, effective brands and the veto, for any alias table (brand, parent, aliases)."""

    def __init__(self, table=None, strict=dims.STRICT_ROOTS):
        table = table or dims.brand_table()
        parent = {b: p for b, p, _ in table}
        self.of = {a: b for b, _, names in table for a in names}
        self.pattern = "|".join(sorted(self.of, key=lambda a: (-len(a), a)))
        self.above = {}
        for b in parent:
            chain, at = [], parent.get(b, "")
            while at:
                chain.append(at)
                at = parent.get(at, "")
            self.above[b] = chain
        self.root = {b: (c[-1] if c else b) for b, c in self.above.items()}
        self.strict = strict

    @staticmethod
    def _map(d: dict, value) -> Column:
        return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), value(v))])

    def mentions(self, title: Column) -> Column:
        """Brands from left to right, the longest alias at each place."""
        found = F.regexp_extract_all(text(title), F.lit(self.pattern), F.lit(0))
        return F.array_distinct(F.transform(found, lambda a: self._map(self.of, F.lit)[a]))

    def effective(self, title: Column) -> Column:
        """Mentioned brands that are no ancestor of another mentioned one, sorted."""
        ms, above = self.mentions(title), self._map(self.above, lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>"))
        return F.array_sort(F.filter(ms, lambda b: ~F.exists(ms, lambda o: F.array_contains(above[o], b))))

    def veto(self, left: Column, right: Column) -> Column:
        """Whether two sets of effective brands forbid a match."""
        a, b = F.get(left, F.lit(0)), F.get(right, F.lit(0))
        above, root = self._map(self.above, lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")), self._map(self.root, F.lit)
        related = F.array_contains(above[a], b) | F.array_contains(above[b], a)
        single = (F.size(left) == 1) & (F.size(right) == 1) & (a != b)
        return F.coalesce(F.when(single, ~related | root[a].isin(*self.strict)), F.lit(False))
