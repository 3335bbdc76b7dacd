"""Reading typed employer and city names: what is a name's core, and what only surrounds it.

Everything specific to a collection is learned from its reference lists, which are fixed and small: the words
for a line of business and their Latin forms (names whose Latin names end alike share a Chinese ending), the
cities that precede a name, and the sound of each character (the split of Latin names into syllables that is
most consistent over all names).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame

#: Most entries of a reference list that is learned from.
LIST_ROWS = 100_000

# Legal forms, words around a name, and values that name no particular employer.
LEGAL = ("股份有限公司", "集团有限公司", "有限责任公司", "集团股份有限公司", "有限公司", "责任公司", "研究院", "研究所", "设计院", "集团", "公司", "总公司", "分公司", "总部", "总院", "厂", "院")
AROUND_END = ("校招组", "校园招聘组", "招聘组", "校招", "招聘", "人力资源部", "人事部", "hr")
AROUND_START = ("老", "原")
LATIN_LEGAL = ("coltd", "companylimited", "limited", "ltd", "co", "inc", "corp", "corporation", "group", "llc")
NOBODY = ("多家单位", "多家企业", "多家公司", "若干企业", "若干单位", "某单位", "某公司", "某企业", "某集团", "综合招聘会", "招聘会", "双选会", "详见正文", "见正文", "详见原文", "未注明", "未知", "未提供", "不详", "待定", "保密", "用人单位", "无", "暂无", "na", "null", "none")

INITIALS = "b p m f d t n l g k h j q x zh ch sh r z c s y w".split() + [""]
FINALS = "a o e i u v ai ei ao ou an en ang eng er ong ia ie iao iu ian in iang ing iong ua uo uai ui uan un uang ue ve".split()
SYLLABLES = {i + f for i in INITIALS for f in FINALS}


def plain(text: str) -> str:
    """Half-width, lower case, without invisible characters; blanks at either end removed."""
    out = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in text)
    return regex.sub(r"\p{Cf}", "", regex.sub(r"\s+", " ", out)).strip().lower()


def letters(text: str) -> str:
    return regex.sub(r"[^\p{L}\p{N}]+", "", text)


def near_typo(a: str, b: str) -> bool:
    """One slip at most: a letter too many, too few or wrong, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:] and len(x) > 1 and len(y) > 1)


@dataclass(frozen=True)
class Name:
    core: str
    industry: str  # the Chinese word, '' where none is given
    latin: bool
    alias: str = ""  # a Latin core given in brackets beside a Chinese one


class Lists:
    """What the reference lists teach."""

    def __init__(self, cities: list[tuple], units: list[tuple]):
        self.cities = {c[1]: c[0] for c in cities}
        self.provinces = sorted({c[2] for c in cities if c[2]}, key=len, reverse=True)
        by_end = defaultdict(list)
        for uid, name, latin, home in units:
            name = name or ""
            bare = self.without_legal(name[len(home) :] if home and name.startswith(home) else name)
            core, _, end = (latin or "").partition(" ")
            by_end[end.lower()].append((uid, bare, core.lower()))
        self.industries, self.core = {}, {}
        for end, rows in by_end.items():
            common = rows[0][1]
            for _, bare, _ in rows:
                while common and not bare.endswith(common):
                    common = common[1:]
            # a group of one teaches no ending; the rest of its name is its core
            common = common if len(rows) > 1 else common[len(common) // 2 :]
            if end and common:
                self.industries[common] = letters(end)
            for uid, bare, core in rows:
                self.core[uid] = (bare[: len(bare) - len(common)] if common else bare, core, common)
        self.sound = self._sounds([(c[1], (c[3] or "").lower()) for c in cities if c[1]] + [(z, la) for z, la, _ in self.core.values()])

    @staticmethod
    def without_legal(name: str) -> str:
        for end in sorted(LEGAL, key=len, reverse=True):
            if name.endswith(end) and len(name) > len(end) + 1:
                return name[: -len(end)]
            if name.endswith(end + end[-1]) and len(name) > len(end) + 2 and len(end) > 1:
                return name[: -len(end) - 1]
        return name

    @staticmethod
    def _splits(latin: str, k: int, memo: dict) -> list[tuple[str, ...]]:
        if k == 0:
            return [()] if not latin else []
        if (latin, k) not in memo:
            memo[latin, k] = [(latin[:n], *rest) for n in range(1, min(6, len(latin)) + 1) if latin[:n] in SYLLABLES for rest in Lists._splits(latin[n:], k - 1, memo)]
        return memo[latin, k]

    def _sounds(self, names: list[tuple[str, str]]) -> dict[str, str]:
        memo: dict = {}
        options = [(z, s) for z, la in names if (s := self._splits(la, len(z), memo))]
        score: dict = {}
        for _ in range(6):
            seen: Counter = Counter()
            for z, splits in options:
                best = max(splits, key=lambda s: sum(score.get(p, 0) for p in zip(z, s))) if score else None
                for s in [best] if best else splits:
                    for p in zip(z, s):
                        seen[p] += 1 / (1 if best else len(splits))
            score = dict(seen)
        out: dict[str, tuple[float, str]] = {}
        for (c, s), n in score.items():
            out[c] = max(out.get(c, (0, "")), (n, s))
        return {c: s for c, (_, s) in out.items()}

    def romanised(self, core: str) -> str:
        """The sound of a Chinese core; '?' for a character that the lists don't have."""
        return "".join(self.sound.get(c, "?") for c in core)

    def _industry_at_end(self, text: str) -> tuple[str, str]:
        """(rest, industry) of a name that ends with a line of business, whole, short or with one slip."""
        for w in sorted(self.industries, key=len, reverse=True):
            if text.endswith(w) and len(text) > len(w):
                return text[: -len(w)], w
        for w in sorted(self.industries, key=len, reverse=True):
            if len(w) >= 4:
                for n in (len(w), len(w) + 1, len(w) - 1):
                    if len(text) - n >= 3 and near_typo(text[-n:], w):
                        return text[:-n], w
        end = text[-2:]
        short = [w for w in self.industries if len(w) > 2 and len(end) == 2 and w[0] == end[0] and end[1] in w[1:]]
        if len(short) == 1 and len(text) >= 5:
            return text[:-2], short[0]
        return text, ""

    def parse(self, value: str | None) -> Name | None:
        """The parts of a typed employer name; None for a value that names nobody in particular."""
        text = plain(value or "")
        alias = ""
        for inside in regex.findall(r"\(([^()]*)\)", text):
            if regex.fullmatch(r"[a-z .,&'-]+", inside):
                alias = letters(inside)
            elif letters(inside) in NOBODY:
                return None
        text = regex.sub(r"\([^()]*\)", "", text)
        if letters(text) in NOBODY or not letters(text):
            return None
        if not regex.search(r"\p{Han}", text):
            return self._latin(text)
        ends = [letters(p) for p in text.split("·")]
        industry = ""
        if len(ends) == 2 and ends[0] in self.industries:
            industry, text = ends
        elif len(ends) == 2 and ends[1] in self.industries:
            text, industry = ends
        text = letters(text)
        for w in AROUND_END:
            if text.endswith(w) and len(text) > len(w) + 2:
                text = text[: -len(w)]
        text = self.without_legal(text)
        if text[:1] in AROUND_START and len(text) >= 4 and text[1:4] not in self.cities:
            text = text[1:]
        if not industry:
            text, industry = self._industry_at_end(text)
        for city in (text[:3], text[:2], text[:4]):
            if city in self.cities and len(text) - len(city) >= 2:
                text = text[len(city) :]
                if text.startswith("市") and len(text) > 3:
                    text = text[1:]
                break
        return Name(text, industry, False, alias) if text and text not in NOBODY else None

    def place(self, value: str | None) -> str:
        """The bare name of a typed city: without province, district, brackets and words around it; '' for a blank."""
        text = plain(value or "")
        text = letters(regex.sub(r"\([^()]*\)|\[[^\[\]]*\]|【[^】]*】", "", text)) or letters(text)
        if regex.search(r"\p{Han}", text):
            text = regex.sub(r"^(base|工作地点|工作地|地点|总部)(?=.)", "", text)
            for p in self.provinces:
                if text.startswith(p) and len(text) > len(p):
                    text = text[len(p) :]
                    break
            for city in (text[:3], text[:2], text[:4]):
                if city in self.cities:
                    return city  # a place inside a city counts as the city
            text = regex.sub(r"(?<=..)(市|地区)?(新区|开发区|高新区|东区|西区|南区|北区|中区|区|县)?$", "", text)
        return text

    def _latin(self, text: str) -> Name | None:
        flat = letters(text)
        changed = True
        while changed:
            changed = False
            for w in LATIN_LEGAL:
                if flat.endswith(w) and regex.search(rf"\b{w}\b|co\W+ltd|{w}$", text) and len(flat) > len(w) + 4 and regex.search(r"(?<=[\s,.])" + w[:2], text):
                    flat, changed = flat[: -len(w)], True
        for zh, en in sorted(self.industries.items(), key=lambda x: -len(x[1])):
            if flat.endswith(en) and len(flat) > len(en) + 2:
                return Name(flat[: -len(en)], zh, True)
        for zh, en in sorted(self.industries.items(), key=lambda x: -len(x[1])):
            for n in (len(en), len(en) - 1, len(en) + 1):
                if len(flat) > n + 3 and near_typo(flat[-n:], en):
                    return Name(flat[:-n], zh, True)
        return Name(flat, "", True)


def learned(cities: DataFrame, units: DataFrame) -> Lists:
    """Lists from the two reference tables, which are fixed; a table above LIST_ROWS is refused, not cut."""
    rows = []
    for df, cols in ((cities, ("city_id", "city_name", "province", "latin_name")), (units, ("unit_id", "unit_name", "latin_name", "home_city"))):
        got = df.select(*cols).where(f"{cols[1]} is not null").orderBy(cols[0]).limit(LIST_ROWS + 1).collect()
        if len(got) > LIST_ROWS:
            raise ValueError(f"a reference list has more than {LIST_ROWS} entries")
        rows.append([tuple(r) for r in got])
    return Lists(*rows)
