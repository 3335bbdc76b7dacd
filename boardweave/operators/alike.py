"""Candidate pairs for difflib's ratio and for containment, found without loss.

A ratio >= t of strings of T letters means M >= tT/2 matched letters in order, so at most D = T - 2M are unmatched.
Two bounds follow. Between two blocks of matched letters lies an unmatched one, so of the neighbouring pairs of letters
(ends count as letters) at least M + 1 - D occur in both strings, at places that differ by no more than the unmatched
letters: strings meet in one of their rarest pairs (prefix filter), and only nearby places are compared. And the
letters in which the strings differ flip at most D bits of a fingerprint with the parities of hashed letters.

A pair of letters that occurs more than SHARD_ROWS times is split into parts, of which every two meet in a cell of
their own, so no task holds all rows of a hot pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardweave.operators.planes import numbers, planes, steps, summed

#: Counters of hashed grams, which order them by rarity; any order is correct.
BUCKETS = 1 << 18
#: Slots of the filter of grams that are looked up.
SLOTS = 1 << 22
#: Rows of a pair of letters from which it is split, and rows that one task holds.
SHARD_ROWS, TASK_ROWS = 20_000, 1_000_000
#: Strings worked on at once; pairs compared at once; rows of a group up to which groups are compared together.
AT_ONCE, BLOCK, FEW = 1 << 15, 1 << 15, 32

#: What a block has of each row, and of each of its strings.
ROWS, STRINGS = (("shard", "<u4"), ("pos", "<u2"), ("rank", "<u2"), ("side", "u1"), ("place", "<u4")), (("id", "<u8"), ("len", "<u2"))
ROW = np.dtype([("shard", "<u4"), ("id", "<i8"), ("f", "<u8", (2,)), ("len", "<u2"), ("pos", "<u2"), ("rank", "<u2"), ("side", "u1")])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _grams(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, hash, place of every run of k letters."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    size = max(0, len(flat) - k + 1)
    ok = owner[:size] == owner[len(flat) - size :]
    h = np.zeros(size, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[i : i + size] + np.uint64(1))
    return owner[:size][ok], h[ok], place[:size][ok]


def _prints(texts: list[str]) -> np.ndarray:
    """128 parities of the letters of each string; the n-th occurrence of a letter is one of its own."""
    owner, h, _ = _grams(texts, 1)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])][: len(h)]
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(h) else at
    bit = _mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(128)
    out = np.zeros((len(texts), 2), np.uint64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
    one = np.uint64(1) << (bit % np.uint64(64))
    for w in range(2):
        if len(first):
            out[owner[first], w] = np.bitwise_xor.reduceat(np.where(bit // np.uint64(64) == w, one, np.uint64(0)), first)
    return out


def _counts(t: DataFrame, col: str, grams) -> np.ndarray:
    """How often the grams of each hash bucket occur. Bounded: BUCKETS numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            total += np.bincount((grams(pdf[col].tolist())[1] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    got = t.select(col).mapInPandas(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[got.bucket.to_numpy()] = got.n.to_numpy()
    return out


def _pairs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _grams(["\0" + t + "\1" for t in texts], 2)


def _rows(ids: np.ndarray, texts: list[str], counts: np.ndarray, t: float) -> np.ndarray:
    """The strings' rarest pairs of letters, each a row in its shard or in all cells of its part."""
    owner, h, pos = _pairs_of(texts)
    slot = (h % np.uint64(BUCKETS)).astype(np.int64)
    # equal pairs stay in the order of their places
    order = np.lexsort((pos, h, counts[slot], owner))
    owner, h, pos, slot = owner[order], h[order], pos[order], slot[order]
    size = np.array([len(x) for x in texts], np.int64)
    rank = np.arange(len(owner)) - (np.cumsum(size + 1) - size - 1)[owner]
    least = size + np.ceil(size * t / (2 - t) - 1e-9)  # letters of both, with the shortest partner
    keep = rank + np.ceil((1.5 * t - 1) * least + 1 - 1e-9)[owner] <= (size + 1)[owner]
    owner, h, pos, rank, k = owner[keep], h[keep], pos[keep], rank[keep], -(-counts[slot[keep]] // SHARD_ROWS)
    part = (_mix(ids.astype(np.uint64))[owner] % k.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(owner)), k)
    other = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
    lo, hi = np.minimum(part[at], other), np.maximum(part[at], other)
    out = np.zeros(len(at), ROW)
    out["shard"] = _mix(h[at] ^ _mix((lo * (1 << 24) + hi).astype(np.uint64))) & np.uint64(0xFFFFFFFF)
    who = owner[at]
    # 0: the cell of one part; 1 and 2: its first and its second part
    out["side"] = np.where(lo == hi, 0, np.where(part[at] == lo, 1, 2))
    out["id"], out["f"], out["len"] = ids[who], _prints(texts)[who], np.minimum(size[who], 65535)
    out["pos"], out["rank"] = np.minimum(pos[at], 65535), np.minimum(rank[at], 65535)
    return out


def _packed(r: np.ndarray, n: int) -> bytes:
    """Rows of one of n buckets, sorted by string, as a block that has each string once."""
    first = np.r_[True, r["id"][1:] != r["id"][:-1]]
    t = r[first]
    have = {"shard": r["shard"] // np.uint32(n), "pos": r["pos"], "rank": r["rank"], "side": r["side"], "place": steps((np.cumsum(first) - 1).astype("<u4"))}
    own = {"id": steps(t["id"].astype("<u8")), "len": t["len"]}
    head = np.array([len(r), len(t)], "<u4").tobytes()
    return b"".join([head, *[planes(have[k].astype(kind)) for k, kind in ROWS], *[planes(own[k]) for k, _ in STRINGS], t["f"].tobytes()])


def _unpacked(b: bytes) -> np.ndarray:
    n, k = (int(x) for x in np.frombuffer(b, "<u4", 2))
    out, at, place = np.zeros(n, ROW), 8, None
    for name, kind in ROWS:
        x, at = numbers(b, kind, n, at)
        if name == "place":
            place = summed(x)
        else:
            out[name] = x
    for name, kind in STRINGS:
        x, at = numbers(b, kind, k, at)
        out[name] = (summed(x).view("<i8") if name == "id" else x)[place]
    out["f"] = np.frombuffer(b, "<u8", 2 * k, at).reshape(k, 2)[place]
    return out


class _Search:
    """Pairs within shards that neither fingerprints nor places rule out."""

    def __init__(self, r: np.ndarray, t: float):
        self.r, self.t, self.found = r, t, []
        self.f, self.pos, self.len = r["f"], r["pos"].astype(np.int64), r["len"].astype(np.int64)
        self.near = np.minimum((1 - t) * self.len + 1e-6, 127).astype(np.uint8)

    def keep(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb, pa, pb = self.len[a], self.len[b], self.pos[a], self.pos[b]
        m = np.ceil(self.t * (la + lb) / 2 - 1e-9)
        c = 3 * m - la - lb + 1
        ok = (pa - pb <= la - m) & (pb - pa <= lb - m) & (self.r["rank"][a] + c <= la + 1) & (self.r["rank"][b] + c <= lb + 1)
        d = np.bitwise_count(self.f[a] ^ self.f[b]).sum(1, dtype=np.int64)
        ok = (ok | (np.maximum(la, lb) == 65535)) & ((d <= la + lb - 2 * m) | (np.maximum(la, lb) == 65535))
        self.found.append(np.stack([self.r["id"][a[ok]], self.r["id"][b[ok]]], 1))

    def small(self, start: np.ndarray, end: np.ndarray) -> None:
        """Pairs within many small groups, all groups at once."""
        n = end - start
        rows = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ends = np.repeat(end, n)
        for k in range(1, int(n.max()) if len(n) else 0):
            more = rows + k < ends
            rows, ends = rows[more], ends[more]
            d = np.bitwise_count(self.f[rows] ^ self.f[rows + k]).sum(1, dtype=np.int64)
            a = rows[d <= self.near[rows].astype(np.int64) + self.near[rows + k] + 1]
            self.keep(a, a + k)

    def cross(self, x: np.ndarray, y: np.ndarray, own: bool) -> None:
        """Pairs of x and y (own: within x), both in the order of their places, whose places can belong together."""
        shift = int(max(self.len[x].max(), self.len[y].max()) * (1 - self.t / (2 - self.t)) + 1e-6)
        if self.len[x].max() == 65535 or self.len[y].max() == 65535:
            shift = 65535
        px, py = self.pos[x], self.pos[y]
        fx, fy = self.f[x], np.ascontiguousarray(self.f[y].T)
        nx, ny = self.near[x], self.near[y] + np.uint8(1)
        rows = 64
        for i in range(0, len(x), rows):
            h = min(rows, len(x) - i)
            j0 = i if own else int(np.searchsorted(py, px[i] - shift, "left"))
            j1 = int(np.searchsorted(py, px[i + h - 1] + shift, "right"))
            for j in range(j0, j1, BLOCK // rows):
                e = min(j1, j + BLOCK // rows)
                d = np.bitwise_count(fx[i : i + h, :1] ^ fy[:1, j:e])
                d += np.bitwise_count(fx[i : i + h, 1:] ^ fy[1:, j:e])
                at = np.flatnonzero(d <= nx[i : i + h, None] + ny[None, j:e])
                if len(at):
                    a, b = at // (e - j) + i, at % (e - j) + j
                    if own:
                        a, b = a[a < b], b[a < b]
                    self.keep(x[a], y[b])

    def pairs(self) -> pd.DataFrame:
        p = np.concatenate(self.found or [np.zeros((0, 2), np.int64)])
        p = np.unique(np.sort(p, 1), axis=0)
        p = p[p[:, 0] != p[:, 1]]
        return pd.DataFrame({"a": p[:, 0], "b": p[:, 1]})


def _found(r: np.ndarray, t: float) -> pd.DataFrame:
    r = r[np.lexsort((r["pos"], r["side"], r["shard"]))]
    s = _Search(r, t)
    start = np.flatnonzero(np.r_[True, r["shard"][1:] != r["shard"][:-1]][: len(r)])
    end = np.r_[start[1:], len(r)].astype(np.int64)[: len(start)]
    few = end - start <= FEW
    s.small(start[few], end[few])
    for i, j in zip(start[~few].tolist(), end[~few].tolist()):
        side = r["side"][i:j]
        parts = [np.arange(i, j)[side == k] for k in range(3)]
        if len(parts[0]):
            s.cross(parts[0], parts[0], True)
        if len(parts[1]) and len(parts[2]):
            s.cross(parts[1], parts[2], False)
    return s.pairs()


def alike(t: DataFrame, col: str, threshold: float) -> DataFrame:
    """a, b: pairs of ids of t(id, col) that hold all those with a ratio >= threshold; blank strings are in none."""
    if not 2 / 3 <= threshold <= 1:
        raise ValueError(f"threshold {threshold} is not between two thirds and 1")
    spark = t.sparkSession
    t = t.where(F.col(col) != "").select("id", F.col(col).alias("s"))
    if threshold == 1:  # only equal strings
        return t.withColumnRenamed("id", "a").join(t.withColumnRenamed("id", "b"), "s").where("a < b").select("a", "b")
    counts = _counts(t, "s", _pairs_of)
    n = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // TASK_ROWS)))
    given = spark.sparkContext.broadcast(counts)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[i : i + AT_ONCE]
                r = _rows(part.id.to_numpy(), part.s.tolist(), given.value, threshold)
                to = r["shard"] % np.uint32(n)
                order = np.argsort(to, kind="stable")
                r, to = r[order], to[order]
                cuts = np.flatnonzero(np.diff(to)) + 1
                yield pd.DataFrame([(int(to[c]), _packed(x, n)) for c, x in zip(np.r_[0, cuts], np.split(r, cuts))] if len(r) else [], columns=["bucket", "block"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, blocks = None, []
        for pdf in batches:
            for b, block in zip(pdf.bucket.tolist(), pdf.block):
                if b != bucket and blocks:
                    yield _found(np.concatenate([_unpacked(x) for x in blocks]), threshold)
                    blocks = []
                bucket = b
                blocks.append(block)
        if blocks:
            yield _found(np.concatenate([_unpacked(x) for x in blocks]), threshold)

    return t.mapInPandas(rows, "bucket int, block binary").repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(search, "a bigint, b bigint")


def holding(t: DataFrame, col: str, least: int = 5) -> DataFrame:
    """a, b: ids of t(id, col) of which one may hold the other: b has the rarest run of ``least`` letters of a."""
    spark = t.sparkSession
    t = t.where(F.length(col) >= least).select("id", F.col(col).alias("s"))
    grams = lambda texts: _grams(texts, least)
    given = spark.sparkContext.broadcast(_counts(t, "s", grams))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            owner, h, _ = grams(pdf.s.tolist())
            order = np.lexsort((h, given.value[(h % np.uint64(BUCKETS)).astype(np.int64)], owner))
            owner, h = owner[order], h[order]
            first = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
            yield pd.DataFrame({"a": pdf.id.to_numpy()[owner[first]], "g": h[first].view(np.int64)})

    short = t.mapInPandas(heads, "a bigint, g bigint")
    asked = np.zeros(SLOTS, bool)
    asked[short.select(F.expr(f"cast(g & {SLOTS - 1} as int)").alias("at")).distinct().toPandas()["at"].to_numpy()] = True
    wanted = spark.sparkContext.broadcast(np.packbits(asked))

    def all_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = np.unpackbits(wanted.value).astype(bool)
        for pdf in batches:
            owner, h, _ = grams(pdf.s.tolist())
            ok = asked[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
            yield pd.DataFrame({"b": pdf.id.to_numpy()[owner[ok]], "g": h[ok].view(np.int64)}).drop_duplicates()

    return short.join(t.mapInPandas(all_of, "b bigint, g bigint"), "g").where("a <> b").select("a", "b")
