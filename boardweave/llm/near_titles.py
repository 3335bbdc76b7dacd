"""Near-duplicate titles: groups of titles that share about seven tenths of their neighbouring pairs of letters.

Method: vantage-point trees over Hamming fingerprints. A title's fingerprint holds, for each of BITS hash
slots, the parity of the number of its letter pairs that fall into the slot. One more or one less letter
pair flips one bit, so the Hamming distance of two fingerprints never exceeds the number of letter pairs
in which the titles differ: titles with similarity >= t over a and b pairs are at distance <= (1-t)(a+b).
Searching that radius therefore misses nothing; an exact check of the letter pairs follows.

A tree over the whole collection would visit most leaves (unrelated titles are all about equally far from
any vantage point), so the collection is first cut into shards that any two near titles share: the prefix
filter. Letter pairs are ordered by global rarity and a title stands in the shards of its rarest pairs only;
two titles within reach agree on at least one of them. Inside a shard a vantage-point tree prunes by the
triangle bound, down to leaves of LEAF rows; where the bound excludes less than PRUNES of a node's pairs, as it does
among unrelated titles, the node's pairs are compared as they are. Shards with more than a bounded number of rows
are split over the leaves of a tree fitted on a bounded sample, and over parts of a leaf: a row lives in one part of
one leaf and asks all parts of the other leaves that its search ball overlaps.

Defined results: null and blank titles, and titles of a single letter, are near nothing; equal forms (copies)
are one vertex; repeated rows change nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardweave.llm.blocks import AT_ONCE, BUCKETS, WORDS, bucket_keys, distances, letter_pairs, levels, mix, numbered, packed, prints_of, unpacked
from boardweave.llm.common import dropped, freed, partitions, salted_join, written
from boardweave.llm.components import components
from boardweave.llm.formatting import copy_classes, form_key, keyed

#: Similarity from which titles are near: 2 * common pairs / pairs of both.
THRESHOLD = 0.7
#: Rows from which a shard is split.
SHARD_ROWS = 20_000
#: Fingerprints on which the tree that splits large shards is fitted, and its leaves.
TREE_SAMPLE, TREE_LEAVES = 4_096, 64
#: Rows of a tree's leaf inside a shard, and the share of pairs that a vantage point must exclude to be used.
LEAF, PRUNES = 32, 0.1
#: Pairs compared at once, and those of rows that stand together.
BLOCK, STRETCH = 1 << 15, 1 << 17
#: Shard rows of a shuffle bucket: what one task sorts in memory at once.
ROWS_PER_BUCKET = 1_000_000
#: Buckets from which they are searched in rounds, and the rounds: blocks hold titles less often repeated where there are few
#: buckets, so few need no rounds; each round finds the prefixes again.
MANY_BUCKETS, ROUNDS = 48, 2
#: Candidates a title that are checked at once; their titles' texts stand in the shuffle with each of them.
CHECKED = 2

TITLE = np.dtype([("vid", "<i8"), ("size", "<u4"), ("f", "<u8", (WORDS,))])


def bucket_sums(df: DataFrame, buckets_of) -> np.ndarray:
    """Sums over all rows of how often buckets_of(batch) names each bucket. Bounded: BUCKETS numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            total += np.bincount(buckets_of(pdf), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    got = df.mapInPandas(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[got.bucket.to_numpy()] = got.n.to_numpy()
    return out


def pair_counts(titles: DataFrame) -> np.ndarray:
    """How often letter pairs of each bucket occur in all titles. Bounded: BUCKETS numbers."""
    return bucket_sums(titles.select("form"), lambda pdf: (letter_pairs(pdf.form)[1] % np.uint64(BUCKETS)).astype(np.int64))


def prefixes(forms, level: np.ndarray, threshold: float):
    """owner, bucket of h, token, rank of the rarest letter pairs of a batch of titles; size, prints of its titles."""
    owner, h, token = numbered(*letter_pairs(forms))
    prints = prints_of(owner, token, len(forms))
    size = np.bincount(owner, minlength=len(forms))
    slot = (h % np.uint64(BUCKETS)).astype(np.int64)
    # by title, rarity, then a hash of the token
    order = np.argsort((owner.astype(np.uint64) << np.uint64(48)) | (level[slot].astype(np.uint64) << np.uint64(36)) | (token >> np.uint64(28)), kind="stable")
    owner, slot, token = owner[order], slot[order], token[order]
    first = np.r_[0, np.cumsum(size)[:-1]] if len(size) else np.zeros(0, np.int64)
    rank = np.arange(len(owner)) - first[owner]
    keep = rank <= size[owner] - np.ceil(size[owner] * threshold / (2 - threshold) - 1e-9)
    return owner[keep], slot[keep], token[keep], rank[keep], size, prints


class Search:
    """Vantage-point search for all pairs of a shard within their radius."""

    def __init__(self, prints: np.ndarray, size: np.ndarray, rank: np.ndarray, threshold: float):
        self.f, self.size, self.rank, self.t = prints, size.astype(np.int64), rank.astype(np.int64), threshold
        # a row's part of the radius, and the same cut to bytes: distances have at most 64 * WORDS
        self.reach = (1 - threshold) * self.size + 1e-6
        self.near = np.minimum(self.reach, 64 * WORDS).astype(np.uint8)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.tried = self.used = self.pruned = self.compared = 0
        # what direct() and stretch() work in, made once
        self.word, self.dist, self.more, self.hit = (np.empty(BLOCK, t) for t in (np.uint64, np.uint8, np.uint8, bool))
        self.columns = self.large = None

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs that passed the fingerprints, those whose token lies in the prefix that their sizes ask for."""
        a, b = (np.concatenate([f[k] for f in self.found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        need = np.ceil(self.t * (self.size[a] + self.size[b]) / 2 - 1e-9)
        ok = (self.rank[a] + need <= self.size[a]) & (self.rank[b] + need <= self.size[b])
        return a[ok], b[ok]

    def direct(self, x: np.ndarray, y: np.ndarray, own: bool) -> None:
        """All pairs of x and y (own: within x) against their radius, in blocks that stay in the processor's cache."""
        self.compared += len(x) * (len(x) - 1) // 2 if own else len(x) * len(y)
        fx, fy = self.f[x], np.ascontiguousarray(self.f[y].T)
        nx, ny = self.near[x], self.near[y] + 1  # 2 * 128 + 1 doesn't fit into bytes, but then every pair is near
        full = int(nx.max()) + int(ny.max()) > 255
        wide = min(len(y), BLOCK)
        rows = max(1, BLOCK // wide)
        if own:
            rows = min(rows, max(LEAF, len(x) // 8))
        for i in range(0, len(x), rows):
            part = fx[i : i + rows]
            h = len(part)
            for j in range(i if own else 0, len(y), wide):
                other = fy[:, j : j + wide]
                w = other.shape[1]
                v, d, e, ok = (z[: h * w].reshape(h, w) for z in (self.word, self.dist, self.more, self.hit))
                np.bitwise_count(np.bitwise_xor(part[:, :1], other[:1], out=v), out=d)
                for k in range(1, WORDS):
                    np.bitwise_count(np.bitwise_xor(part[:, k : k + 1], other[k : k + 1], out=v), out=e)
                    np.add(d, e, out=d)
                if full:
                    ok = d <= nx[i : i + h, None].astype(np.int64) + ny[None, j : j + w]
                else:
                    np.less_equal(d, np.add(nx[i : i + h, None], ny[None, j : j + w], out=e), out=ok)
                at = np.flatnonzero(ok)
                if len(at):
                    a, b = at // w + i, at % w + j
                    if own:
                        a, b = a[a < b], b[a < b]
                    self.found.append((x[a], y[b]))

    def stretch(self, i: int, j: int, k: int, end: int, ahead: bool) -> None:
        """Rows i to j against rows k to end (ahead: each against those behind it up to end), without copies of them."""
        n = j - i
        self.compared += n * (end - i) - n * (n + 1) // 2 if ahead else n * (end - k)
        if self.columns is None:
            self.columns, self.large = np.ascontiguousarray(self.f.T), [np.empty(STRETCH, t) for t in (np.uint64, np.uint8, np.uint8, bool)]
        f, near, hit, passed, held = self.columns, np.minimum(self.near, 127), self.large[3], [], 0
        full = n and end > min(i, k) and self.near[min(i, k) : max(j, end)].max() > 127  # bytes don't hold the sum of two such radii
        while i < j:
            lo = i + 1 if ahead else k
            wide = min(max(1, end - lo), STRETCH)
            h = min(j - i, STRETCH // wide, max(LEAF, n // 8))
            nx = near[i : i + h, None] + np.uint8(1)
            for at in range(lo, end, wide):
                w = min(wide, end - at)
                v, d, e, ok = (z[: h * w].reshape(h, w) for z in self.large)
                np.bitwise_count(np.bitwise_xor(f[0, i : i + h, None], f[0, None, at : at + w], out=v), out=d)
                for word in f[1:]:
                    np.add(d, np.bitwise_count(np.bitwise_xor(word[i : i + h, None], word[None, at : at + w], out=v), out=e), out=d)
                if full:
                    ok[:] = True
                else:
                    np.less_equal(d, np.add(nx, near[None, at : at + w], out=e), out=ok)
                size = -(-h * w // 64) * 64  # few pairs pass: 64 are looked at at once
                hit[h * w : size] = False
                bits = np.packbits(hit[:size]).reshape(-1, 8)
                some = np.flatnonzero(bits.view(np.uint64))
                if len(some):
                    r, c = np.nonzero(np.unpackbits(bits[some], axis=1))
                    r = some[r] * 64 + c
                    passed.append((r // w + i, r % w + at))
                    held += len(r)
                    if held > STRETCH:
                        self._counted(passed, ahead)
                        passed, held = [], 0
            i += h
        if passed:
            self._counted(passed, ahead)

    def _counted(self, passed: list, ahead: bool) -> None:
        """Keep the pairs within their radius."""
        a, b = (np.concatenate([p[k] for p in passed]) for k in (0, 1))
        ok = np.bitwise_count(self.f[a] ^ self.f[b]).sum(1, dtype=np.int64) <= self.reach[a] + self.reach[b]
        if ahead:
            ok &= a < b
        self.found.append((a[ok], b[ok]))

    def leaves(self, start: np.ndarray, end: np.ndarray) -> None:
        """Pairs within each of many leaves (rows start to end, at most LEAF each), all leaves at once."""
        n = end - start
        rows = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        ends = np.repeat(end, n)
        self.compared += int((n * (n - 1) // 2).sum())
        for k in range(1, int(n.max()) if len(n) else 0):
            a = rows[rows + k < ends]
            d = np.bitwise_count(self.f[a] ^ self.f[a + k]).sum(1, dtype=np.int64)
            a = a[d <= self.reach[a] + self.reach[a + k]]
            if len(a):
                self.found.append((a, a + k))

    def radius(self, x: np.ndarray, y: np.ndarray) -> int:
        return int(self.reach[x].max() + self.reach[y].max())

    def shard(self, x: np.ndarray) -> None:
        """Pairs within the rows of a token.

        The smaller title of a near pair has the token among its rarest (1-t) size ones, so two rows that both
        have it further behind are no pair by this token.
        """
        front = self.rank[x] <= (1 - self.t) * self.size[x] + 1e-9
        a, b = x[front], x[~front]
        if len(a) > 1:
            self.own(a)
        if len(a) and len(b):
            self.cross(a, b)

    def own(self, x: np.ndarray) -> None:
        """Pairs within x."""
        if len(x) <= LEAF:
            return self.direct(x, x, True)
        self.tried += 1
        d = np.bitwise_count(self.f[x[:1]] ^ self.f[x]).sum(1, dtype=np.int64)
        r, least = self.radius(x, x), PRUNES * len(x) * (len(x) - 1) / 2
        order = np.sort(d)
        if (len(x) - np.searchsorted(order, order + r, "right")).sum() <= least:  # no split can exclude more
            return self.direct(x, x, True)
        mid = _best_split(d, d, r)
        near, far = x[d <= mid], x[d > mid]
        a, b = x[(d <= mid) & (d >= mid - r)], x[(d > mid) & (d <= mid + r)]
        rest = len(near) * len(far) - len(a) * len(b)
        if rest <= least:
            return self.direct(x, x, True)
        self.used, self.pruned = self.used + 1, self.pruned + rest
        self.own(near)
        self.own(far)
        if len(a) and len(b):
            self.cross(a, b)

    def cross(self, x: np.ndarray, y: np.ndarray) -> None:
        """Pairs of one of x and one of y."""
        if len(x) * len(y) <= LEAF * LEAF:
            return self.direct(x, y, False)
        self.tried += 1
        dx, dy = (np.bitwise_count(self.f[y[:1]] ^ self.f[z]).sum(1, dtype=np.int64) for z in (x, y))
        r = self.radius(x, y)
        order = np.sort(dy)
        if (len(y) - np.searchsorted(order, dx + r, "right") + np.searchsorted(order, dx - r)).sum() <= PRUNES * len(x) * len(y):
            return self.direct(x, y, False)
        mid = _best_split(dx, dy, r)
        parts = [(x[dx <= mid + r], y[dy <= mid]), (x[dx > mid - r], y[dy > mid])]
        rest = len(x) * len(y) - sum(len(a) * len(b) for a, b in parts)
        if rest <= PRUNES * len(x) * len(y):
            return self.direct(x, y, False)
        self.used, self.pruned = self.used + 1, self.pruned + rest
        for a, b in parts:
            if len(a) and len(b):
                self.cross(a, b)


def _best_split(dx: np.ndarray, dy: np.ndarray, r: int) -> int:
    """The distance from the vantage point at which a split of y leaves the fewest pairs of x and y within r of it."""
    n = 64 * WORDS + 1
    x, y = (np.cumsum(np.bincount(d, minlength=n)) for d in (dx, dy))
    v = np.arange(n)
    near = x[np.minimum(v + r, n - 1)] * y
    far = (x[-1] - np.where(v - r >= 0, x[np.maximum(v - r, 0)], 0)) * (y[-1] - y)
    return int(np.argmin(near + far))


def fit_tree(prints: np.ndarray) -> list[tuple]:
    """A vantage-point tree as a list of nodes (vantage print, radius, near, far); a child < 0 is leaf -child-1."""
    nodes: list = []
    leaves = 0

    def grow(x: np.ndarray, depth: int) -> int:
        nonlocal leaves
        d = distances(x[:1], x)[0] if len(x) else np.zeros(0, np.uint16)
        mid = int(np.median(d)) if len(d) else 0
        if depth == 0 or not (d > mid).any():
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(None)
        nodes[at] = (x[0], mid, grow(x[d <= mid], depth - 1), grow(x[d > mid], depth - 1))
        return at

    grow(prints, int(math.log2(TREE_LEAVES)))
    return nodes


def leaves_of(nodes: list[tuple], prints: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf that a row's ball overlaps; radius 0 gives each row its own leaf."""
    if not nodes:
        return np.arange(len(prints)), np.zeros(len(prints), np.int64)
    rows, leaves, todo = [], [], [(0, np.arange(len(prints)))]
    while todo:
        at, x = todo.pop()
        if at < 0:
            rows.append(x)
            leaves.append(np.full(len(x), -at - 1))
        elif len(x):
            v, mid, near, far = nodes[at]
            d = distances(v[None], prints[x])[0].astype(np.int64)
            todo += [(near, x[d - radius[x] <= mid]), (far, x[d + radius[x] > mid])]
    return np.concatenate(rows), np.concatenate(leaves)


def spread(token: np.ndarray, slot: np.ndarray, title: np.ndarray, vid: np.ndarray, size: np.ndarray, prints: np.ndarray, parts: np.ndarray, nodes: list, threshold: float):
    """row, shard, asks: where each prefix row lives, and for tokens of split shards the other places that it asks.

    parts is the number of parts of each token bucket. Of two rows in different places the one in the earlier place
    asks the later one, so every pair meets once.
    """
    k = parts[slot]
    hot = np.flatnonzero(k > 1)
    place = np.zeros(len(token), np.uint64)
    at, there = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(hot):
        who, back = np.unique(title[hot], return_inverse=True)
        order, own = leaves_of(nodes, prints[who], np.zeros(len(who), np.int64))
        home = np.empty(len(who), np.int64)
        home[order] = own
        part = (mix(vid[title[hot]].astype(np.uint64)) % k[hot].astype(np.uint64)).astype(np.int64)
        place[hot] = home[back] * (1 << 24) + part
        # a partner has at most size * (2-t)/t pairs, so this ball holds all partners
        reach = ((1 - threshold) * size[who] * (1 + (2 - threshold) / threshold) + 1e-9).astype(np.int64)
        row, leaf = leaves_of(nodes, prints[who], reach)
        by = np.argsort(row, kind="stable")
        row, leaf = row[by], leaf[by]
        first, n = np.searchsorted(row, np.arange(len(who))), np.bincount(row, minlength=len(who))
        # every leaf that the title overlaps, for each of its hot rows
        i = np.repeat(np.arange(len(hot)), n[back])
        leaf = leaf[np.repeat(first[back], n[back]) + np.arange(len(i)) - np.repeat(np.cumsum(n[back]) - n[back], n[back])]
        ok = leaf >= home[back][i]
        i, leaf = i[ok], leaf[ok]
        # and every part of these leaves
        m = k[hot][i]
        j = np.repeat(np.arange(len(i)), m)
        to = leaf[j] * (1 << 24) + np.arange(len(j)) - np.repeat(np.cumsum(m) - m, m)
        at, later = hot[i[j]], to > place[hot[i[j]]].astype(np.int64)
        at, there = at[later], to[later].astype(np.uint64)
    row = np.r_[np.arange(len(token)), at]
    shard = mix(token[row] ^ mix(np.r_[place, there])) & np.uint64(0xFFFFFFFF)
    return row, shard, np.r_[np.zeros(len(token), bool), np.ones(len(at), bool)]


def candidates(titles: DataFrame, threshold: float = THRESHOLD, watch=None) -> DataFrame:
    """a, b: pairs of titles whose fingerprints are within the radius; a superset of all near pairs.

    Many buckets are searched in rounds, each of which leaves only its pairs in a table.
    watch: an accumulator of numpy arrays, to which vantage points tried and used, and pairs pruned and compared, are added.
    """
    spark = titles.sparkSession
    counts = pair_counts(titles)
    parts = np.maximum(1, -(-counts // SHARD_ROWS))
    nodes: list = []
    if (parts > 1).any():
        sample = titles.select("form").orderBy(F.xxhash64("form"), "form").limit(TREE_SAMPLE).toPandas().form
        owner, _, token = numbered(*letter_pairs(sample))
        nodes = fit_tree(prints_of(owner, token, len(sample)))
    n = max(partitions(spark), -(-int(counts.sum()) // (2 * ROWS_PER_BUCKET)))
    rounds = ROUNDS if n >= MANY_BUCKETS else 1
    wide = -(-n // rounds)
    given = spark.sparkContext.broadcast((levels(counts), parts, nodes, bucket_keys(wide)))

    def rows(turn: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, parts, nodes, keys = given.value
        for pdf in batches:
            for i in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[i : i + AT_ONCE]
                owner, slot, token, rank, size, prints = prefixes(part.form, level, threshold)
                record = np.zeros(len(part), TITLE)
                record["vid"], record["size"], record["f"] = part.vid.to_numpy(), size, prints
                row, shard, asks = spread(token, slot, owner, record["vid"], size, prints, parts, nodes, threshold)
                bucket = (shard % np.uint64(n)).astype(np.int64)
                if rounds > 1:
                    mine = np.flatnonzero(bucket // wide == turn)
                    row, shard, asks, bucket = row[mine], shard[mine], asks[mine], bucket[mine]
                yield pd.DataFrame(packed(keys[bucket % wide], shard // np.uint64(n), rank[row], asks, owner[row], record), columns=["bucket", "block"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, blocks = None, []
        for pdf in batches:
            for b, block in zip(pdf.bucket.tolist(), pdf.block):
                if b != bucket and blocks:
                    yield pairs(blocks)
                    blocks = []
                bucket = b
                blocks.append(block)
        if blocks:
            yield pairs(blocks)

    def pairs(blocks: list) -> pd.DataFrame:
        r, t = unpacked(blocks, TITLE)
        r = r[np.argsort(r["shard"])]
        at = r["title"]
        s = Search(t["f"][at], t["size"][at], r["rank"], threshold)
        starts = np.flatnonzero(np.r_[True, r["shard"][1:] != r["shard"][:-1]])
        ends = np.r_[starts[1:], len(r)]
        asked = np.add.reduceat(r["asks"].astype(np.int64), starts) > 0
        small = (ends - starts <= LEAF) & ~asked
        s.leaves(starts[small], ends[small])
        for i, j, q in zip(starts[~small].tolist(), ends[~small].tolist(), asked[~small].tolist()):
            x = np.arange(i, j)
            if not q:
                s.shard(x)
                continue
            q = r["asks"][i:j]
            s.shard(x[~q])
            if not q.all():
                s.cross(x[q], x[~q])
        if watch is not None:
            watch.add(np.array([s.tried, s.used, s.pruned, s.compared]))
        a, b = (t["vid"][at[x]] for x in s.pairs())
        a, b = np.minimum(a, b), np.maximum(a, b)
        return pd.DataFrame({"a": a, "b": b})[a != b].drop_duplicates()

    def found(turn: int) -> DataFrame:
        blocks = titles.select("vid", "form").mapInPandas(partial(rows, turn), "bucket int, block binary")
        return blocks.repartition(wide, "bucket").sortWithinPartitions("bucket").mapInPandas(search, "a bigint, b bigint").repartition("a").dropDuplicates(["a", "b"])  # by a, as the join that follows

    if rounds == 1:
        return found(0)
    tables = []
    for turn in range(rounds):
        tables.append(written(found(turn)))
        freed(spark)
    return reduce(DataFrame.union, tables).repartition("a").dropDuplicates(["a", "b"])


def bag(form: str) -> set:
    """The letter pairs of a form; the n-th pair of a kind is an element of its own."""
    all_ = [form[i : i + 2] for i in range(len(form) - 1)]
    out = set(all_)
    if len(out) < len(all_):
        seen: dict = {}
        for p in all_:
            seen[p] = seen.get(p, 0) + 1
            if seen[p] > 1:
                out.add((p, seen[p]))
    return out


def hopeful(left: list, right: list, threshold: float) -> np.ndarray:
    """Whether forms may agree in enough letter pairs, counted by their hashes for all at once; never False for those that do."""

    def keys(texts: list) -> np.ndarray:
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(x) for x in texts])
        same = owner[1:] == owner[:-1]
        k = np.sort((owner[:-1][same] << np.uint64(40)) | (mix((flat[:-1][same] << np.uint64(21)) | flat[1:][same]) >> np.uint64(24)))
        again = np.flatnonzero(k[1:] == k[:-1]) + 1
        if len(again):  # the n-th pair of a kind is one of its own
            nth = again - np.searchsorted(k, k[again])
            k[again] = (k[again] >> np.uint64(40) << np.uint64(40)) | (mix(k[again] & np.uint64((1 << 40) - 1) ^ (nth.astype(np.uint64) << np.uint64(40))) >> np.uint64(24))
        return k

    ok = []
    for i in range(0, len(left), AT_ONCE):
        a, b = left[i : i + AT_ONCE], right[i : i + AT_ONCE]
        k = np.sort(np.concatenate([keys(a), keys(b)]))
        n = np.bincount((k[1:][k[1:] == k[:-1]] >> np.uint64(40)).astype(np.int64), minlength=len(a))
        size = np.array([max(0, len(x) - 1) + max(0, len(y) - 1) for x, y in zip(a, b)])
        ok.append(2 * n >= threshold * size - 1e-9)
    return np.concatenate(ok) if ok else np.zeros(0, bool)


def agreeing(left, right, threshold: float) -> list[bool]:
    """Whether forms agree in enough letter pairs, counted exactly."""
    bags: dict = {}
    left, right = list(left), list(right)
    ok = hopeful(left, right, threshold).tolist()
    for i in [i for i, may in enumerate(ok) if may]:
        s, t = left[i], right[i]
        x = bags.get(s)
        if x is None:
            x = bags[s] = bag(s)
        y = bags.get(t)
        if y is None:
            y = bags[t] = bag(t)
        ok[i] = 2 * len(x & y) >= threshold * (len(x) + len(y)) - 1e-9
    return ok


def similar(pairs: DataFrame, titles: DataFrame, threshold: float) -> DataFrame:
    """The pairs of titles that agree in enough letter pairs, counted exactly."""
    x, y = titles.select(F.col("vid").alias("a"), F.col("form").alias("fa")), titles.select(F.col("vid").alias("b"), F.col("form").alias("fb"))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[agreeing(pdf.fa, pdf.fb, threshold), ["a", "b"]]

    return pairs.hint("merge").join(x, "a").hint("merge").join(y, "b").mapInPandas(exact, "a bigint, b bigint")


def checked(pairs: DataFrame, titles: DataFrame, threshold: float) -> DataFrame:
    """similar() of the pairs of a written table, as many at once as keep the shuffle in proportion to the titles."""
    rounds = max(1, -(-pairs.count() // max(1, int(CHECKED * titles.count()))))
    if rounds == 1:
        return similar(pairs, titles, threshold)
    tables = []
    for turn in range(rounds):
        tables.append(written(similar(pairs.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == turn), titles, threshold)))
        freed(titles.sparkSession)
    return reduce(DataFrame.union, tables)


def near_links(titles: DataFrame, threshold: float = THRESHOLD, watch=None) -> DataFrame:
    """a, b: all pairs of titles (vid, form) with similarity >= threshold; vid must be unique."""
    return similar(candidates(titles, threshold, watch), titles, threshold)


def title_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """form, n, class_id, group_id of the different forms near others: the copies each belongs to and its group.

    class_id is the smallest id of its copies, group_id that of its group. Forms in no group of two have no row.
    A written table.
    """
    classes = copy_classes(df, id_col, text_col).select("form", "n", "copies", F.col("keep_id").alias("class_id"))
    forms = written(classes.withColumn("vid", F.monotonically_increasing_id()))
    # each step's shuffle goes before the next one's comes
    freed(df.sparkSession)
    met = written(candidates(forms, threshold))
    freed(df.sparkSession)
    links = checked(met, forms, threshold)
    several = forms.where("copies > n")
    same = several.groupBy("class_id").agg(F.min("vid").alias("a")).join(several, "class_id").select("a", F.col("vid").alias("b"))
    found = written(components(links.unionByName(same).select(F.col("a").alias("u"), F.col("b").alias("v"))))
    # keys in place of texts go through the join
    lean = forms.select("vid", "n", "class_id", form_key(F.col("form")).alias("form"))
    rooted = written(lean.join(found.withColumnRenamed("id", "vid"), "vid").drop("vid"))
    dropped(forms, found, met)
    freed(df.sparkSession)
    least = rooted.groupBy("root").agg(F.min("class_id").alias("group_id"))
    return written(rooted.join(least, "root").select("form", "n", "class_id", "group_id"))


def near_rows(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """id, class_id, group_id of each row whose title is near another title; singles and blank titles have no row."""
    groups = title_groups(df, id_col, text_col, threshold)
    several = groups.groupBy("group_id").agg(F.min("class_id").alias("c"), F.max("class_id").alias("d")).where("c <> d").select("group_id")
    kept = written(groups.join(several, "group_id"))
    dropped(groups)
    freed(df.sparkSession)
    return salted_join(keyed(df, id_col, text_col), kept, "form", "n").select("id", "class_id", "group_id")


def near_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """row_id_a, row_id_b: all pairs of rows of a group, smaller id first, but for copies of one title.

    Classes of copies are paired first, so pairs of copies are never made; then each pair of classes meets the
    rows of its two classes. Every row made here is a row of the result or stands for at least one.
    """
    rows = written(near_rows(df, id_col, text_col, threshold).distinct())
    classes = rows.select("class_id", "group_id").distinct()
    a, b = classes.toDF("ca", "group_id"), classes.toDF("cb", "group_id")
    pairs = a.join(b, "group_id").where("ca < cb").select("ca", "cb")
    x, y = rows.select(F.col("class_id").alias("ca"), F.col("id").alias("x")), rows.select(F.col("class_id").alias("cb"), F.col("id").alias("y"))
    out = pairs.join(x, "ca").join(y, "cb")
    return out.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))
