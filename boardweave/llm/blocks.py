"""Shard rows of titles, shuffled as blocks: letter-pair arrays, fingerprints, and their packed form.

A title stands in many shards, so one JVM row per title and shard would cost far more than the search itself.
A Python task therefore packs what it sends to one shuffle bucket into a single binary row: the different titles
once, and per shard row the shard, the title's place in the block, and its rank. How many blocks there are goes
with the input and the buckets; a bucket holds a bounded number of shard rows (near_titles.ROWS_PER_BUCKET).
"""

from __future__ import annotations

import numpy as np

from boardweave.operators.planes import numbers, planes, steps, summed

#: Size of the table of counts that orders tokens by rarity; any order is correct, a good one is fast.
BUCKETS = 1 << 18
#: Bits of a fingerprint, as 64-bit words.
WORDS = 2
#: Titles that are worked on at once.
AT_ONCE = 1 << 15
#: Bits of a letter pair's hash that are used, so that a title's number fits beside it into 64 bits.
PAIR_BITS = 48
#: Number of the packed form, for blocks that are kept.
FORMAT = 2

ROW = np.dtype([("shard", "<u4"), ("rank", "<u4"), ("asks", "?"), ("title", "<u4")])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def letters_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """(title number, code point) of every letter of a batch of titles."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.repeat(np.arange(len(codes)), [len(c) for c in codes]), np.concatenate(codes).astype(np.uint64)


def letter_pairs(texts) -> tuple[np.ndarray, np.ndarray]:
    """(title number, hash) of every neighbouring pair of letters of a batch of titles."""
    owner, flat = letters_of(texts)
    same = owner[1:] == owner[:-1]
    return owner[:-1][same], mix((flat[:-1][same] << np.uint64(21)) | flat[1:][same]) >> np.uint64(64 - PAIR_BITS)


def numbered(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, h and token of letter pairs, sorted by owner; the n-th pair of a kind in a title is a token of its own."""
    order = np.argsort((owner.astype(np.uint64) << np.uint64(PAIR_BITS)) | h)
    owner, h = owner[order], h[order]
    start = np.ones(len(owner), bool)
    start[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    at = np.arange(len(owner))
    nth = at - np.maximum.accumulate(np.where(start, at, 0)) if len(at) else at
    return owner, h, mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prints_of(owner: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """The fingerprints of n titles: for each hash slot the parity of the number of its tokens. owner is sorted."""
    out = np.zeros((n, WORDS), np.uint64)
    if len(owner):
        bit = (token >> np.uint64(20)) % np.uint64(64 * WORDS)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        one = np.uint64(1) << (bit % np.uint64(64))
        for w in range(WORDS):
            out[owner[first], w] = np.bitwise_xor.reduceat(np.where(bit // np.uint64(64) == w, one, np.uint64(0)), first)
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """Rarity of counts, finely graded at every size of the collection."""
    return (16 * np.log2(counts + 1.0)).astype(np.uint16)


def packed(bucket: np.ndarray, shard: np.ndarray, rank: np.ndarray, asks: np.ndarray, title: np.ndarray, titles: np.ndarray) -> list[tuple[int, bytes]]:
    """(bucket, block): the rows of each bucket with the records (an array of a structured type) of their titles.

    Ranks are cut to 16 bits, which only lets more pairs through to the exact check. Numbers are kept as planes of bytes,
    places and a record's vid as steps, as most of a block is compressed away then but fingerprints.
    """
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    out = []
    for at in np.split(order, cuts) if len(order) else []:
        own, place = np.unique(title[at], return_inverse=True)
        head = np.array([len(at), len(own)], "<u4").tobytes()
        rows = [planes(shard[at].astype("<u4")), planes(np.minimum(rank[at], 65535).astype("<u2")), np.packbits(asks[at]).tobytes(), planes(steps(place.astype("<u4")))]
        of = titles[own]
        out.append((int(bucket[at[0]]), b"".join([head, *rows, *[_field(of[name], name) for name in titles.dtype.names]])))
    return out


def _field(x: np.ndarray, name: str) -> bytes:
    if name == "vid":
        return planes(steps(x.astype("<u8")))
    return planes(x) if x.ndim == 1 else x.tobytes()


def unpacked(blocks, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(rows, titles) of blocks, one after the other; a row's title is its place among all these titles."""
    rows, titles, base = [], [], 0
    for b in blocks:
        n, k = np.frombuffer(b, "<u4", 2)
        n, k, at = int(n), int(k), 8
        r = np.empty(n, ROW)
        r["shard"], at = numbers(b, "<u4", n, at)
        r["rank"], at = numbers(b, "<u2", n, at)
        r["asks"] = np.unpackbits(np.frombuffer(b, np.uint8, -(-n // 8), at), count=n)
        at += -(-n // 8)
        place, at = numbers(b, "<u4", n, at)
        r["title"] = summed(place) + np.uint32(base)
        t = np.empty(k, kind)
        for name in kind.names:
            of = kind[name]
            if of.shape:
                t[name] = np.frombuffer(b, of.base, k * of.shape[0], at).reshape(k, -1)
                at += k * of.itemsize
            else:
                x, at = numbers(b, "<u8" if name == "vid" else of, k, at)
                t[name] = summed(x).view(of) if name == "vid" else x
        rows.append(r)
        titles.append(t)
        base += k
    return (np.concatenate(rows), np.concatenate(titles)) if rows else (np.zeros(0, ROW), np.zeros(0, kind))


def bucket_keys(n: int) -> np.ndarray:
    """One number for each of n shuffle partitions, which Spark's hash sends there: buckets spread evenly."""
    v = np.arange(max(64, 32 * n), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    turned = lambda x, k: ((x << np.uint64(k)) | (x >> np.uint64(32 - k))) & low
    # Spark's hash of an int: the public 32-bit Murmur3 with seed 42
    h = turned(v * np.uint64(0xCC9E2D51) & low, 15) * np.uint64(0x1B873593) & low
    h = (turned(h ^ np.uint64(42), 13) * np.uint64(5) + np.uint64(0xE6546B64)) & low
    h ^= np.uint64(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor) & low
    h ^= h >> np.uint64(16)
    to = h.astype(np.uint32).view(np.int32).astype(np.int64) % n
    at, first = np.unique(to, return_index=True)
    if len(at) < n:
        raise ValueError(f"no key found for each of {n} partitions")
    return v[first].astype(np.int32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all rows of a to all rows of b."""
    d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for w in range(1, a.shape[1]):
        d = d + np.bitwise_count(a[:, None, w] ^ b[None, :, w]).astype(np.uint8 if 64 * a.shape[1] < 256 else np.uint16)
    return d
