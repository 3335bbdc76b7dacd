"""Number columns as planes of bytes: the first bytes of all numbers, then the second ones, and so on.

Small numbers, and the steps of sorted ones, leave whole planes of zeros, which the shuffle's own compression removes.
"""

import numpy as np


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes()


def numbers(data: bytes, kind, n: int, at: int) -> tuple[np.ndarray, int]:
    """n numbers of a kind from planes that start at ``at``, and where they end."""
    wide = np.dtype(kind).itemsize
    x = np.frombuffer(data, np.uint8, n * wide, at).reshape(wide, n)
    return np.ascontiguousarray(x.T).view(kind).reshape(n), at + n * wide


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first from 0; they wrap around as unsigned numbers do."""
    return np.diff(x, prepend=x.dtype.type(0))


def summed(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)
