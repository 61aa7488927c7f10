"""SuperMinHash signatures of many sets at once.

Every element walks through a random permutation of the signature's slots, one step a
round; in round j it offers the value j + r, with r uniform in [0, 1), to the slot it
stands on, and a slot keeps the least offer. So the ranks of an element are correlated over
the slots, which lowers the variance, and a set stops early: once all its slots are filled,
later rounds can offer nothing smaller. All elements of a batch take a round together.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_GOLD, _A, _B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_LOW48 = U((1 << 48) - 1)
EMPTY = U(0xFFFFFFFFFFFFFFFF)
#: Elements that hold a permutation at once.
CHUNK = 150_000


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number for each 64-bit number."""
    x = (x ^ (x >> U(30))) * _A
    x = (x ^ (x >> U(27))) * _B
    return x ^ (x >> U(31))


def signatures(elements: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """One row of m slots a set; ``elements`` holds the sets' distinct hashes one after another."""
    n = len(sizes)
    sig = np.full(n * m, EMPTY)
    owner = np.repeat(np.arange(n), sizes)
    x = mix(elements + _GOLD)
    first = (x >> U(48)) % U(m)
    np.minimum.at(sig, owner * m + first.astype(np.int64), x & _LOW48)
    table = sig.reshape(n, m)
    open_ = (table == EMPTY).any(1) & (sizes > 0)
    # The rest of the rounds in chunks of whole sets, as each element now needs its permutation.
    todo = np.flatnonzero(open_)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(todo):
        took = np.cumsum(sizes[todo[at:]])
        k = max(1, int(np.searchsorted(took, CHUNK, side="right")))
        part = todo[at : at + k]
        place = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in part])
        _rounds(elements[place], np.repeat(part, sizes[part]), first[place].astype(np.int64), sig, table, m)
        at += k
    return table


def _rounds(elements: np.ndarray, owner: np.ndarray, first: np.ndarray, sig: np.ndarray, table: np.ndarray, m: int) -> None:
    kind = np.uint8 if m <= 256 else np.uint16
    perm = np.tile(np.arange(m, dtype=kind), (len(elements), 1))
    rows = np.arange(len(elements))
    perm[rows, first] = 0
    perm[rows, 0] = first
    for j in range(1, m):
        x = mix(elements + U((int(_GOLD) * (j + 1)) & int(EMPTY)))
        k = j + ((x >> U(48)) % U(m - j)).astype(np.int64)
        slot = perm[rows, k]
        perm[rows, k] = perm[rows, j]
        np.minimum.at(sig, owner * m + slot, (U(j) << U(48)) | (x & _LOW48))
        # A set is done when no slot could take an offer of the next round.
        live = (table[owner[np.r_[True, owner[1:] != owner[:-1]]]] >= U(j + 1) << U(48)).any(1)
        if not live.all():
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            keep = np.repeat(live, np.diff(np.r_[starts, len(owner)]))
            if not keep.any():
                return
            elements, owner, rows = elements[keep], owner[keep], rows[keep]


def bands(table: np.ndarray, rows: int) -> np.ndarray:
    """One key a band of ``rows`` slots."""
    n, m = table.shape
    b = m // rows
    key = np.broadcast_to(np.arange(1, b + 1, dtype=U) * _GOLD, (n, b)).copy()
    cut = table[:, : b * rows].reshape(n, b, rows)
    for j in range(rows):
        key = mix((key * _B) ^ cut[:, :, j])
    return key.view(np.int64)
