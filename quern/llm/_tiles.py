"""Tiled comparison of fingerprints by numpy exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quern.llm._text import mix

#: Side of the tiles that numpy compares.
BLOCK = 1024
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray, words: int) -> list[int]:
    """64-bit words of bits that over half of the hashes have set; words after the first are of the hashes mixed anew."""
    out = []
    for k in range(words):
        h = hashes if not k else mix(hashes + np.uint64(k))
        counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256) @ _BITS
        out.append(int(np.packbits((2 * counts > len(h)).ravel(), bitorder="little").view("<u8")[0]))
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose words lie along the last axis."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1], np.uint16)
    for k in range(a.shape[-1]):
        out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of rows i[k] and j[k]; root has each row's root, the least row of its tree, before and after."""
    i, j = root[i], root[j]
    ok = i != j
    i, j = i[ok], j[ok]
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root[root] != root).any():
            root[:] = root[root]
        ok = root[i] != root[j]
        i, j = i[ok], j[ok]


def near(left: np.ndarray, right: np.ndarray, prints: np.ndarray, pop: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of left and of right (both by ascending pop, the bits set) within radius, tile by tile."""
    for a in range(0, len(left), BLOCK):
        rows = left[a : a + BLOCK]
        for b in range(0, len(right), BLOCK):
            columns = right[b : b + BLOCK]
            if pop[columns[0]] - pop[rows[-1]] > radius or pop[rows[0]] - pop[columns[-1]] > radius:
                continue
            i, j = np.nonzero(distance(prints[rows][:, None], prints[columns][None]) <= radius)
            yield rows[i], columns[j]


def forest(home: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """Root of each row among the links of rows at home with rows at home and visitors.

    prints: a row of 64-bit words each. Roots are row numbers.
    """
    root = np.arange(len(prints))
    pop = np.bitwise_count(prints).sum(1, dtype=np.int64)
    order = np.argsort(pop, kind="stable")
    for i, j in near(order[home[order]], order, prints, pop, radius):
        unite(root, i, j)
    return root
