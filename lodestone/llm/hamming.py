"""All pairs of fingerprints within some differing bits that lie in different components: exact.

A fingerprint is cut into segments, each with a radius, so that the radii plus one add up to one more than
the bits that may differ: by pigeonhole two fingerprints that are near lie within the radius in some
segment. Rows are sorted by the segment, and each looks up every value within its radius; what it finds
there is compared whole. Tiles of rows are compared with each other, so each task holds two of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import label

#: Rows of a tile at most, and tiles that there are at least where each has FEW rows.
TILE, TILES, FEW = 1_000_000, 4, 4096
#: A tile of so many rows has wider segments, of which there are fewer.
WIDER = 200_000
#: Rows found that are compared at a time.
_CHUNK = 1 << 16
#: The largest radius whose values are looked up.
_RADIUS = 4
#: Links that are gathered before their components are joined.
_LINKS = 1_000_000
#: Of more rows that a look-up finds, those of the same component are left out beforehand.
_MANY = 1024


def segments(bits: int, most: int, parts: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment; those that need none of their own are left out. Where radii were large, one segment without bits has all pairs."""
    width, wide = divmod(bits, parts)
    radius, more = divmod(most + 1, parts)
    if radius > _RADIUS:
        return [(0, 0, 0)]
    out, at = [], 0
    for k in range(parts):
        n = width + (k < wide)
        r = min(n, radius - (k >= more))
        if r >= 0:
            out.append((at, n, r))
        at += n
    return out


def masks(width: int, radius: int) -> np.ndarray:
    """All numbers of `width` bits of which `radius` or fewer are set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def _segment(prints: np.ndarray, at: int, width: int) -> np.ndarray:
    """The bits [at, at + width) of each row of uint64."""
    k, s = divmod(at, 64)
    x = prints[:, k] >> np.uint64(s)
    if s + width > 64:
        x = x | prints[:, k + 1] << np.uint64(64 - s)
    return (x & np.uint64((1 << width) - 1)).astype(np.int64)


def _found(x_key, x_comp, y_key, y_comp, width: int, radius: int, one: bool):
    """Yields (rows of x, rows of y), both sorted by key and component, whose keys are within the radius and whose components differ; of one and the same side each pair once."""
    start = np.zeros((1 << width) + 1, np.int32)
    np.cumsum(np.bincount(y_key, minlength=1 << width), out=start[1:])
    y_both = y_key << 32 | y_comp
    wait, many = [], 0

    def expand():
        i, s, n = (np.concatenate(c) for c in zip(*wait))
        for low in range(0, int(n.max(initial=0)), _CHUNK):  # a look-up that finds more than a chunk is taken in pieces
            m = np.clip(n - low, 0, _CHUNK)
            end = np.cumsum(m)
            first = 0
            while first < len(m):
                last = max(first + 1, int(np.searchsorted(end, (end[first - 1] if first else 0) + _CHUNK, "right")))
                k = m[first:last]
                q = np.repeat(s[first:last] + low - (np.cumsum(k) - k), k)
                q += np.arange(len(q))
                yield np.repeat(i[first:last], k), q
                first = last

    for mask in masks(width, radius).tolist():
        key = x_key ^ mask
        s = start[key].astype(np.int64)
        n = start[key + 1] - s
        if one:
            if mask:
                n[x_key >> (mask.bit_length() - 1) & 1 > 0] = 0  # the other row of the pair has the bit
            else:
                own = np.arange(len(key)) + 1
                n -= own - s
                s = own
        i = np.flatnonzero(n > 0)
        if not len(i):
            continue
        s, n = s[i], n[i]
        large = np.flatnonzero(n > _MANY)
        if len(large):
            both = key[i[large]] << 32 | x_comp[i[large]]
            low, high = (np.clip(np.searchsorted(y_both, both, side), s[large], s[large] + n[large]) for side in ("left", "right"))
            rest = s[large] + n[large] - high
            n[large] = low - s[large]
            i, s, n = np.r_[i, i[large]], np.r_[s, high], np.r_[n, rest]
        wait.append((i, s, n))
        many += int(n.sum())
        if many > _CHUNK:
            yield from expand()
            wait, many = [], 0
    if wait:
        yield from expand()


def links(x: np.ndarray, x_comp: np.ndarray, y: np.ndarray | None, y_comp: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components, as an edge list with the same components, that rows of x and y (rows x longs; y None: x itself) within `most` bits join."""
    one = y is None
    y, y_comp = (x, x_comp) if one else (y, y_comp)
    names, code = np.unique(np.concatenate([x_comp, y_comp]), return_inverse=True)
    comp, a, b = np.arange(len(names)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bits = 64 * x.shape[1]

    def joined(comp, new):
        """The components after these links, of which a star about the smallest of each is kept."""
        node, low = label(*np.concatenate(new, axis=1))
        a.append(node[node != low]), b.append(low[node != low])
        step = np.arange(len(names))
        step[node] = low
        return step[comp]

    for at, width, radius in segments(bits, most, bits // (16 if len(y) < WIDER else 19)):
        sides = []
        for prints, c in ((x, code[: len(x)]), (y, code[len(code) - len(y) :])):
            c = comp[c]
            key = _segment(prints, at, width)
            order = np.lexsort((c, key))
            sides.append((np.ascontiguousarray(prints[order].T), key[order], c[order]))
            if one:
                sides *= 2
                break
        (p, p_key, p_comp), (q, q_key, q_comp) = sides
        new, many = [], 0
        longs = sorted(range(len(p)), key=lambda k: k == at // 64)  # that of the segment, where they agree most, comes last
        for i, j in _found(p_key, p_comp, q_key, q_comp, width, radius, one):
            differ = np.zeros(len(i), np.int16)
            for n, k in enumerate(longs):
                differ += np.bitwise_count(p[k].take(i) ^ q[k].take(j))
                if 0 < n < len(longs) - 1:
                    some = np.flatnonzero(differ <= most)
                    i, j, differ = i[some], j[some], differ[some]
            c, d = comp[p_comp[i[differ <= most]]], comp[q_comp[j[differ <= most]]]
            if (c != d).any():
                new.append(np.unique(np.stack([c, d])[:, c != d], axis=1))
                many += new[-1].shape[1]
            if many > _LINKS:
                comp, new, many = joined(comp, new), [], 0
        if new:  # what is joined now needs no more comparing
            comp = joined(comp, new)
    return names[np.concatenate(a)], names[np.concatenate(b)]


def between(rows: DataFrame, names: list[str], most: int) -> DataFrame:
    """Edges (a, b) that join the components of rows (comp long, and the longs `names`) of which some are within `most` bits of each other."""
    count = rows.count()
    tiles = max(-(-count // TILE), min(TILES, -(-count // FEW)), 1)
    own = F.pmod(F.xxhash64(*names), F.lit(tiles)).cast("int")
    pairs = rows.withColumn("s", own).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    pairs = pairs.select(F.least("s", "t").alias("p"), F.greatest("s", "t").alias("q"), "s", "comp", *names)

    def run(table: pa.Table) -> pa.Table:
        prints = np.stack([table.column(n).to_numpy() for n in names], axis=1).view(np.uint64)
        comp, side = table.column("comp").to_numpy(), table.column("s").to_numpy()
        left = side == side.min()
        if left.all():
            # a pair of two tiles of which one is empty has nothing to compare
            one = table.column("p")[0].as_py() == table.column("q")[0].as_py()
            a, b = links(prints, comp, None, None, most) if one else (np.zeros(0, np.int64),) * 2
        else:
            a, b = links(prints[left], comp[left], prints[~left], comp[~left], most)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pairs.repartition(max(1, tiles * (tiles + 1) // 2), "p", "q").groupBy("p", "q").applyInArrow(run, "a long, b long")
