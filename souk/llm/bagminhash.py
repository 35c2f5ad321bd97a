"""BagMinHash signatures of word-shingle multisets, on whole Arrow batches.

The weight axis of an element is cut into the dyadic intervals [0,1), [1,2),
[2,4), ... Each (element, interval) has one Poisson process over time, with
rate (slots x interval's width), whose points carry a slot and a place inside
the interval; a point belongs to a multiset if the place is below the
element's weight there. Everything about a point is a hash of (element,
interval, number), so equal elements have equal points in all documents. A
slot's value is its earliest point; two multisets agree in a slot with
probability equal to their weighted Jaccard similarity.

Points are drawn in time order and only up to a limit at which all slots are
likely to be filled, (ln slots + 3) / (total weight): the number of points is
about the same for short and long texts. A document with an empty slot is done
again with twice the limit.

Texts are hashed in chunks of about ``CHUNK`` bytes with vector operations: words
by a polynomial over their bytes, shingles over their words' hashes.
"""

from __future__ import annotations

import math

import numpy as np

SHINGLE, SLOTS, BANDS, ROWS = 5, 128, 25, 5
CHUNK = 1 << 20

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


_IS_WORD = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_LETTER = mix(np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], _U) * _GOLD + _U(1))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            t = np.full(max(n, CHUNK + 1), _U(base))
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document number) of every word of the texts data[offsets[i]:offsets[i+1]]."""
    data = data[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    is_word = _IS_WORD[data]
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    first = offsets[:-1][(offsets[:-1] < n)]
    begins[first] = is_word[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = is_word[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    power, inverse = _power_tables(n)
    total = np.cumsum(_LETTER[data] * power[:n], dtype=_U)
    before = np.where(starts > 0, total[starts - 1], _U(0))
    h = mix((total[stops] - before) * inverse[starts] + (stops - starts + 1).astype(_U) * _GOLD)
    return h, np.searchsorted(offsets, starts, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle hash, occurrence from 0), sorted; a text of fewer words is one shingle."""
    h, doc = word_hashes(data, offsets)
    factors = mix(np.arange(1, k + 1, dtype=_U) * _GOLD) | _U(1)
    per = np.bincount(doc, minlength=len(offsets) - 1)
    m = max(len(h) - k + 1, 0)
    s = np.zeros(m, _U)
    for i in range(k):
        s += h[i:i + m] * factors[i]
    whole = doc[:m] == doc[k - 1:k - 1 + m]
    s, owner = mix(s[whole]), doc[:m][whole]
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        at = np.searchsorted(doc, short)
        extra = np.array([mix(np.array([(h[a:a + per[d]] * factors[:per[d]]).sum(dtype=_U) + _U(int(per[d]))], _U))[0]
                          for a, d in zip(at, short)], _U)
        s, owner = np.concatenate((s, extra)), np.concatenate((owner, short))
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    occurrence = np.arange(len(s)) - np.repeat(run, np.diff(np.append(run, len(s))))
    return owner, s, occurrence


def elements(owner, s, occurrence) -> np.ndarray:
    """One distinct 64-bit number per occurrence: multiset overlap as set overlap."""
    return mix(s + mix(occurrence.astype(_U) * _GOLD + _U(7))).view(np.int64)


def signatures(owner, s, occurrence, n_docs: int, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(values as uint64[n_docs, slots], total weight of each document); rows of empty documents are 0."""
    weight = np.bincount(owner, minlength=n_docs).astype(np.float64)
    last = np.ones(len(s), bool)
    last[:-1] = occurrence[1:] == 0
    doc, element, w = owner[last], s[last], occurrence[last] + 1
    # element x dyadic interval: level 0 is [0,1), level l is [2^(l-1), 2^l)
    levels = np.where(w > 1, np.frexp(w - 1.0)[1] + 1, 1)
    row = np.repeat(np.arange(len(w)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    process = mix(element[row] + level.astype(_U) * _U(0xA0761D6478BD642F))
    doc, w = doc[row], w[row].astype(np.float64)
    out = np.zeros((n_docs, slots), _U)
    limit = np.divide(math.log(slots) + 3, weight, out=np.zeros(n_docs), where=weight > 0)
    todo = weight > 0
    while todo.any():
        use = todo[doc]
        _earliest(process[use], doc[use], low[use], width[use], w[use], limit, slots, out)
        limit = limit * 2
        todo = todo & (out == 0).any(axis=1)
    return out, weight.astype(np.int64)


def _earliest(process, doc, low, width, w, limit, slots, out) -> None:
    """Write the id of each slot's earliest point up to ``limit`` into ``out``; ids are never 0."""
    found = []
    rate, time, number, block = slots * width, np.zeros(len(process)), 0, 1
    while len(process):
        at = process[:, None] + np.arange(number + 1, number + block + 1, dtype=_U) * _GOLD
        point = mix(at)
        t = time[:, None] + np.cumsum(-np.log(uniform(point)), axis=1) / rate[:, None]
        end = limit[doc]
        hit, col = np.nonzero(t <= end[:, None])
        ident = mix(point[hit, col] ^ _U(0xE7037ED1A0B428DB)) | _U(1)
        place = low[hit] + np.floor(uniform(mix(ident)) * width[hit])
        inside = place < w[hit]
        found.append((doc[hit][inside], ident[inside], t[hit, col][inside]))
        time, number = t[:, -1], number + block
        on = time <= end
        process, doc, low, width, w, rate, time = (x[on] for x in (process, doc, low, width, w, rate, time))
        block = min(7 if number == 1 else block * 8, 448)
    d, ident, t = (np.concatenate(x) for x in zip(*found))
    slot = (mix(ident + _GOLD) >> _U(20)) % _U(slots)
    order = np.argsort(t)[::-1]                          # the earliest is assigned last and stays
    out[d[order], slot[order].astype(np.int64)] = ident[order]


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """int64[n, bands]: a hash of each band's rows and its number."""
    factors = mix(np.arange(1, rows + 1, dtype=_U) * _GOLD) | _U(1)
    part = values[:, :bands * rows].reshape(len(values), bands, rows)
    return mix((part * factors).sum(axis=2, dtype=_U) + np.arange(1, bands + 1, dtype=_U) * _GOLD).view(np.int64)


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Ranges of documents of about ``size`` bytes (a longer document is alone)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
