"""Simple-8b: varying counts of small integers in 64-bit words, coded and decoded for all blocks of a segment at once.

A word's top 4 bits select how many values it holds and with how many bits each. Ids are first replaced by their rank
by frequency within the segment, so that frequent ids take few bits. An id without a rank is an escape: a word of its own.
Blocks of BLOCK ids start at stored word offsets, so any block decodes alone and all blocks decode side by side.
"""

from __future__ import annotations

import numpy as np

BLOCK = 8192
ESCAPE = 1
#: Fixed values of the coding, by selector: values in a word, bits of a value. Selector 0 is a run of zeros, 1 the escape.
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: At most so many ids get a rank; others are escapes.
RANKS = 1 << 16


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int8)


def _selectors(values: np.ndarray, escaped: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each place the selector that holds most values from there on, within ``room`` values to the block's end."""
    n = len(values)
    width = _bits(values)
    width[escaped] = 99
    place = np.arange(n, dtype=np.int32)
    out = np.full(n, 15, np.int8)
    todo = ~escaped
    for s in (0, *range(2, 15)):
        # Where the next value stands that needs more bits: from the right, the smallest such place.
        wide = np.where(width > BITS[s], place, np.int32(n))
        nxt = np.minimum.accumulate(wide[::-1])[::-1]
        fits = todo & (nxt - place >= np.minimum(np.int32(COUNTS[s]), room))
        if s == 0:
            fits &= room >= COUNTS[0]  # a short run of zeros fits into other words
        out[fits] = s
        todo &= ~fits
    out[escaped] = ESCAPE
    return out


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids from the most to the least frequent, rank of each id); equal frequencies by id."""
    if int(ids.max()) < 1 << 22:
        times = np.bincount(ids)
        known = np.flatnonzero(times)
        order = known[np.lexsort((known, -times[known]))]
        rank = np.zeros(len(times), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return order.astype(np.uint32), rank[ids]
    known, back, times = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((known, -times))
    rank = np.empty(len(known), np.int32)
    rank[order] = np.arange(len(known), dtype=np.int32)
    return known[order].astype(np.uint32), rank[back]


def encode(ids: np.ndarray, block: int = BLOCK, ranks: int = RANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table of ids by rank, first word of each block and the end, words)."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    table, values = _ranked(ids)
    escaped = values >= ranks
    place = np.arange(n, dtype=np.int32)
    room = np.minimum(block - place % block, n - place).astype(np.int32)
    chosen = _selectors(values, escaped, room)
    taken = np.minimum(COUNTS[chosen], room)
    values = values.astype(np.uint64)

    # Walk all blocks in step: each turn every unfinished block writes one word.
    at, end = np.arange(0, n, block), np.minimum(np.arange(0, n, block) + block, n)
    turns, live = [], np.arange(len(at))
    while len(live):
        turns.append((live, at[live]))
        at[live] += taken[at[live]]
        live = live[at[live] < end[live]]
    of_block = np.concatenate([t[0] for t in turns])
    begin = np.concatenate([t[1] for t in turns])
    order = np.argsort(begin, kind="stable")
    of_block, begin = of_block[order], begin[order]
    words = chosen[begin].astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        mine = np.flatnonzero(chosen[begin] == s)
        for k in range(COUNTS[s]):
            has = mine[taken[begin[mine]] > k]
            if not len(has):
                break
            words[has] |= values[begin[has] + k] << np.uint64(k * BITS[s])
    mine = np.flatnonzero(chosen[begin] == ESCAPE)
    words[mine] |= ids[begin[mine]].astype(np.uint64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of_block, minlength=len(end)))])
    return table[:ranks], offsets, words


def decode(table: np.ndarray, offsets: np.ndarray, words: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids of all blocks; ``n`` is their number."""
    if not n:
        return np.zeros(0, np.uint32)
    selector = (words >> np.uint64(60)).astype(np.int64)
    room = COUNTS[selector]
    # The last word of a block may hold fewer values than its selector says.
    total = np.concatenate([[0], np.cumsum(room)])
    place = total[:-1] - np.repeat(total[offsets[:-1]], np.diff(offsets)) + np.repeat(np.arange(len(offsets) - 1) * block, np.diff(offsets))
    end = np.repeat(np.minimum(np.arange(1, len(offsets)) * block, n), np.diff(offsets))
    out = np.zeros(n, np.uint32)
    out[:] = table[0] if len(table) else 0
    for s in range(2, 16):
        mine = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s]):
            has = mine[place[mine] + k < end[mine]]
            if not len(has):
                break
            out[place[has] + k] = table[((words[has] >> np.uint64(k * BITS[s])) & mask).astype(np.int64)]
    mine = np.flatnonzero(selector == ESCAPE)
    out[place[mine]] = (words[mine] & np.uint64((1 << 60) - 1)).astype(np.uint32)
    return out
