"""Admission of one key's hits in many tasks (T1): chunk maps and their composition.

Let ``A(i)`` be how many of a key's hits up to the i-th are admitted. The rule (fewer than
``limit`` admitted hits in the window before) says

    A(i) = min(A(i-1) + 1, A(p(i)) + limit)        p(i): the last hit older than the window

which is linear over (min, +). So what a time chunk admits behind any state is the least of
``limit + 1`` processes that start with no state: one at the chunk's first hit, and one for
the k-th last admitted time ``a_k`` before the chunk, which starts at the first hit that
``a_k`` is too old for, ``limit - k`` hits ahead. A chunk is at least as long as the window,
so these starts lie in its first window. A chunk's map is therefore a table with a row for
each hit there: how many hits the process that starts at it admits in the chunk, and the times
of the last ``limit`` of them. Two maps in a row compose to a map with the rows of the first.

A table is ``(at, count, last)``: row 0 starts at the first hit; row ``i`` is for states older
than the window at the first hit after time ``at[i]``; ``last`` has the admitted times from the
newest one on. Missing times are ``NONE``; a state is such a row of times.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).min // 2


def chunk_table(times: np.ndarray, begin: int, limit: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The map of a chunk from ``begin`` on whose hits are at ``times`` (rising, one at least)."""
    n = len(times)
    starts = int(np.searchsorted(times, begin + window, "left"))
    at = np.concatenate([[NONE], times[:starts]])
    free = np.searchsorted(times, times + window, "right")  # the first hit a time is too old for
    count = np.zeros(starts + 1, np.int64)
    last = np.full((starts + 1, limit), NONE, np.int64)
    lane, hit = np.arange(starts + 1), np.arange(starts + 1)
    # All processes in step: the k-th step admits each one's k-th hit.
    held = np.zeros((starts + 1, limit), np.int64)
    step = 0
    while True:
        alive = hit < n
        if not alive.all():
            lane, hit = lane[alive], hit[alive]
        if not len(lane):
            break
        held[lane, step % limit] = hit
        count[lane] += 1
        step += 1
        hit = hit + 1
        if step >= limit:
            hit = np.maximum(hit, free[held[lane, step % limit]])
    for back in range(limit):
        rows = np.flatnonzero(count > back)
        last[rows, back] = times[held[rows, (count[rows] - 1 - back) % limit]]
    return at, count, last


def step_states(states: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray],
                window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hits admitted, new states)`` of a chunk behind each row of ``states``."""
    at, count, last = table
    rows, limit = states.shape
    # Which process each held time starts; the free one starts at the first hit.
    start = np.searchsorted(at[1:], states + window, "right")
    start = np.column_stack([np.zeros(rows, np.int64), np.where(states > NONE, start, 0)])
    ahead = np.concatenate([[0], limit - np.arange(1, limit + 1)])
    total = count[start] + ahead
    admitted = total.min(axis=1)
    new = np.full((rows, limit), NONE, np.int64)
    for back in range(limit):
        # The process that is d hits ahead of the least one admitted this hit as its (back + d)-th last.
        place = total - admitted[:, None] + back
        own = np.where(place < limit, last[start, np.minimum(place, limit - 1)], NONE)
        here = back < admitted
        new[here, back] = own[here].max(axis=1)
        older = np.flatnonzero(~here)
        new[older, back] = states[older, back - admitted[older]]
    return admitted, new


def compose(first: tuple[np.ndarray, np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray, np.ndarray],
            window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The map of two chunks in a row."""
    at, count, last = first
    more, new = step_states(last, second, window)
    return at, count + more, new
