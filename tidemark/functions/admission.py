"""Sliding-window admission by key: at most ``limit`` admitted events per window."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np


def admit(times: np.ndarray, held: list[int], limit: int, window: int
          ) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Decide events in time order. ``times`` and ``window`` are microseconds, ``held`` the
    admitted times still inside the window. Returns (admitted, retry_after_s, held).

    While the window is full, all events up to the next free slot are refused in one step, so
    the loop runs once per admitted event and not once per event.
    """
    n = len(times)
    admitted = np.zeros(n, dtype=bool)
    retry = np.zeros(n, dtype=np.int64)
    held, i = list(held), 0
    while i < n:
        now = times[i]
        while held and held[0] <= now - window:
            held.pop(0)
        if len(held) < limit:
            admitted[i] = True
            held.append(int(now))
            i += 1
            continue
        free = held[0] + window
        j = int(np.searchsorted(times, free, side="left"))
        j = max(j, i + 1)
        left = (free - times[i:j]) // 1_000_000
        retry[i:j] = np.maximum(1, left)
        i = j
    return admitted, retry, held


def admit_each(times: list[int], starts: Iterable[bool], held: deque, limit: int, window: int
               ) -> tuple[list[bool], list[int], deque]:
    """``admit`` for sorted events of many short stretches in one go, a few steps per event however many stretches
    there are; ``starts`` marks the first event of each, at which nothing is held."""
    admitted, retry = [], []
    for now, first in zip(times, starts):
        if first:
            held = deque()
        past = now - window
        while held and held[0] <= past:
            held.popleft()
        if len(held) < limit:
            held.append(now)
            admitted.append(True)
            retry.append(0)
        else:
            admitted.append(False)
            retry.append(max(1, (held[0] - past) // 1_000_000))
    return admitted, retry, held
