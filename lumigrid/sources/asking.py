"""Requests to a slow remote model from inside a task: many at a time, each with a time limit, tried again if they fail."""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable

#: Requests under way at once, and seconds that one may take.
CONCURRENCY, TIMEOUT = 50, 60.0


def answers(ask: Callable[[object], object], requests: list, concurrency: int = CONCURRENCY, timeout: float = TIMEOUT, attempts: int = 2) -> list[tuple[object, Exception | None]]:
    """(answer, error) of each request, in order. A request that takes longer than `timeout` seconds has failed; its thread is
    left behind, and what it says later is not heard. A failed request is asked again, up to `attempts` times in all."""
    out: list[tuple[object, Exception | None]] = [(None, None)] * len(requests)
    waiting, active, said = deque((i, 1) for i in range(len(requests))), {}, queue.Queue()

    def call(token: object, request: object) -> None:
        try:
            said.put((token, ask(request), None))
        except Exception as e:  # the caller gets it beside its request
            said.put((token, None, e))

    def ended(token: object, answer: object, error: Exception | None) -> None:
        i, tries, _ = active.pop(token)
        if error is not None and tries < attempts:
            waiting.append((i, tries + 1))
        else:
            out[i] = (answer, error)

    while waiting or active:
        while waiting and len(active) < concurrency:
            i, tries = waiting.popleft()
            token = object()
            active[token] = (i, tries, time.monotonic() + timeout)
            threading.Thread(target=call, args=(token, requests[i]), daemon=True).start()
        try:
            token, answer, error = said.get(timeout=max(0.0, min(x[2] for x in active.values()) - time.monotonic()))
            if token in active:
                ended(token, answer, error)
        except queue.Empty:
            for token in [t for t, x in active.items() if x[2] <= time.monotonic()]:
                ended(token, None, TimeoutError(f"no answer in {timeout:g} seconds"))
    return out
