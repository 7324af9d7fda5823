"""Answers only once something is built: refused before, failed if building failed."""

from __future__ import annotations

import threading
from collections.abc import Callable


class NotReady(Exception):
    """Asked before the build has ended; code is that of a service's answer."""

    code = 503


class Gate[T]:
    """Builds in the background; `get` gives what was built."""

    def __init__(self, build: Callable[[], T]) -> None:
        self._build, self._done = build, threading.Event()
        self._value: T | None = None
        self.error: str | None = None
        self._worker = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        try:
            self._value = self._build()
        except Exception as e:  # noqa: BLE001
            self.error = str(e)
        self._done.set()

    def start(self) -> Gate[T]:
        self._worker.start()
        return self

    @property
    def status(self) -> str:
        return "building" if not self._done.is_set() else "ready" if self.error is None else "failed"

    def wait(self, seconds: float | None = None) -> str:
        self._done.wait(seconds)
        return self.status

    def get(self) -> T:
        if self.status != "ready":
            raise NotReady(self.status if self.error is None else self.error)
        return self._value
