"""Callbacks around an ingest."""

from __future__ import annotations

from collections.abc import Callable

Hook = Callable[[str, object], None]


class Hooks:
    """Callbacks on the driver at before_ingest, after_parse, before_write and after_ingest; their errors are swallowed."""

    def __init__(self) -> None:
        self._by_event: dict[str, list[Hook]] = {}

    def on(self, event: str, hook: Hook) -> None:
        self._by_event.setdefault(event, []).append(hook)

    def fire(self, event: str, value: object = None) -> None:
        for hook in self._by_event.get(event, []):
            try:
                hook(event, value)
            except Exception:  # noqa: BLE001, S110  a hook must not stop the ingest
                pass
