"""What the engine does, for whoever wants to know: messages go to the logger ``waymark`` and to an action of one's own."""

from __future__ import annotations

import logging
from collections.abc import Callable

LOGGER = logging.getLogger("waymark")
LOGGER.addHandler(logging.NullHandler())


class _Action(logging.Handler):
    def __init__(self, action: Callable[[str, str, str], None]):
        super().__init__()
        self.action = action

    def emit(self, record: logging.LogRecord) -> None:
        self.action(record.name, record.levelname, record.getMessage())


def set_log_action(action: Callable[[str, str, str], None] | None) -> None:
    """``action`` gets (where, level, message) of every message from now on; none: no more."""
    for handler in [h for h in LOGGER.handlers if isinstance(h, _Action)]:
        LOGGER.removeHandler(handler)
    if action is not None:
        LOGGER.addHandler(_Action(action))
        LOGGER.setLevel(logging.DEBUG)
