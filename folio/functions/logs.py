"""What the library logs, and how to hear less of it."""

from __future__ import annotations

import logging

#: The loggers of what reads single objects, which say something for every one.
READERS = ("folio.sources.catalog",)


class WithoutReaders(logging.Filter):
    """Drops what the readers of objects log; warnings and errors pass."""

    def filter(self, record: logging.LogRecord) -> bool:
        return record.levelno >= logging.WARNING or not record.name.startswith(READERS)


def quiet_readers(handler: logging.Handler) -> logging.Handler:
    """Adds the filter to a handler and returns it."""
    handler.addFilter(WithoutReaders())
    return handler
