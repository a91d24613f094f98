"""The package's logger: plain or as JSON lines, at a level of choice. Nothing is configured on import."""

from __future__ import annotations

import json
import logging
import sys
from typing import TextIO

NAME = "tidewatch"


class JsonLines(logging.Formatter):
    """A record as one line of JSON."""

    def format(self, record: logging.LogRecord) -> str:
        said = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            said["exception"] = self.formatException(record.exc_info)
        return json.dumps(said)


def get_logger(name: str | None = None) -> logging.Logger:
    return logging.getLogger(NAME if name is None else f"{NAME}.{name}")


def configure(level: int | str = logging.INFO, structured: bool = False, stream: TextIO | None = None) -> logging.Logger:
    """One handler on the package's logger, in place of those before."""
    logger = get_logger()
    for old in list(logger.handlers):
        logger.removeHandler(old)
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(JsonLines() if structured else logging.Formatter("%(message)s"))
    logger.addHandler(handler)
    logger.setLevel(level)
    logger.propagate = False
    return logger
