"""Errors of the library."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of the library."""


class InvalidArgument(EngineError, ValueError):
    """An argument or a batch that can't be applied; nothing has changed."""


class OutOfRange(InvalidArgument):
    """An id or a weight outside its range."""


class Unsupported(EngineError):
    """A combination of properties or options that doesn't exist."""


class StaleResult(EngineError):
    """The container has changed since the result was computed, or an update of the result failed."""


class Capacity(EngineError):
    """A count or a distance beyond 64 bits."""


class NotConverged(EngineError):
    """A limit of rounds was reached under the policy ``error``."""


class FileFormat(EngineError):
    """A file that isn't in its format."""


class Internal(EngineError):
    """An invariant that doesn't hold."""
