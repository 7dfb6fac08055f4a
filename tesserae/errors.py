"""Errors by kind of fault; each is also the built-in class that callers expect."""


class FormatError(ValueError):
    """A header or file breaks the format's rules."""


class RequestError(OSError, ValueError):
    """A request that its target cannot serve, found only when both are known."""


class UnsupportedError(NotImplementedError):
    """A sample type or codec that is not available."""
