"""The errors of this package; all have one base."""

from __future__ import annotations


class MeridianError(Exception):
    """Base of all errors that name what went wrong with a source, a store or a request."""


class NotRegistered(MeridianError, KeyError):
    """A format, transport, store, writer or credential realm that nobody registered."""


class UnknownOption(MeridianError, ValueError):
    """An option that a reader does not take."""

    def __init__(self, reader: str, unknown, accepted):
        super().__init__(f"{reader}: unknown options {sorted(unknown)}; accepted: {sorted(accepted)}")
        self.unknown, self.accepted = sorted(unknown), sorted(accepted)


class NoSuchVariable(MeridianError, KeyError):
    """A variable or column that a file does not hold."""

    def __init__(self, absent, present):
        super().__init__(f"no variables {sorted(absent)}; present: {sorted(present)}")
        self.absent, self.present = sorted(absent), sorted(present)


class CacheMiss(MeridianError, LookupError):
    """An object is not in the cache and must not be fetched."""


class Offline(MeridianError, OSError):
    """A fetch was asked for while fetching is switched off."""


class AuthError(MeridianError, PermissionError):
    """Credentials that are needed are missing or were refused."""


class FetchError(MeridianError, OSError):
    """No candidate served the object; not_found only if every one surely lacks it."""

    def __init__(self, message, not_found):
        super().__init__(message)
        self.not_found = not_found


class IntegrityError(MeridianError, ValueError):
    """A cached object is not what its manifest says."""


class OutOfRange(MeridianError, IndexError):
    """A record that its file does not hold."""
