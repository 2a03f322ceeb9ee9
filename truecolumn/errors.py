"""Exceptions raised by the library."""


class TrueColumnError(Exception):
    """Base class of every error raised here."""


class SchemaError(TrueColumnError):
    """A header, a mapping, a type or a value does not fit the table."""


class ExistingTableError(TrueColumnError):
    """The target table is already there; it is never replaced silently."""


class LoadError(TrueColumnError):
    """Converted rows could not be written to the target."""


class ReadCancelled(TrueColumnError):
    """The user stopped a running profile or validation."""


class CleanupError(TrueColumnError):
    """A failed load could not remove what it had begun to write."""
