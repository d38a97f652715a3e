"""The one family of errors that the engine raises for bad input."""


class EngineError(Exception):
    """A statement or call that can't be carried out; nothing has been changed."""


class DialectError(EngineError):
    """Text that isn't a statement."""


class BindError(EngineError):
    """Names or values that don't fit the tables."""
