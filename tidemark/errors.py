"""The three kinds of failure a caller may tell apart."""


class InvalidArgument(ValueError):
    """The request can't ever succeed as it is."""


class Temporary(RuntimeError):
    """The request may succeed later."""


class Permanent(RuntimeError):
    """The table's state doesn't allow the request."""
