"""The one error type that users of the command language see."""


class CommandError(ValueError):
    """A command that cannot be carried out, with a message that says why."""
