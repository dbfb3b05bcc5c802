"""Errors of the engine. They subclass the built-in ones a Python caller would expect."""


class InvalidArgument(ValueError):
    pass


class AlreadyExists(ValueError):
    pass


class NotFound(KeyError):
    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class FailedPrecondition(RuntimeError):
    pass


class Corruption(RuntimeError):
    pass
