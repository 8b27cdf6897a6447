"""Refusals, each with a code that callers can rely on."""


class SemanticError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class FanoutError(SemanticError):
    """Rows of a measure's object would be repeated by a join."""

    def __init__(self, message: str):
        super().__init__("FANOUT", message)
