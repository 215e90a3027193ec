"""What can go wrong, from building a formula to evaluating it."""


class RhoscopeError(Exception):
    """Base of all errors of this package."""


class BindError(RhoscopeError):
    """A formula doesn't fit the traces or itself."""


class MissingVariable(BindError):
    """No column, or no value in a row, for a variable."""

    def __init__(self, name: str):
        self.name = name
        super().__init__(f"variable {name!r} is missing")


class NanCoefficient(BindError):
    """A predicate's coefficient is NaN."""

    def __init__(self, name: str):
        self.name = name
        super().__init__(f"the coefficient of {name!r} is NaN")


class EmptyConstraints(BindError):
    """A guard that a path needs has no constraint."""


class MetricMismatch(BindError):
    """Operands have different metrics."""


class MismatchedLengths(RhoscopeError):
    """Operands have different numbers of samples."""

    def __init__(self, left: int, right: int):
        self.left, self.right = left, right
        super().__init__(f"operands have {left} and {right} samples")


class MismatchedTimes(RhoscopeError):
    """Operands have samples at different times."""


class EmptyTrace(RhoscopeError):
    """A single value was asked of a trace without samples."""


class InvalidTrace(RhoscopeError):
    """Times are NULL or NaN, or repeat within a trace."""


class ParseError(RhoscopeError):
    """A text isn't a formula."""


class IncompleteParse(ParseError):
    """A formula ends before its text does."""

    def __init__(self, rest: str):
        self.rest = rest
        super().__init__(f"can't read from {rest!r} on")


class MissingPredicate(ParseError):
    """A formula names a predicate that isn't known."""

    def __init__(self, name: str):
        self.name = name
        super().__init__(f"no predicate is named {name!r}")
