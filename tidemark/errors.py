"""Refusals: what is unknown or ambiguous is reported, never guessed."""


class Refused(ValueError):
    """Base of all refusals."""


class LookAhead(Refused):
    """A read without a knowledge date to bound it."""


class Fabrication(Refused):
    """An answer would have to be made up."""


class Drift(Refused):
    """A feed no longer has the shape that was agreed."""


class Ambiguous(Refused):
    """More than one company fits an identifier."""


class Straddle(Refused):
    """Figures under different accounting regimes were to be compared."""


class ControlCycle(Refused):
    """A company controls itself."""
