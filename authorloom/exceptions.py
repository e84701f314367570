"""Errors and warnings of the engine."""


class DisambiguationError(Exception):
    """Base of all errors here."""


class InvalidRecordError(DisambiguationError):
    """A record fails validation."""


class SimilarityCalculationError(DisambiguationError):
    """A similarity cannot be computed."""


class GraphUpdateError(DisambiguationError):
    """A graph change is impossible."""


class ConfigurationError(DisambiguationError, ValueError):
    """Settings contradict each other or are out of range."""


class DataIntegrityError(DisambiguationError):
    """Outputs that must differ are equal, or the other way round."""


class PerformanceWarning(UserWarning):
    """A scope comes close to its limit."""
