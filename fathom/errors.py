"""What can go wrong, by kind."""

from __future__ import annotations


class FathomError(Exception):
    """Base of all errors of this package."""


class DataValidationError(FathomError):
    """Input that can't be read or lacks required columns."""


class ConfigurationError(FathomError, ValueError):
    """Settings that make no sense."""


class ModelNotFoundError(FathomError):
    """No model under that name or path."""


class InsufficientDataError(FathomError, ValueError):
    """Series too short for the windows asked for."""


class TrainingError(FathomError):
    """A model could not be fitted."""


class NotReadyError(FathomError, ValueError):
    """A pipeline step was called before the step that it needs."""
