"""Errors raised for bad input; all are ValueErrors."""


class ManifestError(ValueError):
    """A manifest line, or a manifest as a whole, is not valid."""


class SummaryError(ValueError):
    """A run summary does not follow the schema."""


class ConfigError(ValueError):
    """A configuration or an override is not valid."""


class StagingError(ValueError):
    """A copy was refused or does not match its source."""
