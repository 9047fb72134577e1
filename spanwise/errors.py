"""What can go wrong, by kind."""


class SpanwiseError(Exception):
    """Any error of this library."""


class ConfigError(SpanwiseError):
    """A configuration that can not be read or is not allowed."""


class DatasetError(SpanwiseError):
    """Cases that break the rules of their data set."""


class CorpusError(SpanwiseError):
    """Documents that can not be read."""


class HeldOutSplitError(SpanwiseError):
    """The test split was asked for without leave."""


class CacheMissError(SpanwiseError):
    """Work that must be in the cache is not."""


class OfflineViolation(SpanwiseError):
    """A call to the network while it is forbidden."""


class GenerationError(SpanwiseError):
    """No answer could be had."""


class QuotaExhausted(GenerationError):
    """The service answers no more; *completed* and *remaining* count requests."""

    def __init__(self, message: str, *, completed: int = 0, remaining: int = 0) -> None:
        super().__init__(message)
        self.completed, self.remaining = completed, remaining


class CitationParseError(SpanwiseError):
    """An answer whose citations can not be read."""
