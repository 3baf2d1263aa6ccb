"""What the engine raises."""


class BadRequest(ValueError):
    """A parameter or an ingested point is not acceptable."""


class NoData(LookupError):
    """An instant lookup found no sample."""


class Conflict(RuntimeError):
    """Another writer of a store is in the way."""
