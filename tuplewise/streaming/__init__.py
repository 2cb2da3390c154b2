"""Rules over relations that grow: results that new tuples add, batch by batch."""

from .incremental import added_results, follow

__all__ = ["added_results", "follow"]
