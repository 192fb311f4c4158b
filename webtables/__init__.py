"""webtables: web pages, request logs and chat logs as Spark tables.

Pages are parsed once into a pre-order ``nodes`` array (``operators.parse``);
text, links, metadata and selector matches are column expressions over that
array, so page conversion is one narrow stage with no shuffle. Request-log
statistics, retry resolution and TTL folds are DataFrame jobs over a log
derived from ``events``.
"""

from webtables.session import checkpoint_dir, configure

__all__ = ["configure", "checkpoint_dir"]
