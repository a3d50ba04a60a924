"""The registered catalog queries; importing this package registers all of them."""

from . import analysis, capturing, queries, runs, sinking, vault, writing

__all__ = ["analysis", "capturing", "queries", "runs", "sinking", "vault", "writing"]
