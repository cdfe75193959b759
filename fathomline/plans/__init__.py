"""All queries: importing this package registers them."""

from fathomline.plans import bets, dimensions, feeds, games, models, names, queries, registry, views

__all__ = ["bets", "dimensions", "feeds", "games", "models", "names", "queries", "registry", "views"]
