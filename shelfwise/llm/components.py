"""Connected components, as the linking operators have them."""

from shelfwise.operators.components import components

__all__ = ["components"]
