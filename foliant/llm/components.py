"""Connected components, as the library has them."""

from ..operators.components import components

__all__ = ["components"]
