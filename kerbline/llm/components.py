"""Connected components of a large graph: the core library's operator."""

from ..operators.components import components

__all__ = ["components"]
