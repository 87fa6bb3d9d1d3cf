"""Graph operators by name: connected components, shortest paths and map matching."""

from .components import components, ready_to_checkpoint  # noqa: F401
from .matching import match_rides  # noqa: F401
from .routing import directed, shortest_paths  # noqa: F401
