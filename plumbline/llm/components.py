"""Connected components of many links, as the core has them."""

from plumbline.operators.graph import components as connected
from plumbline.operators.graph import forest

__all__ = ["connected", "forest"]
