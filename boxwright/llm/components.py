"""Connected components, as the operators have them."""

from ..operators.components import components  # noqa: F401
