"""Connected components, as the operators of this subpackage import them."""

from __future__ import annotations

from lodestone.graph import HOT, components, stars  # noqa: F401
