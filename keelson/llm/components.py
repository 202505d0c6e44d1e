"""Connected components, as the library has them."""

from __future__ import annotations

from keelson.operators.graph import components  # noqa: F401
