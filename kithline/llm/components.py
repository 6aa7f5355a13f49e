"""Connected components; see kithline.operators.components."""

from kithline.operators.components import components

__all__ = ["components"]
