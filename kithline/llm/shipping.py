"""The library's way to its workers, under the name that the operators here use."""

from kithline.shipping import ship

__all__ = ["ship"]
