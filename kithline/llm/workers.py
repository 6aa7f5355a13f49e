"""What Python workers keep from task to task.

A worker outlives its task and serves the next operator's tasks.  What it keeps for one operator, and free memory
that it does not hand back, adds to an executor's memory for as long as it lives, idle or not.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]

_KEPT: dict[str, dict] = {}


def free() -> None:
    """Hand unused memory back to the system: Arrow's pages, and the allocator's that numpy and Python use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def kept(owner: str) -> dict:
    """The tables that this worker keeps for the owner, an operator; those of others are let go."""
    others = [k for k in _KEPT if k != owner]
    for k in others:
        del _KEPT[k]
    if others:
        free()
    return _KEPT.setdefault(owner, {})


def sole(owner: str, run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, in workers that keep the owner's tables only and hand back what the task leaves."""

    def tidied(batches: Batches) -> Batches:
        kept(owner)
        yield from run(batches)
        free()

    return tidied
