"""How large arrays are cut: chunk shapes under a byte target, and slabs for block-wise work."""

from __future__ import annotations

import math
from collections.abc import Sequence

from ..options import option


def guess_chunks(dims: Sequence[int], item_bytes: int = 8, target_mib: float | None = None) -> tuple[int, ...]:
    """A chunk shape of about the target: the axes are halved in turn, the longest first."""
    target = (target_mib or option("write.chunk_target_mib")) * 2**20
    out = [max(1, int(d)) for d in dims]
    while math.prod(out) * item_bytes > target and max(out) > 1:
        k = out.index(max(out))
        out[k] = -(-out[k] // 2)
    return tuple(out)


def reduce_chunks(chunks: Sequence[int], item_bytes: int, limit_bytes: float) -> tuple[int, ...]:
    """The same shape cut along its first axes until it is under a limit."""
    out = list(chunks)
    for k in range(len(out)):
        while math.prod(out) * item_bytes > limit_bytes and out[k] > 1:
            out[k] = -(-out[k] // 2)
    return tuple(out)


def auto_block_size(dims: Sequence[int], item_bytes: int = 8, target_bytes: float | None = None) -> dict[str, tuple[int, int, int]]:
    """A slab (nx, ny, 1) under the target, y halved and then x, and how many of it there are on each axis."""
    target = target_bytes or option("memory.target_slab_bytes")
    x, y, z = (max(1, int(d)) for d in dims)
    sx, sy = x, y
    while sx * sy * item_bytes > target and sy > 1:
        sy = max(1, sy // 2)
    while sx * sy * item_bytes > target and sx > 1:
        sx = max(1, sx // 2)
    return {"slab": (sx, sy, 1), "iterate": (-(-x // sx), -(-y // sy), z)}
