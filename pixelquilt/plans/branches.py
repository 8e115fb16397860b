"""Several chains of operators over one source: equal beginnings are found by fingerprint and computed once.

A step's fingerprint is a hash of the one before it, the operator's name and the values of all its
parameters in the order of their declaration, after snapping and with defaults filled in.  So two
chains agree up to a step just where their fingerprints do, however their parameters were written.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter

from pixelquilt.plans import registry
from pixelquilt.plans.raster import Raster
from pixelquilt.plans.scratch import materialize

Step = tuple[str, dict] | str
#: The hash that an untouched source begins with.
ROOT = "0" * 16


def params_hash(name: str, given: dict | None = None, defaults: dict | None = None) -> str:
    """16 hex digits that stand for an operator's parameters; equal for values that snap to the same."""
    op = registry.get(name).with_defaults(**(defaults or {}))
    values = op.values(**(given or {}))
    return hashlib.sha256(struct.pack(f"<{len(values)}d", *[v + 0.0 for v in values.values()])).hexdigest()[:16]


def fingerprints(chain: list[Step], source: str = ROOT) -> list[str]:
    """A fingerprint for each step of a chain of one-image operators."""
    out = []
    for step in chain:
        name, given = (step, {}) if isinstance(step, str) else step
        source = hashlib.sha256(f"{source} {name} {params_hash(name, given)}".encode()).hexdigest()[:16]
        out.append(source)
    return out


def run_all(raster: Raster, chains: dict[str, list[Step]]) -> dict[str, Raster]:
    """Each chain's result.  A step that more than one chain has, and after which they part or end, is
    written to a scratch table once and read by all of them; chains that are equal throughout share
    one result."""
    prints = {n: fingerprints(c) for n, c in chains.items()}
    users = Counter(f for own in prints.values() for f in own)
    #: What comes after a step in any chain; None: a chain ends there.
    after: dict[str, set] = {}
    for own in prints.values():
        for f, following in zip(own, [*own[1:], None]):
            after.setdefault(f, set()).add(following)
    done: dict[str, Raster] = {}

    def at(name: str, i: int) -> Raster:
        if i < 0:
            return raster
        f = prints[name][i]
        if f not in done:
            out = registry.run(at(name, i - 1), chains[name][i])
            shared = users[f] > 1 and (None in after[f] or len(after[f]) > 1)
            done[f] = out.with_pixels(materialize(out.pixels, "shared"), out.fmt) if shared else out
        return done[f]

    return {n: at(n, len(c) - 1) for n, c in chains.items()}
