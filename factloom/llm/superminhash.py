"""SuperMinHash signatures of many sets at once.

Element e of a set draws, step by step, a random permutation of the slots; at step
j it offers slot p[j] the value j + u. Ranks of one element are so correlated
over the slots that each slot is offered each step once, which lowers the
variance of the estimated similarity. A set stops at the step at which all of
its slots have values below it: later steps cannot lower any slot.
"""

from __future__ import annotations

import numpy as np

from factloom.llm import text_kernels as tk

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Elements whose permutations are held at once.
SLICE = 1 << 16


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int) -> np.ndarray:
    """Signatures (sets x slots) of sets given by 64-bit elements and the set of each.
    Slots of an empty set are infinite.

    Elements are offered SLICE at a time, so that a task holds SLICE permutations however
    long a text is; minima of slices are minima of the whole.
    """
    out = np.full(sets * slots, np.inf)
    owner = owner.astype(np.int64)
    for lo in range(0, len(elements), SLICE):
        _offer(out, elements[lo : lo + SLICE], owner[lo : lo + SLICE], slots)
    return out.reshape(sets, slots)


def _offer(out: np.ndarray, elements: np.ndarray, own: np.ndarray, slots: int) -> None:
    """Lowers the slots of ``out`` to the values that the elements offer."""
    active = np.arange(len(elements))
    low = int(own.min())
    near = out[low * slots : (int(own.max()) + 1) * slots]
    own = own - low
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(active), 1))
    for j in range(slots):
        draw = tk.mix(elements[active] + np.uint64((j + 1) * int(_STEP) % 2**64))
        value = (draw >> np.uint64(12)).astype(np.float64) * 2.0**-52 + j
        k = j + ((draw & np.uint64(0xFFF)) * np.uint64(slots - j) >> np.uint64(12)).astype(np.int64)
        row = np.arange(len(active))
        slot = order[row, k].astype(np.int64)
        order[row, k] = order[:, j]
        np.minimum.at(near, own[active] * slots + slot, value)
        stay = (near.reshape(-1, slots).max(1) >= j + 1)[own[active]]
        if not stay.all():
            active, order = active[stay], order[stay]
            if not len(active):
                break


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash for each of ``bands`` equal parts of each signature."""
    sets, slots = signature.shape
    rows = slots // bands
    bits = signature[:, : bands * rows].copy().view(np.uint64).reshape(sets, bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _STEP, (sets, bands)).copy()
    for k in range(rows):
        out = tk.mix(out ^ bits[:, :, k])
    return out
