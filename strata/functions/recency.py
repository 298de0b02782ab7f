"""Recency lists: values as places in a list of those last used, most recent first."""

from __future__ import annotations


def encode(values: list[int], slots: int = 8) -> list[tuple[int, int]]:
    """(place, value) of each value: its place in the list, or -1 where it isn't there."""
    held, out = [], []
    for v in values:
        place = held.index(v) if v in held else -1
        out.append((place, v))
        if place >= 0:
            held.pop(place)
        held.insert(0, v)
        del held[slots:]
    return out


def decode(codes: list[tuple[int, int]], slots: int = 8) -> list[int]:
    """Inverse of encode(); the value is read only where the place is -1."""
    held, out = [], []
    for place, v in codes:
        v = held.pop(place) if place >= 0 else v
        out.append(v)
        held.insert(0, v)
        del held[slots:]
    return out
