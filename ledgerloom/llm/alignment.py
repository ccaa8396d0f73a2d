"""Edit distance between word sequences by banded alignment."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def _band(a: Sequence[Hashable], b: Sequence[Hashable], most: int) -> int:
    """Edit distance if at most ``most``, else more: only cells within ``most`` of the main diagonal are looked at.

    The band moves down one cell with each word of ``b``. The cells of a column are held as two integers, whose bits
    say where the distance rises or falls by one from a cell to the next, and advance together.
    """
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    width = 2 * most + 1
    full = (1 << width) - 1
    places: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << (i + most)
    rises, falls = ((1 << (most + 1)) - 1) << most, 0
    top = 1 << (width - 1)
    down = max(0, m - most)
    distance = most if m >= most else m
    row = 1 << (width - 2) if m >= most and width > 1 else 1 << (m - 1 + most) if m else 0
    for j, y in enumerate(b):
        equal = places.get(y, 0) >> j & full
        same = ((((equal & rises) + rises) ^ rises) | equal | falls) & full
        up = falls | ~(same | rises) & full
        left = same & rises
        if j < down:
            distance += not same & top
        else:
            distance += bool(up & row)
            distance -= bool(left & row)
            row >>= 1
        rises = left | ~((same >> 1) | up) & full
        falls = (same >> 1) & up
    return distance if distance <= most else most + 1


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable], most: int) -> int:
    """Edit distance (insert, delete, replace) if at most ``most``, else ``most + 1``.

    Common ends are taken off first; the band starts narrow and widens fourfold until it holds the distance.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_a and start < end_b and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a -= 1
        end_b -= 1
    a, b = a[start:end_a], b[start:end_b]
    if not a or not b:
        found = max(len(a), len(b))
        return found if found <= most else most + 1
    band = max(8, abs(len(a) - len(b)))
    while True:
        band = min(band, most)
        found = _band(a, b, band)
        if found <= band or band == most:
            return found
        band *= 4


def similar(a: Sequence[Hashable], b: Sequence[Hashable], percent: int = 80) -> bool:
    """Whether at least ``percent`` of the longer sequence's length remains after the edits."""
    longest = max(len(a), len(b))
    most = longest * (100 - percent) // 100
    return longest > 0 and edit_distance(a, b, most) <= most
