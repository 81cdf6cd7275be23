"""Cuts text at places where the byte-level pre-tokenizer always cuts.

A space before a character that is not white space always starts a new match of
the pattern, so the parts of a text can be encoded one by one and joined. Equal
parts repeat often: a bounded cache holds their ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: A space after which the text must not be cut.
_HELD = re.compile(r" (?=\s|$)")


def segments(text: str) -> tuple[str, list[str]]:
    """The first part, and the others without their leading space."""
    parts = text.split(" ")
    if _HELD.search(text) is None:
        return parts[0], parts[1:]
    out, held = [], parts[:1]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(" ".join(held))
            held = [p]
        else:
            held.append(p)
    out.append(" ".join(held))
    return out[0], out[1:]


class SegmentCache:
    """Ids of whole texts as little-endian int32 bytes.

    ``encode`` gives the ids of one string, ``sizes[id]`` a token's bytes. Segments
    not seen before are encoded in one string; the tokens' sizes tell where each
    ends. The cache keeps at most ``entries`` segments of up to ``longest``
    characters in two halves: when the newer is full it becomes the older, and what is
    used again moves back. It changes no result.
    """

    def __init__(self, encode: Callable[[str], np.ndarray], sizes: np.ndarray, entries: int = 300_000, longest: int = 64):
        self.encode, self.sizes, self.entries, self.longest = encode, sizes, entries, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.entries // 2:
            self.known, self.older = {}, self.known
        known, older, cut = self.known, self.older, [segments(t) for t in texts]
        missing = {s for _, rest in cut for s in rest if s not in known}
        again = missing & older.keys()
        known.update((s, older[s]) for s in again)
        new = list(missing - again)
        known.update(zip(new, self._each(new, " "), strict=True))
        whole = {h for h, _ in cut}
        plain = [h for h in whole if h and not h[0].isspace()]
        heads = dict(zip(plain, [b[4:] for b in self._each(plain, "\n")], strict=True))
        for h in whole - heads.keys():
            heads[h] = self.encode(h).astype("<i4").tobytes() if h else b""
        out = [b"".join([heads[h], *map(known.__getitem__, rest)]) for h, rest in cut]
        for s in new:
            if len(s) > self.longest:
                del known[s]
        return out

    def _each(self, parts: list[str], before: str) -> list[bytes]:
        """Ids of each part with ``before`` in front; a line end before a letter is a token of its own."""
        if not parts:
            return []
        ids = self.encode(before + before.join(parts))
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        stops = (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * 4
        flat, starts = ids.astype("<i4").tobytes(), [0, *stops[:-1].tolist()]
        return [flat[a:b] for a, b in zip(starts, stops.tolist(), strict=True)]
