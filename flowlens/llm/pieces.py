"""Cutting texts into pieces that a byte-level tokenizer treats independently.

The byte-level pre-tokenizer never joins a single space to what stands before
it. So a text may be cut before every space that follows a non-space
character: each piece gives the same tokens alone as in its text. Words recur,
so the values of pieces are looked up in a cache; the cache is bounded and is
emptied when full.
"""

from __future__ import annotations

#: Longer pieces are not cached (a text without spaces is one piece).
CACHED_CHARS = 64
#: Entries of a worker's cache; about 200 bytes each.
CACHE_ENTRIES = 1 << 20


def cut(text: str) -> list[str]:
    """Pieces; all but the first without the space that they begin with."""
    parts = text.split(" ")
    out = parts[:1]
    for p in parts[1:]:
        if not out[-1] or out[-1][-1].isspace():
            out[-1] += " " + p
        else:
            out.append(p)
    return out


class PieceCache:
    """Values of a text's pieces. ``compute`` maps a list of pieces (with
    their leading space) to a list of values."""

    def __init__(self, compute, entries: int = CACHE_ENTRIES):
        self.compute, self.entries = compute, entries
        self.held: dict = {}

    def texts(self, texts: list[str | None]) -> list[list]:
        """For each text the values of its pieces, in order. The values are
        looked up in the plain split at spaces first: a piece that is empty or
        ends in white space is never held, so a text that needs the careful
        cut always shows a miss."""
        get = self.held.get
        out: list[list] = []
        missed: list[tuple[int, list[str]]] = []
        missing: dict = {}
        for t in texts:
            if not t:
                out.append([])
                continue
            parts = t.split(" ")
            first = parts[0]
            values = list(map(get, parts))
            # the first piece has no leading space: never taken from the cache
            values[0] = None
            lost = [p for p, v in zip(parts, values, strict=True) if v is None] if None in values[1:] else parts[:1]
            if any(not p or p[-1].isspace() for p in lost[: len(lost) if len(parts) > 1 else 0]):
                parts = cut(t)
                first = parts[0]
                values = list(map(get, parts))
                lost = [p for p, v in zip(parts[1:], values[1:], strict=True) if v is None]
            else:
                lost = lost[1:]
            missed.append((len(out), parts))
            missing.update(dict.fromkeys(lost))
            values[0] = first
            out.append(values)
        if missing:
            new = list(missing)
            fresh = dict(zip(new, self.compute([" " + p for p in new]), strict=True))
            for i, parts in missed:
                values = out[i]
                if None in values:
                    values[1:] = [fresh[p] if v is None else v for p, v in zip(parts[1:], values[1:], strict=True)]
            if len(self.held) + len(fresh) > self.entries:
                self.held.clear()
            self.held.update((p, v) for p, v in fresh.items() if len(p) <= CACHED_CHARS and p and not p[-1].isspace())
        firsts = self.compute([out[i][0] for i, _ in missed])
        for (i, _), v in zip(missed, firsts, strict=True):
            out[i][0] = v
        return out
