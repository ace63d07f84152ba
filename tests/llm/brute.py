"""Plain single-machine versions of the operators, to test against."""

from __future__ import annotations

import hashlib


def repeated_spans(texts: list[str | None], length: int) -> list[list[tuple[int, int]]]:
    """Maximal removed runs of each text."""
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    name = lambda s: s if length < 64 else hashlib.blake2b(s, digest_size=16).digest()
    for r in raws:
        for p in range(len(r) - length + 1):
            k = name(r[p : p + length])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for r in raws:
        runs: list[list[int]] = []
        for p in range(len(r) - length + 1):
            if seen[name(r[p : p + length])] > 1:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + length
                else:
                    runs.append([p, p + length])
        out.append([tuple(x) for x in runs])
    return out
