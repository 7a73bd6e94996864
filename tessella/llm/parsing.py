"""Content-defined parsing of byte texts: which triggers, which phrases, whatever the position in the text.

A trigger is a string of TRIGGER bytes. In every window of ``span`` bytes the trigger with the least rolling hash (the first
of equals) is the window's own, so every window has one and equal windows choose the same. A phrase is the text of all
neighbouring windows that choose the same trigger occurrence; phrases overlap by span - 1 bytes, so no window is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TRIGGER = 16  # two words of 8 bytes
#: Bytes that are parsed in one go; the low bits of a hash hold a position below this.
BLOCK, POSITION_BITS = 1 << 19, 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S32, _S29, _S31 = (np.uint64(x) for x in (32, 29, 31))


def mixed(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One step of a 64-bit hash over 64-bit words."""
    state = (state ^ (state >> _S32)) * _A
    state += value
    state ^= state >> _S29
    state *= _B
    return state


def final(state: np.ndarray) -> np.ndarray:
    state = (state ^ (state >> _S31)) * _C
    return state ^ (state >> _S32)


def words8(data: np.ndarray) -> np.ndarray:
    """At each position the 8 bytes from there, as one number."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | (x[width:] << np.uint64(8 * width))
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x if done == width else np.minimum(x[: len(x) - (width - done)], x[width - done :])


@dataclass
class Phrases:
    """Of several texts: text number, first window, number of windows, trigger hash and phrase hash (with the trigger's place)."""

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    trigger: np.ndarray
    phrase: np.ndarray


def _block(data: np.ndarray, text: np.ndarray, offset: np.ndarray, ok: np.ndarray, span: int) -> Phrases:
    """data: bytes; text, offset, ok of each window: its text, its place there, and whether it lies within one text."""
    at8 = words8(data)
    rolling = final(mixed(at8[:-8], at8[8:]))
    n = len(data) - span + 1
    low = np.uint64((1 << POSITION_BITS) - 1)
    own = sliding_min((rolling & ~low) | np.arange(len(rolling), dtype=np.uint64), span - TRIGGER + 1)[:n] & low
    new = np.ones(n, bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)
    new |= ~ok
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    keep = ok[first]
    first, count = first[keep], count[keep]
    trigger = own[first].astype(np.int64)
    end = first + count + span - 1
    state = (trigger - first).astype(np.uint64) * np.uint64(256) + count.astype(np.uint64)
    for k in range(0, span - 7, 8):
        state = mixed(state, at8[first + k])
    rest = span - 8 * (span // 8)
    for k in range(8, span - TRIGGER + rest + 8 + 1, 8):
        state = mixed(state, at8[end - k])
    return Phrases(text[first], offset[first], count, rolling[trigger], final(state))


def parse(texts: list[bytes], span: int) -> Phrases:
    """The phrases of every text of at least ``span`` bytes. Long texts are parsed in blocks that share span - 1 bytes."""
    found, parts, size = [], [], 0

    def flush() -> None:
        nonlocal parts, size
        if parts:
            data = np.concatenate([d for _, _, d in parts])
            if len(data) >= span:
                sizes = [len(d) for _, _, d in parts]
                text = np.repeat([k for k, _, _ in parts], sizes)
                within = np.concatenate([np.arange(s) for s in sizes])
                offset = within + np.repeat([o for _, o, _ in parts], sizes)
                ok = within + span <= np.repeat(sizes, sizes)
                n = len(data) - span + 1
                found.append(_block(data, text[:n], offset[:n], ok[:n], span))
        parts, size = [], 0

    for k, raw in enumerate(texts):
        if len(raw) < span:
            continue
        data = np.frombuffer(raw, np.uint8)
        for at in range(0, len(data) - span + 1, BLOCK // 2):
            piece = data[at : at + BLOCK // 2 + span - 1]
            if size + len(piece) > BLOCK:
                flush()
            parts.append((k, at, piece))
            size += len(piece)
    flush()
    if not found:
        none = np.empty(0, np.int64)
        return Phrases(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Phrases(*(np.concatenate([getattr(f, c) for f in found]) for c in ("text", "start", "count", "trigger", "phrase")))
