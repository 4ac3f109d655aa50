"""Reproducible draws: a hash of the key, the same in every engine and run.

A draw depends on its key only, never on the order in which tasks run, so a
recomputed partition gives the same values.
"""

from __future__ import annotations

from hashlib import md5
from math import sin

import numpy as np
from pyspark.sql import Column, functions as F

TWO_32 = 4294967296.0
_ADD = [int(abs(sin(i + 1)) * TWO_32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _text(part) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def draw(*parts) -> Column:
    """Uniform value in [0, 1) from the first 32 bits of the MD5 of the key.

    Columns are used by value, everything else as literal text.
    """
    key = F.concat_ws("|", *[_text(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def draw_int(n, *parts) -> Column:
    """Uniform integer in [0, n)."""
    size = n if isinstance(n, Column) else F.lit(n)
    return F.floor(draw(*parts) * size).cast("int")


def hashed(*parts) -> np.ndarray:
    """(4, keys): the MD5 of the keys as four numbers of 32 bits, whose first is that of ``draw``.

    A part is a text, a number or an array of whole numbers from 0; all arrays have one length.
    Keys with equally many digits are hashed together by vector operations.
    """
    arrays = [i for i, p in enumerate(parts) if isinstance(p, np.ndarray)]
    digits = [np.searchsorted(10 ** np.arange(1, 19), parts[i], side="right") + 1 for i in arrays]
    code = sum(d << (5 * k) for k, d in enumerate(digits))
    out = np.empty((4, len(code)), np.uint32)
    for one in np.unique(code):
        at = np.flatnonzero(code == one)
        widths = {i: int(one >> (5 * k)) & 31 for k, i in enumerate(arrays)}
        out[:, at] = _md5_rows([(parts[i][at], widths[i]) if i in widths else str(p) for i, p in enumerate(parts)], len(at))
    return out


def _md5_rows(parts: list, rows: int) -> np.ndarray:
    """MD5 of the parts joined by bars; an array comes with its number of digits."""
    length = sum(p[1] if isinstance(p, tuple) else len(p.encode()) for p in parts) + len(parts) - 1
    if length > 55:  # over one block
        texts = zip(*[map(str, p[0].tolist()) if isinstance(p, tuple) else [p] * rows for p in parts])
        return np.frombuffer(b"".join(md5("|".join(t).encode()).digest() for t in texts), ">u4").reshape(rows, 4).T
    fixed, moving, at = [0] * 16, {}, 0
    fixed[14] = 8 * length
    for i, p in enumerate(parts):
        if isinstance(p, tuple):
            left = p[0].astype(np.uint32 if p[1] < 10 else np.uint64)
            for place in range(at + p[1] - 1, at - 1, -1):
                rest = left // 10
                byte = (left - rest * 10 + 48).astype(np.uint32) << np.uint32(8 * (place % 4))
                moving[place // 4] = moving[place // 4] + byte if place // 4 in moving else byte
                left = rest
            at += p[1]
        text = (b"" if isinstance(p, tuple) else p.encode()) + (b"|" if i + 1 < len(parts) else b"\x80")
        for byte in text:
            fixed[at // 4] |= byte << (8 * (at % 4))
            at += 1
    moving = {k: w + np.uint32(fixed[k]) for k, w in moving.items()}
    a, b, c, d = (np.full(rows, v, np.uint32) for v in _START)
    f, turned = np.empty(rows, np.uint32), np.empty(rows, np.uint32)
    for i in range(64):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if k in moving:
            f += moving[k]
        f += np.uint32((_ADD[i] + (0 if k in moving else fixed[k])) & 0xFFFFFFFF)
        turn = _TURN[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=turned)
        f >>= np.uint32(32 - turn)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack([x + np.uint32(v) for x, v in zip((a, b, c, d), _START)]).byteswap()


def draw_sql(*parts: str) -> str:
    """The same draw as DuckDB text; parts are SQL expressions."""
    key = "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / {TWO_32})"
