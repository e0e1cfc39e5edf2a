"""Ed25519 signatures in plain Python: a small per-row helper, used on one note per sealed segment.

After the public description of the scheme (RFC 8032). Points are kept in extended coordinates.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT_MINUS_ONE = pow(2, (P - 1) // 4, P)


def _add(a, b):
    x1, y1, z1, t1 = a
    x2, y2, z2, t2 = b
    u = (y1 - x1) * (y2 - x2) % P
    v = (y1 + x1) * (y2 + x2) % P
    w = 2 * t1 * t2 * D % P
    z = 2 * z1 * z2 % P
    e, f, g, h = v - u, z - w, z + w, v + u
    return e * f % P, g * h % P, f * g % P, e * h % P


def _doubles(point) -> list:
    """The point times 1, 2, 4, ... up to 2^255."""
    points = [point]
    for _ in range(255):
        points.append(_add(points[-1], points[-1]))
    return points


def _multiply(scalar: int, doubles: list):
    total = (0, 1, 1, 0)
    for point in doubles:
        if scalar & 1:
            total = _add(total, point)
        scalar >>= 1
    return total


def _same(a, b) -> bool:
    return (a[0] * b[2] - b[0] * a[2]) % P == 0 and (a[1] * b[2] - b[1] * a[2]) % P == 0


def _x_of(y: int, sign: int):
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    if square == 0:
        return None if sign else 0
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT_MINUS_ONE % P
    if (x * x - square) % P:
        return None
    return P - x if x & 1 != sign else x


_BASE_Y = 4 * pow(5, P - 2, P) % P
_BASE_X = _x_of(_BASE_Y, 0)
BASE = (_BASE_X, _BASE_Y, 1, _BASE_X * _BASE_Y % P)


@lru_cache(1)
def _base_table() -> list[list]:
    """For each four bits of a scalar the base point times their sixteen values."""
    rows = []
    for point in _doubles(BASE)[::4]:
        row = [(0, 1, 1, 0)]
        for _ in range(15):
            row.append(_add(row[-1], point))
        rows.append(row)
    return rows


def _times_base(scalar: int):
    total = (0, 1, 1, 0)
    for row in _base_table():
        if scalar & 15:
            total = _add(total, row[scalar & 15])
        scalar >>= 4
    return total


def _compress(point) -> bytes:
    inverse = pow(point[2], P - 2, P)
    x, y = point[0] * inverse % P, point[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _decompress(data: bytes):
    y = int.from_bytes(data, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    x = _x_of(y, sign)
    return None if x is None else (x, y, 1, x * y % P)


def _hash_int(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


# A few keys sign most notes. A table of doubles costs no more than one multiplication without it.
@lru_cache(64)
def _key_doubles(data: bytes) -> list | None:
    key = _decompress(data)
    return None if key is None else _doubles(key)


def verify(public_key: bytes, message: bytes, signature: bytes) -> bool:
    if len(public_key) != 32 or len(signature) != 64:
        return False
    key, nonce = _key_doubles(bytes(public_key)), _decompress(signature[:32])
    scalar = int.from_bytes(signature[32:], "little")
    if key is None or nonce is None or scalar >= ORDER:
        return False
    challenge = _hash_int(signature[:32], public_key, message)
    return _same(_times_base(scalar), _add(nonce, _multiply(challenge, key)))


def _expand(seed: bytes):
    digest = hashlib.sha512(seed).digest()
    scalar = int.from_bytes(digest[:32], "little") & ((1 << 254) - 8) | 1 << 254
    return scalar, digest[32:]


@lru_cache(64)
def public_key(seed: bytes) -> bytes:
    return _compress(_times_base(_expand(seed)[0]))


def sign(seed: bytes, message: bytes) -> bytes:
    """Signature for fixtures; capture agents hold the real keys."""
    scalar, prefix = _expand(seed)
    key = public_key(seed)
    r = _hash_int(prefix, message)
    nonce = _compress(_times_base(r))
    s = (r + _hash_int(nonce, key, message) * scalar) % ORDER
    return nonce + s.to_bytes(32, "little")
