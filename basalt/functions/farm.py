"""The 64-bit FarmHash fingerprint, from its published definition."""

from __future__ import annotations

_M = (1 << 64) - 1
#: Fixed values of the algorithm: three primes.
K0, K1, K2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F


def _rot(x: int, n: int) -> int:
    return (x >> n | x << (64 - n)) & _M


def _mix(x: int) -> int:
    return x ^ x >> 47


def _pair(u: int, v: int, mul: int) -> int:
    a = _mix((u ^ v) * mul & _M)
    b = _mix((v ^ a) * mul & _M)
    return b * mul & _M


def _word(s: bytes, at: int, size: int = 8) -> int:
    return int.from_bytes(s[at : at + size], "little")


def _short(s: bytes) -> int:
    n = len(s)
    if n >= 8:
        mul = (K2 + n * 2) & _M
        a, b = (_word(s, 0) + K2) & _M, _word(s, n - 8)
        c = (_rot(b, 37) * mul + a) & _M
        d = ((_rot(a, 25) + b) * mul) & _M
        return _pair(c, d, mul)
    if n >= 4:
        mul = (K2 + n * 2) & _M
        return _pair(n + (_word(s, 0, 4) << 3) & _M, _word(s, n - 4, 4), mul)
    if n:
        y = s[0] + (s[n >> 1] << 8)
        z = n + (s[n - 1] << 2)
        return _mix(y * K2 & _M ^ z * K0 & _M) * K2 & _M
    return K2


def _middle(s: bytes) -> int:
    n = len(s)
    mul = (K2 + n * 2) & _M
    if n <= 32:
        a, b = _word(s, 0) * K1 & _M, _word(s, 8)
        c, d = _word(s, n - 8) * mul & _M, _word(s, n - 16) * K2 & _M
        return _pair((_rot((a + b) & _M, 43) + _rot(c, 30) + d) & _M, (a + _rot((b + K2) & _M, 18) + c) & _M, mul)
    a, b = _word(s, 0) * K2 & _M, _word(s, 8)
    c, d = _word(s, n - 8) * mul & _M, _word(s, n - 16) * K2 & _M
    y = (_rot((a + b) & _M, 43) + _rot(c, 30) + d) & _M
    z = _pair(y, (a + _rot((b + K2) & _M, 18) + c) & _M, mul)
    e, f = _word(s, 16) * mul & _M, _word(s, 24)
    g, h = (y + _word(s, n - 32)) * mul & _M, (z + _word(s, n - 24)) * mul & _M
    return _pair((_rot((e + f) & _M, 43) + _rot(g, 30) + h) & _M, (e + _rot((f + a) & _M, 18) + g) & _M, mul)


def _weak(s: bytes, at: int, a: int, b: int) -> tuple[int, int]:
    w, x, y, z = (_word(s, at + i) for i in (0, 8, 16, 24))
    a = (a + w) & _M
    b = _rot((b + a + z) & _M, 21)
    c = a
    a = (a + x + y) & _M
    b = (b + _rot(a, 44)) & _M
    return (a + z) & _M, (b + c) & _M


def _unsigned(s: bytes) -> int:
    n = len(s)
    if n <= 16:
        return _short(s)
    if n <= 64:
        return _middle(s)
    seed = 81
    x, y = seed, (seed * K1 + 113) & _M
    z = _mix((y * K2 + 113) & _M) * K2 & _M
    v, w = (0, 0), (0, 0)
    x = (x * K2 + _word(s, 0)) & _M
    last = (n - 1) // 64 * 64
    for at in range(0, last, 64):
        x = _rot((x + y + v[0] + _word(s, at + 8)) & _M, 37) * K1 & _M
        y = _rot((y + v[1] + _word(s, at + 48)) & _M, 42) * K1 & _M
        x ^= w[1]
        y = (y + v[0] + _word(s, at + 40)) & _M
        z = _rot((z + w[0]) & _M, 33) * K1 & _M
        v = _weak(s, at, v[1] * K1 & _M, (x + w[0]) & _M)
        w = _weak(s, at + 32, (z + w[1]) & _M, (y + _word(s, at + 16)) & _M)
        z, x = x, z
    at = n - 64
    mul = (K1 + ((z & 0xFF) << 1)) & _M
    w = ((w[0] + ((n - 1) & 63)) & _M, w[1])
    v = ((v[0] + w[0]) & _M, v[1])
    w = ((w[0] + v[0]) & _M, w[1])
    x = _rot((x + y + v[0] + _word(s, at + 8)) & _M, 37) * mul & _M
    y = _rot((y + v[1] + _word(s, at + 48)) & _M, 42) * mul & _M
    x ^= w[1] * 9 & _M
    y = (y + v[0] * 9 + _word(s, at + 40)) & _M
    z = _rot((z + w[0]) & _M, 33) * mul & _M
    v = _weak(s, at, v[1] * mul & _M, (x + w[0]) & _M)
    w = _weak(s, at + 32, (z + w[1]) & _M, (y + _word(s, at + 16)) & _M)
    z, x = x, z
    return _pair((_pair(v[0], w[0], mul) + _mix(y) * K0 + z) & _M, (_pair(v[1], w[1], mul) + x) & _M, mul)


def fingerprint64(s: bytes) -> int:
    """The fingerprint as a signed 64-bit number."""
    h = _unsigned(s)
    return h - (1 << 64) if h >> 63 else h
