"""Random numbers that are a function of a row's key, a seed and a place, the same wherever and however often they are made."""

from __future__ import annotations

import numpy as np

#: The increment and the two multipliers of the SplitMix64 generator.
INCREMENT, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x: np.ndarray) -> np.ndarray:
    """The generator's output function."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(31))


def exponentials(keys: np.ndarray, places: int, seed: int = 0) -> np.ndarray:
    """A row of ``places`` standard exponentials for each key (any 64-bit integers)."""
    with np.errstate(over="ignore"):
        start = mixed(keys.astype(np.uint64) + np.uint64(seed % (1 << 64)) * np.uint64(INCREMENT))
        steps = np.arange(1, places + 1, dtype=np.uint64) * np.uint64(INCREMENT)
        bits = mixed(start[:, None] + steps) >> np.uint64(11)
    return -np.log((bits.astype(np.float64) + 0.5) * 2.0**-53)


_ALL = "CAST(18446744073709551615 AS UHUGEINT)"


def _mixed_sql(x: str) -> str:
    times = lambda a, c: f"CAST((CAST({a} AS UHUGEINT) * CAST({c} AS UHUGEINT)) & {_ALL} AS UBIGINT)"
    a = f"list_transform([{x}], lambda x: {times('xor(x, x >> 30)', FIRST)})"
    b = f"list_transform({a}, lambda x: {times('xor(x, x >> 27)', SECOND)})"
    return f"list_transform({b}, lambda x: xor(x, x >> 31))[1]"


def start_sql(key: str, seed: int = 0) -> str:
    """The generator's state for a key that is not negative."""
    return _mixed_sql(f"CAST((CAST({key} AS UHUGEINT) + CAST({seed * INCREMENT % (1 << 64)} AS UHUGEINT)) & {_ALL} AS UBIGINT)")


def exponential_sql(start: str, place: str) -> str:
    """The exponential at a place, from 0, of a state; both are columns."""
    bits = _mixed_sql(f"CAST((CAST({start} AS UHUGEINT) + CAST({place} + 1 AS UHUGEINT) * CAST({INCREMENT} AS UHUGEINT)) & {_ALL} AS UBIGINT)")
    return f"(-ln((CAST({bits} >> 11 AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST({2.0**-53!r} AS DOUBLE)))"
