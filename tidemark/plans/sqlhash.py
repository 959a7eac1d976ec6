"""The 64-bit xxHash of Spark's ``xxhash64`` as DuckDB SQL, for the SQL that queries on hashes are compared with.

All values are UHUGEINT below 2^64; products of two of them fit into 128 bits.
"""

from __future__ import annotations

# The five primes of XXH64 and Spark's default seed.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED = 42
_M = 1 << 64


def _c(value: int) -> str:
    return f"CAST('{value % _M}' AS UHUGEINT)"


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _wrap(text: str) -> str:
    return f"(({text}) % {_c0(_M)})"


def _c0(value: int) -> str:
    return f"CAST('{value}' AS UHUGEINT)"


def _rot(value: str, by: int, name: str) -> str:
    return _let(value, name, f"(({name} * {_c0(1 << by)}) % {_c0(_M)} + {name} // {_c0(1 << (64 - by))})")


def _round(acc: str, word: str) -> str:
    return _wrap(f"{_rot(_wrap(f'{acc} + ({word} * {_c(_P2)}) % {_c0(_M)}'), 31, 'r')} * {_c(_P1)}")


def _step8(h: str, word: str) -> str:
    mixed = f"xor({h}, {_round(_c(0), word)})"
    return _wrap(f"({_rot(mixed, 27, 'y')} * {_c(_P1)}) % {_c0(_M)} + {_c(_P4)}")


def _step4(h: str, word: str) -> str:
    mixed = f"xor({h}, {_wrap(f'{word} * {_c(_P1)}')})"
    return _wrap(f"({_rot(mixed, 23, 'y')} * {_c(_P2)}) % {_c0(_M)} + {_c(_P3)}")


def _step1(h: str, byte: str) -> str:
    mixed = f"xor({h}, {_wrap(f'{byte} * {_c(_P5)}')})"
    return _wrap(f"{_rot(mixed, 11, 'y')} * {_c(_P1)}")


def _finish(h: str) -> str:
    a = _let(h, "f", _wrap(f"xor(f, f // {_c0(1 << 33)}) * {_c(_P2)}"))
    b = _let(a, "f", _wrap(f"xor(f, f // {_c0(1 << 29)}) * {_c(_P3)}"))
    return _let(b, "f", f"xor(f, f // {_c0(1 << 32)})")


def unsigned(signed: str) -> str:
    """A BIGINT as the unsigned number of the same bits."""
    return _let(f"CAST({signed} AS HUGEINT)", "s", f"CAST(CASE WHEN s < 0 THEN s + {_M} ELSE s END AS UHUGEINT)")


def signed(unsigned_: str) -> str:
    return _let(f"CAST({unsigned_} AS HUGEINT)", "s", f"CAST(CASE WHEN s >= {1 << 63} THEN s - {_M} ELSE s END AS BIGINT)")


def hash_long(value: str, seed: str = _c(SEED)) -> str:
    """Unsigned hash of a BIGINT; the seed is the hash of the argument before."""
    return _finish(_step8(_wrap(f"{seed} + {_c(_P5 + 8)}"), unsigned(value)))


def hash_int(value: int, seed: str) -> str:
    """Unsigned hash of an INT constant."""
    return _finish(_step4(_wrap(f"{seed} + {_c(_P5 + 4)}"), _c(value % (1 << 32))))


def hash_texts(name: str, source: str, text: str, keep: str) -> str:
    """CTEs that end in ``name``: the columns ``keep`` of ``source`` and ``hash``, the unsigned hash of a text column."""
    byte = "CAST(CAST('0x' || substr(x, 2 * ({i}) - 1, 2) AS INTEGER) AS UHUGEINT)"
    word = lambda first, n: " + ".join(f"{byte.format(i=f'{first} + {j}')} * {_c0(1 << (8 * j))}" for j in range(n))
    fold = lambda start, items, body: f"list_reduce(list_prepend({start}, {items}), lambda h, k: {body})"
    starts = (_P1 + _P2 + SEED, _P2 + SEED, SEED, SEED - _P1)
    lanes = ", ".join(f"{fold(_c(s), f'list_transform(range({i + 1}, stripes * 4 + 1, 4), lambda j: words[j])', _round('h', 'k'))} AS v{i}" for i, s in enumerate(starts))
    joined = _wrap(" + ".join(_rot(f"v{i}", r, "y") for i, r in enumerate((1, 7, 12, 18))))
    for i in range(4):
        joined = _let(joined, "g", _wrap(f"(xor(g, {_round(_c(0), f'v{i}')}) * {_c(_P1)}) % {_c0(_M)} + {_c(_P4)}"))
    long = f"CASE WHEN stripes > 0 THEN {joined} ELSE {_c(_P5 + SEED)} END"
    return f"""{name}_x AS (SELECT *, hex(encode({text})) AS x, octet_length(encode({text})) AS nb FROM {source}),
{name}_w AS (SELECT *, nb // 32 AS stripes, list_transform(range(1, nb // 8 + 1), lambda i: {word('8 * i - 7', 8)}) AS words FROM {name}_x),
{name}_v AS (SELECT *, {lanes} FROM {name}_w),
{name}_8 AS (SELECT *, {fold(_wrap(f'{long} + CAST(nb AS UHUGEINT)'), 'list_transform(range(stripes * 4 + 1, nb // 8 + 1), lambda j: words[j])', _step8('h', 'k'))} AS h8 FROM {name}_v),
{name}_4 AS (SELECT *, CASE WHEN nb % 8 >= 4 THEN {_step4('h8', f"({word('nb // 8 * 8 + 1', 4)})")} ELSE h8 END AS h4 FROM {name}_8),
{name} AS (SELECT {keep}, {_finish(fold('h4', f"list_transform(range(nb // 4 * 4 + 1, nb + 1), lambda i: {byte.format(i='i')})", _step1('h', 'k')))} AS hash FROM {name}_4)"""


def fnv_long(value: str) -> str:
    """FNV-1a over the eight bytes of a BIGINT, low byte first, top bit cleared, as BIGINT."""
    byte = "list_transform(range(8), lambda j: CAST((z >> CAST(8 * j AS INTEGER)) & 255 AS UHUGEINT))"
    fold = f"list_reduce(list_prepend({_c0(14695981039346656037)}, {byte}), lambda h, b: (xor(h, b) * {_c0(1099511628211)}) % {_c0(_M)})"
    return _let(f"CAST({value} AS BIGINT)", "z", f"CAST({fold} % {_c0(1 << 63)} AS BIGINT)")
