"""DuckDB expressions equal to the kernels of ``text``."""

from __future__ import annotations

from . import text as X

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF))
_LOWER = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c + 0x20) for c in range(0xC0, 0xDF))
FOLDED = f"translate(text, '{_UPPER}', '{_LOWER}')"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_M = "18446744073709551616::UHUGEINT"


def mixed_sql(h: str) -> str:
    """``text.mixed`` of an unsigned 64-bit expression."""
    one = f"(SELECT (xor(a, a >> 32)::UHUGEINT * {int(X.MIX)}::UHUGEINT % {_M})::UBIGINT AS b FROM (SELECT ({h})::UBIGINT AS a))"
    two = f"(SELECT (xor(b, b >> 29)::UHUGEINT * {int(X.BASE)}::UHUGEINT % {_M})::UBIGINT AS c FROM {one})"
    return f"(SELECT xor(c, c >> 32) FROM {two})"


def word_hash_sql(w: str) -> str:
    """``text.hashes`` of a word: a polynomial over its bytes, mixed."""
    table = "[" + ",".join(f"{int(v)}::UHUGEINT" for v in X.TABLE) + "]"
    digits = "'0123456789ABCDEF'"
    byte = f"(instr({digits}, hex(encode({w}))[2 * p - 1]) - 1) * 16 + instr({digits}, hex(encode({w}))[2 * p])"
    codes = f"list_transform(list_reverse(range(1, strlen({w}) + 1)), lambda p: {table}[{byte}])"
    return mixed_sql(f"list_reduce({codes}, lambda a, x: (a * {int(X.BASE)}::UHUGEINT + x) % {_M})")
