"""Argument checks, run before a plan is built."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import wraps

import numpy as np

Rule = Callable[[object], bool]


def check(*rules, **named) -> Callable:
    """Decorator: ``check(name=rule, ...)``, ``check({name: rule})`` or ``check(name, rule)``."""
    if len(rules) == 2:
        named[rules[0]] = rules[1]
    elif rules:
        named |= rules[0]

    def wrap(fn: Callable) -> Callable:
        signature = inspect.signature(fn)
        unknown = set(named) - set(signature.parameters)
        if unknown:
            raise ValueError(f"no parameters {sorted(unknown)}")

        @wraps(fn)
        def inner(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            for k, rule in named.items():
                if k in bound.arguments and not rule(bound.arguments[k]):
                    raise ValueError(f"parameter {k} is not valid: {bound.arguments[k]!r}")
            return fn(*args, **kwargs)

        return inner

    return wrap


def allow_none(rule: Rule) -> Rule:
    return lambda x: x is None or rule(x)


def accept_any(*rules: Rule) -> Rule:
    return lambda x: any(r(x) for r in rules)


def require_all(*rules: Rule) -> Rule:
    return lambda x: all(r(x) for r in rules)


def is_instance(*kinds: type) -> Rule:
    return lambda x: isinstance(x, kinds)


def is_scalar(x) -> bool:
    return np.isscalar(x) or isinstance(x, np.ndarray) and x.ndim == 0


def is_array_like(x) -> bool:
    return isinstance(x, list | tuple | np.ndarray | range) and np.asarray(x).dtype != object


def is_array_shape(x) -> bool:
    return isinstance(x, list | tuple | np.ndarray) and len(x) > 0 and all(is_integer(v) and v > 0 for v in x)


def has_shape(shape) -> Rule:
    return lambda x: is_array_like(x) and np.shape(x) == tuple(shape)


def has_ndim(n: int) -> Rule:
    return lambda x: is_array_like(x) and np.ndim(x) == n


def _kind(kinds: str) -> Rule:
    return lambda x: is_array_like(x) and np.asarray(x).size > 0 and np.asarray(x).dtype.kind in kinds


def is_integer(x) -> bool:
    return isinstance(x, int | np.integer) and not isinstance(x, bool)


def is_boolean(x) -> bool:
    return isinstance(x, bool | np.bool_)


def is_even(x) -> bool:
    return is_integer(x) and x % 2 == 0


def is_odd(x) -> bool:
    return is_integer(x) and x % 2 == 1


def is_pow2(x) -> bool:
    return is_integer(x) and x > 0 and x & (x - 1) == 0


def is_real(x) -> bool:
    return is_integer(x) or isinstance(x, float | np.floating)


def is_complex(x) -> bool:
    return isinstance(x, complex | np.complexfloating)


has_integers, has_booleans, has_reals, has_complex = _kind("iu"), _kind("b"), _kind("iuf"), _kind("c")


def _each(rule: Rule) -> Rule:
    return lambda x: has_integers(x) and all(rule(int(v)) for v in np.ravel(x))


has_evens, has_odds, has_pow2s = _each(is_even), _each(is_odd), _each(is_pow2)


def is_antenna_index(df) -> bool:
    return {"station_id", "antenna_id"} <= set(df.columns)


def is_beam_index(df) -> bool:
    return "beam_id" in df.columns


def is_beam_config(df) -> bool:
    return {"station_id", "beam_id", "x", "y", "z"} <= set(df.columns)


def is_source_config(df) -> bool:
    return {"x", "y", "z", "intensity"} <= set(df.columns)
