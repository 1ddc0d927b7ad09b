"""Scalar functions as Spark SQL text.

Most names are Spark's own.  The table holds those whose name or meaning differs.
"""

from __future__ import annotations

from collections.abc import Callable

from statloom.errors import CommandError


def _arity(name: str, args: list[str], *allowed: int) -> None:
    if len(args) not in allowed:
        raise CommandError(f"{name}() takes {' or '.join(map(str, allowed))} arguments, not {len(args)}")


def _missing(a: list[str]) -> str:
    if not a:
        raise CommandError("missing() needs an argument")
    return "(" + " OR ".join(f"{x} IS NULL" for x in a) + ")"


def _cond(a: list[str]) -> str:
    _arity("cond", a, 3)
    return f"(CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END)"


def _inrange(a: list[str]) -> str:
    _arity("inrange", a, 3)
    return f"({a[0]} BETWEEN {a[1]} AND {a[2]})"


def _inlist(a: list[str]) -> str:
    if len(a) < 2:
        raise CommandError("inlist() needs a value and at least one candidate")
    return f"({a[0]} IN ({', '.join(a[1:])}))"


def _substr(a: list[str]) -> str:
    _arity("substr", a, 2, 3)
    if len(a) == 2:
        return f"substring({a[0]}, {a[1]})"
    if a[1].isdigit() and a[1] != "0":
        return f"substring({a[0]}, {a[1]}, {a[2]})"
    # position 0 stands before the first character
    return f"(CASE WHEN {a[1]} = 0 THEN substring({a[0]}, 1, greatest({a[2]} - 1, 0)) ELSE substring({a[0]}, {a[1]}, {a[2]}) END)"


def _round(a: list[str]) -> str:
    _arity("round", a, 1, 2)
    x = f"CAST({a[0]} AS DOUBLE)"
    scale = f"pow(10, {a[1]})" if len(a) == 2 else "1"
    return f"(signum({x}) * floor(abs({x}) * {scale} + 0.5) / {scale})"


def _one(template: str) -> Callable[[list[str]], str]:
    def made(a: list[str]) -> str:
        _arity(template.split("(")[0], a, 1)
        return template.format(a[0])

    return made


def _renamed(name: str) -> Callable[[list[str]], str]:
    return lambda a: f"{name}({', '.join(a)})"


TRANSLATED: dict[str, Callable[[list[str]], str]] = {
    "missing": _missing,
    "cond": _cond,
    "inrange": _inrange,
    "inlist": _inlist,
    "substr": _substr,
    "substring": _substr,
    "round": _round,
    "log": _one("ln({})"),
    "strlen": _one("char_length({})"),
    "len": _one("char_length({})"),
    "strlower": _one("lower({})"),
    "strupper": _one("upper({})"),
    "strtrim": _one("trim({})"),
    "real": _one("try_cast({} AS DOUBLE)"),
    "int": _one("try_cast(rint(CAST({} AS DOUBLE)) AS INT)"),
    "mod": _renamed("try_mod"),
    "starts_with": _renamed("startswith"),
    "ends_with": _renamed("endswith"),
    "strpos": _renamed("instr"),
    "regexp_matches": _renamed("regexp_like"),
    "dayofweek": _one("(dayofweek({}) - 1)"),
    "week": _one("weekofyear({})"),
    "random": _renamed("rand"),
    "epoch": _one("unix_timestamp({})"),
}


def call(name: str, args: list[str]) -> str:
    """SQL of a call; unknown names go to Spark, which knows built-ins and registered functions."""
    made = TRANSLATED.get(name.lower())
    return made(args) if made else f"{name}({', '.join(args)})"
