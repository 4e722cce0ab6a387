"""The small text languages inside parameters: rules, features, names, lists."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParamError

_CLAUSE = re.compile(r"^\s*(?P<name>[^<>=&]+?)\s*(?P<op><=|>=|<|>)\s*(?P<value>[^<>=&]+?)\s*$")
_RATIO = re.compile(r"^\s*(?P<a>[^/()+]+?)\s*/\s*\(\s*(?P<b>[^/()+]+?)\s*\+\s*(?P<c>[^/()+]+?)\s*\)\s*$")


def csv_list(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def int_list(text: str, param: str = "list") -> list[int]:
    out = []
    for x in csv_list(text):
        if not re.fullmatch(r"[+-]?\d+", x):
            raise ParamError(f"{param}: {x!r} is not an integer")
        out.append(int(x))
    return out


def names(text: str, param: str = "names") -> dict[int, str]:
    """``0: olivine; 3: glass`` as a map (``=`` in place of the first colon also parts); a label given twice is an error."""
    out: dict[int, str] = {}
    for part in filter(None, (p.strip() for p in (text or "").split(";"))):
        label, _, name = re.sub(r"^(\s*-?\d+\s*)=", r"\1:", part).partition(":")
        if not name.strip() or not re.fullmatch(r"[+-]?\d+", label.strip()):
            raise ParamError(f"{param}: {part!r} is not 'label: name'")
        if int(label) in out:
            raise ParamError(f"{param}: label {int(label)} is named twice")
        out[int(label)] = name.strip()
    return out


def name_list(text: str | None) -> list[str]:
    """Names parted by semicolons."""
    return [n.strip() for n in (text or "").split(";") if n.strip()]


def rule(text: str, param: str = "rule") -> list[tuple[str, str, float]]:
    """A conjunction of ``channel op number`` joined by ``&``."""
    out = []
    for part in (text or "").split("&"):
        found = _CLAUSE.match(part)
        try:
            out.append((found["name"].strip(), found["op"], float(found["value"])))
        except (TypeError, ValueError):
            raise ParamError(f"{param}: {part.strip()!r} is not 'channel op number'") from None
    return out


def column_of(name: str, channels: list[str]) -> str:
    """The channel of that name, whatever its case."""
    for c in channels:
        if c.lower() == name.lower():
            return c
    raise ParamError(f"no channel {name!r}; there are {', '.join(channels)}")


def rule_column(text: str, channels: list[str]) -> Column:
    ops = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
    return reduce(Column.__and__, (ops[op](F.col(f"`{column_of(c, channels)}`"), F.lit(v)) for c, op, v in rule(text)))


def feature(token: str, channels: list[str], undefined: float | None = 0.0) -> Column:
    """A channel, or ``A/(A+B)``, which is ``undefined`` where the sum is not positive."""
    ratio = _RATIO.match(token)
    if not ratio:
        return F.col(f"`{column_of(token.strip(), channels)}`")
    if ratio["a"].lower() not in (ratio["b"].lower(), ratio["c"].lower()):
        raise ParamError(f"{token!r}: the numerator must stand in the denominator")
    a, b, c = (F.col(f"`{column_of(ratio[k], channels)}`") for k in "abc")
    return F.when(b + c > 0, a / (b + c)).otherwise(F.lit(undefined).cast("double"))
