"""JSON with the semantics of ECMAScript: numbers are doubles, later keys win, keys sort by UTF-16 units."""

from __future__ import annotations

import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: float) -> str:
    """A double as ECMAScript prints it; null where it is not finite."""
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    if 1e-6 <= abs(x) < 1e21:
        plain = format(Decimal(repr(x)), "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    mantissa, _, exponent = format(Decimal(repr(x)).normalize(), "e").partition("e")
    power = int(exponent)
    return f"{mantissa}e{'+' if power > 0 else '-'}{abs(power)}"


def canonical(value: object) -> str:
    """Canonical JSON of a parsed value: members sorted by name, no white space."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return number_text(float(value))
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"


def canonical_text(text: str | None) -> str | None:
    """Canonical form of a JSON text; a text that doesn't parse stays, without outer blanks; null stays null."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return text.strip()
    return value if isinstance(value, str) else canonical(value)


def valid_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing else; the engine's parser alone stops after the first value."""
    in_array, in_object = F.concat(F.lit("["), c, F.lit("]")), F.concat(F.lit('{"x":'), c, F.lit("}"))
    return F.try_parse_json(c).isNotNull() & F.try_parse_json(in_array).isNotNull() & F.try_parse_json(in_object).isNotNull()


def strict_canonical(c: Column) -> Column:
    """J1 with strict number and key semantics."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(canonical_text, na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def compact(value: object) -> str:
    """A parsed value as ECMAScript prints it, members in their own order; a text is itself."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "[" + ",".join(json.dumps(v, ensure_ascii=False) if isinstance(v, str) else compact(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{json.dumps(v, ensure_ascii=False) if isinstance(v, str) else compact(v)}" for k, v in value.items()) + "}"
    return canonical(value)


def pretty(value: object, indent: str = "") -> str:
    """A parsed value over several lines, two blanks a level."""
    inner = indent + "  "
    if isinstance(value, list) and value:
        return "[\n" + ",\n".join(inner + pretty(v, inner) for v in value) + "\n" + indent + "]"
    if isinstance(value, dict) and value:
        return "{\n" + ",\n".join(f"{inner}{json.dumps(k, ensure_ascii=False)}: {pretty(v, inner)}" for k, v in value.items()) + "\n" + indent + "}"
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) else compact(value)


def parsed_items(text: str | None) -> tuple[list, bool]:
    """(items, whether they are an array): S4 with the items as values; lines that do not parse are texts."""
    if not text or not text.strip():
        return [], False
    t = text.strip()
    if t[0] == "[" and t[-1] == "]":
        try:
            return json.loads(t), True
        except ValueError:
            pass
    out = []
    for line in (x.strip() for x in t.split("\n")):
        if line:
            try:
                out.append(json.loads(line))
            except ValueError:
                out.append(line)
    return out, False


def render(text: str | None, stack: bool = False, indented: bool = True) -> list[str]:
    """The lines of a JSON text without repeated items: the first of equal ones in its own member order.

    An array is printed whole (over several lines if ``indented``) unless stacked; items one a line else.
    """
    items, is_array = parsed_items(text)
    first: dict[str, list] = {}
    for v in items:
        key = v if isinstance(v, str) else canonical(v)
        if key in first:
            first[key][1] += 1
        else:
            first[key] = [v, 1]
    kept = list(first.values())
    if is_array and not stack:
        values = [v for v, _ in kept]
        return (pretty(values) if indented else compact(values)).split("\n")
    return [(f"x{n} " if stack else "") + compact(v) for v, n in kept]


def rendered(c: Column, stack: bool = False, indented: bool = True) -> Column:
    """J3 as a Column: array of lines; empty for null and blank texts."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: render(v, stack, indented))

    return F.pandas_udf(run, "array<string>")(c)


def items_of(text: str | None) -> list[str]:
    """The items of a JSON text, canonical: of an array its elements, else every line that is not blank."""
    if not text or not text.strip():
        return []
    t = text.strip()
    if t[0] == "[" and t[-1] == "]":
        try:
            return [v if isinstance(v, str) else canonical(v) for v in json.loads(t)]
        except ValueError:
            pass
    return [canonical_text(x.strip()) for x in t.split("\n") if x.strip()]


def json_items(c: Column) -> Column:
    """S4 as a Column: array of canonical items."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(items_of)

    return F.pandas_udf(run, "array<string>")(c)
