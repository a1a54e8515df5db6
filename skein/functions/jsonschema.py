"""A small JSON Schema validator; unknown keywords are tolerated."""

from __future__ import annotations

import json
import math
import re
import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

_KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or (isinstance(v, float) and v.is_integer())),
}


class SchemaError(ValueError):
    pass


def _same(a, b) -> bool:
    return type(a) is type(b) and a == b if isinstance(a, bool) or isinstance(b, bool) else a == b


class Validator:
    """Compiled check of one schema; $ref may point anywhere into it, also in circles."""

    def __init__(self, schema: dict | bool):
        if not isinstance(schema, (dict, bool)):
            raise SchemaError("a schema is an object or a boolean")
        self.root = schema
        self._check(schema)

    def _check(self, s) -> None:
        if isinstance(s, bool):
            return
        if not isinstance(s, dict):
            raise SchemaError("a subschema is an object or a boolean")
        kinds = s.get("type", [])
        for k in [kinds] if isinstance(kinds, str) else kinds:
            if k not in _KINDS:
                raise SchemaError(f"unknown type {k!r}")
        if "$ref" in s:
            self._find(s["$ref"])
        if "pattern" in s:
            try:
                re.compile(s["pattern"])
            except (re.error, TypeError) as e:
                raise SchemaError(f"bad pattern: {e}") from None
        for k in ("properties", "$defs", "definitions", "patternProperties"):
            if k in s and not isinstance(s[k], dict):
                raise SchemaError(f"{k} is an object")
            for sub in s.get(k, {}).values():
                self._check(sub)
        for k in ("allOf", "anyOf", "oneOf"):
            for sub in s.get(k, []):
                self._check(sub)
        for k in ("items", "additionalProperties", "not"):
            if k in s:
                self._check(s[k])

    def _find(self, ref: str):
        if not isinstance(ref, str) or not ref.startswith("#"):
            raise SchemaError(f"cannot follow {ref!r}")
        at = self.root
        for part in [p.replace("~1", "/").replace("~0", "~") for p in ref[1:].split("/") if p]:
            if isinstance(at, list) and part.isdigit() and int(part) < len(at):
                at = at[int(part)]
            elif isinstance(at, dict) and part in at:
                at = at[part]
            else:
                raise SchemaError(f"cannot follow {ref!r}")
        return at

    def valid(self, v, s=None, under: tuple = ()) -> bool:
        """Whether v conforms; values of any depth. A $ref that leads back to itself at the same value adds nothing."""
        s = self.root if s is None else s
        if isinstance(s, bool):
            return s
        if (id(s), id(v)) in under:
            return True
        # only references at one and the same value can go round in circles
        here = (*(x for x in under if x[1] == id(v)), (id(s), id(v)))
        sub = lambda x, y: self.valid(x, y, here if x is v else ())
        if "$ref" in s and not sub(v, self._find(s["$ref"])):
            return False
        kinds = s.get("type")
        if kinds is not None and not any(_KINDS[k](v) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return False
        if "enum" in s and not any(_same(v, e) for e in s["enum"]):
            return False
        if "const" in s and not _same(v, s["const"]):
            return False
        if isinstance(v, dict):
            props, pats = s.get("properties", {}), s.get("patternProperties", {})
            if any(r not in v for r in s.get("required", [])):
                return False
            if not s.get("minProperties", 0) <= len(v) <= s.get("maxProperties", len(v)):
                return False
            for k, x in v.items():
                known = k in props
                if known and not sub(x, props[k]):
                    return False
                for p, y in pats.items():
                    if re.search(p, k):
                        known = True
                        if not sub(x, y):
                            return False
                if not known and not sub(x, s.get("additionalProperties", True)):
                    return False
        if isinstance(v, list):
            if not s.get("minItems", 0) <= len(v) <= s.get("maxItems", len(v)):
                return False
            if s.get("uniqueItems") and any(_same(a, b) for i, a in enumerate(v) for b in v[:i]):
                return False
            if "items" in s and not all(sub(x, s["items"]) for x in v):
                return False
        if isinstance(v, str):
            if not s.get("minLength", 0) <= len(v) <= s.get("maxLength", len(v)):
                return False
            if "pattern" in s and not re.search(s["pattern"], v):
                return False
        if _KINDS["number"](v):
            if v < s.get("minimum", v) or v > s.get("maximum", v):
                return False
            if "exclusiveMinimum" in s and v <= s["exclusiveMinimum"] or "exclusiveMaximum" in s and v >= s["exclusiveMaximum"]:
                return False
            if s.get("multipleOf") and not math.isclose(v / s["multipleOf"], round(v / s["multipleOf"]), abs_tol=1e-9):
                return False
        if "not" in s and sub(v, s["not"]):
            return False
        return all(sub(v, x) for x in s.get("allOf", [])) and ("anyOf" not in s or any(sub(v, x) for x in s["anyOf"])) and ("oneOf" not in s or sum(sub(v, x) for x in s["oneOf"]) == 1)


def _deep(f: Callable[[], bool]) -> bool | None:
    """f with room for values of great depth; None where even that does not hold them."""
    limit = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(200_000)  # frames of plain functions lie on the heap; what calls through C is guarded apart
        return f()
    except RecursionError:
        return None
    finally:
        sys.setrecursionlimit(limit)


def conforms(schema: dict):
    """A Column function: whether JSON text conforms; text that is no JSON does not, NULL stays NULL.

    So does a text whose values lie too deep for the interpreter (some thousand levels).
    """
    check = Validator(schema)  # a bad schema fails here, before any row is read

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return check.valid(json.loads(t))
            except ValueError:
                return False
            except RecursionError:
                return _deep(lambda: check.valid(json.loads(t)))

        return texts.map(one).astype(object)

    return run


def tool_schema(caller: dict) -> dict:
    """The schema of an extraction answer: the caller's data plus a confidence and a citation per field."""
    names = list(caller.get("properties", {})) if isinstance(caller.get("properties"), dict) else []
    unit = {"type": "number", "minimum": 0, "maximum": 1}
    cite = {"type": "object", "properties": {"quote": {"type": "string"}, "supportScore": unit}, "required": ["quote", "supportScore"]}
    per = lambda one: {"type": "object", "properties": {n: one for n in names}, "required": names, "additionalProperties": one}
    return {"type": "object", "properties": {"data": caller, "confidence": per(unit), "citations": per(cite)}, "required": ["data", "confidence", "citations"]}
