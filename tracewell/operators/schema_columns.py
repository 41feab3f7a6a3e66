"""JSON Schema compiled to column expressions over VARIANT: what schema.Catalog finds, without a Python worker.

A schema becomes one expression, an array of errors: the keyword, a line break and the instance_path. What columns cannot say as the evaluator does raises
Unsupported while compiling (a schema that refers to itself, a constant that is no scalar, a pattern whose classes differ
between regular expression engines), and the whole schema is left to the evaluator. $ref is resolved while compiling, and a
definition that is used at several places is compiled for each.

Where a schema asks for one type at each place, it is compiled for values that from_json() takes from the text as well (Typed):
a record that holds another type there, or a null, is read by VARIANT.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.operators.fact_columns import Cell, Need, mapped, number, once, text
from tracewell.operators.schema import FORMATS, Catalog
from tracewell.sources.strict_json import segment

ERRORS = "array<string>"
KNOWN = {
    "$id", "$ref", "$defs", "$schema", "$comment", "title", "description", "default", "examples", "deprecated", "type", "const", "enum", "minLength", "maxLength",
    "pattern", "format", "required", "minProperties", "properties", "patternProperties", "additionalProperties", "propertyNames", "minItems", "maxItems", "uniqueItems",
    "prefixItems", "items", "contains", "minContains", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "allOf", "anyOf", "oneOf", "not", "if", "then", "else",
}
#: Patterns of the formats, as Java and Python read them alike.
_SHAPES = {
    "uri": r"(?U)\A[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*\z",
    "uri-reference": r"(?U)\A[^\s<>\"{}|\\^`]*\z",
    "uuid": r"(?i)\A(urn:uuid:)?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z",
    "json-pointer": r"(?s)\A(/([^~/]|~[01])*)*\z",
    "email": r"(?U)\A[^@\s]+@[^@\s]+\.[^@\s]+\z",
    "hostname": r"\A(?!-)[A-Za-z0-9-]{1,63}(?<!-)(\.(?!-)[A-Za-z0-9-]{1,63}(?<!-))*\z",
}
_TIME = r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt]([0-9]{2}:[0-9]{2}):([0-5][0-9]|60)(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"


class Unsupported(ValueError):
    """A schema that only the evaluator can read; or, of types, one that only VARIANT can."""


class Typed(Cell):
    """A value that from_json() takes as the one type that a schema asks for. path: where it stands in the VARIANT 'listed'."""

    def __init__(self, col: Column, need: Need, path: str | None = None):
        super().__init__(col, need)
        self.path = path

    def ask(self, kind: str) -> None:
        if getattr(self.need, "kind", kind) != kind:
            raise Unsupported("a place of two types")
        self.need.kind, self.need.leaf = kind, {"string": "string", "number": "double", "variant": "variant"}.get(kind)

    def member(self, key: str) -> Typed:
        self.ask("object")
        if not key or re.search("[`'\\\\\x00-\x1f]", key) or key == "_" or any(k != key and k.lower() == key.lower() for k in self.need.members):
            raise Unsupported("a name that no column can have")
        return Typed(self.col[key], self.need.members.setdefault(key, Need()), self.path and f"{self.path}['{key}']")

    def there(self) -> Column:
        if not hasattr(self.need, "kind"):
            self.need.leaf = "any"
        return self.col.isNotNull()

    def listed(self) -> Column:
        self.ask("array")
        self.need.item = self.need.item or Need()
        return self.col

    def items(self, key: str) -> Typed:
        v = self.member(key)
        return Typed(F.coalesce(v.listed(), F.array()), v.need)

    def leaf(self, kind: str) -> Column:
        self.ask({"double": "number"}.get(kind, kind))
        return self.col


def fields(v: Column) -> Column:
    """An object's members as a map; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def has_members(v: Column) -> Column:
    """Whether a value is an object."""
    if isinstance(v, Typed):
        v.ask("object")
        return v.col.isNotNull()
    return F.try_variant_get(v, "$", "struct<_:boolean>").isNotNull()


def member(v: Column, key: str) -> Column:
    """An object's member; null where there is none, and for anything but an object."""
    if isinstance(v, Typed):
        return v.member(key)
    if not key or "'" in key:
        return F.get(F.transform(F.array(fields(v)), lambda m: m[key]), F.lit(0))
    return F.try_variant_get(v, f"$['{key}']", "variant")


def listed(v: Column) -> Column:
    """An array's items; null for anything else."""
    if isinstance(v, Typed):
        return v.listed()
    return F.try_variant_get(v, "$", "array<variant>")


def there(v: Column) -> Column:
    return v.there() if isinstance(v, Typed) else v.isNotNull()


def every(a: Column, v: Column, make) -> Column:
    """make(value, place) of the items a of a list v."""
    return mapped(Typed(a, v.need), lambda x, k: make(Typed(x.col, x.need), k)) if isinstance(v, Typed) else F.transform(a, make)


def none() -> Column:
    return F.array().cast(ERRORS)


def error(keyword: str, path: Column) -> Column:
    return F.array(F.concat(F.lit(f"{keyword}\n"), path))


def parts(e: Column) -> list[Column]:
    """Keyword and instance_path of an error."""
    return [F.substring_index(e, "\n", 1).alias("keyword"), F.substring(e, F.locate("\n", e) + 1, F.length(e)).alias("instance_path")]


def errors_if(bad: Column, keyword: str, path: Column) -> Column:
    return F.when(bad, error(keyword, path)).otherwise(none())


def child(path: Column, key: Column | str) -> Column:
    if isinstance(key, str):
        return F.concat(path, F.lit(f"/{segment(key)}"))
    return F.concat(path, F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def is_type(v: Column, name: str) -> Column:
    if isinstance(v, Typed) and name in ("boolean", "null"):
        raise Unsupported("a type that is not taken")
    kind = None if isinstance(v, Typed) else F.schema_of_variant(v)
    tests = {
        "object": lambda: has_members(v),
        "array": lambda: listed(v).isNotNull(),
        "string": lambda: text(v).isNotNull(),
        "number": lambda: number(v).isNotNull(),
        "integer": lambda: F.coalesce(number(v) % 1 == 0, F.lit(False)),
        "boolean": lambda: kind == "BOOLEAN",
        "null": lambda: kind == "VOID",
    }
    return F.coalesce(tests[name](), F.lit(False))


def equals(v: Column, value) -> Column:
    if isinstance(value, dict | list):
        raise Unsupported("a constant that is no scalar")
    if isinstance(value, str):
        same = text(v) == value
    elif isinstance(v, Typed) and (isinstance(value, bool) or value is None):
        raise Unsupported("a type that is not taken")
    elif isinstance(value, bool) or value is None:
        same = F.to_json(v) == {True: "true", False: "false", None: "null"}[value]
    else:
        same = number(v) == float(value)
    return F.coalesce(same, F.lit(False))


def pattern_of(pattern: str) -> str:
    if re.search(r"\\[^.^$*+?()\[\]{}|/\\-]|\(\?", pattern):
        raise Unsupported("a pattern that engines may read differently")
    return pattern


def fits_format(s: Column, name: str) -> Column:
    if name in ("date-time", "date"):
        whole = F.concat(s, F.lit("T00:00:00Z")) if name == "date" else s
        parts = [F.regexp_extract(whole, _TIME, k) for k in (1, 2)]
        day = F.try_to_timestamp(F.concat(*parts), F.lit("yyyy-MM-ddHH:mm")).isNotNull()
        return whole.rlike(_TIME) & day & ((F.length(s) == 10) if name == "date" else F.lit(True))
    return s.rlike(_SHAPES[name]) & ((F.length(s) < 254) if name == "hostname" else F.lit(True))


class Compiler:
    def __init__(self, schemas: dict[str, dict]):
        self.catalog = Catalog(schemas)
        self.open: list[int] = []  # the definitions that are being compiled

    def errors(self, schema_id: str, v: Column) -> Column:
        """The errors as structs, sorted."""
        return F.array_sort(F.transform(self.found(schema_id, v), lambda e: F.struct(*parts(e))))

    def found(self, schema_id: str, v: Column) -> Column:
        """The errors, each once."""
        return F.array_distinct(self._check(self.catalog.schemas[schema_id], v, F.lit(""), schema_id))

    def _ok(self, s, v: Column, base: str) -> Column:
        return F.size(self._check(s, v, F.lit(""), base)) == 0

    def _check(self, s, v: Column, path: Column, base: str) -> Column:
        if s is True or s == {}:
            return none()
        if s is False:
            return error("false", path)
        if s.keys() - KNOWN:
            raise Unsupported("an unknown keyword")
        if id(s) in self.open:
            raise Unsupported("a schema that refers to itself")
        self.open.append(id(s))
        try:
            return self._parts(s, v, path, urljoin(base, s.get("$id", "")))
        finally:
            self.open.pop()

    def _parts(self, s: dict, v: Column, path: Column, base: str) -> Column:
        first, rest = [], []
        if "$ref" in s:
            document, node = self.catalog.resolve(base, s["$ref"])
            first.append(self._check(node, v, path, document))
        if "const" in s:
            rest.append(errors_if(~equals(v, s["const"]), "const", path))
        if "enum" in s:
            any_ = F.lit(False)
            for x in s["enum"]:
                any_ = any_ | equals(v, x)
            rest.append(errors_if(~any_, "enum", path))
        for make in (self._string, self._object, self._array, self._number):
            rest += make(s, v, path, base)
        rest += [self._check(x, v, path, base) for x in s.get("allOf", ())]
        if "anyOf" in s:
            any_ = F.lit(False)
            for x in s["anyOf"]:
                any_ = any_ | self._ok(x, v, base)
            rest.append(errors_if(~any_, "anyOf", path))
        if "oneOf" in s:
            hits = sum((self._ok(x, v, base).cast("int") for x in s["oneOf"]), F.lit(0))
            rest.append(errors_if(hits != 1, "oneOf", path))
        if "not" in s:
            rest.append(errors_if(self._ok(s["not"], v, base), "not", path))
        if "if" in s:
            branches = [self._check(s.get(k, True), v, path, base) for k in ("then", "else")]
            rest.append(F.when(self._ok(s["if"], v, base), branches[0]).otherwise(branches[1]))
        told = F.concat(*rest) if len(rest) > 1 else rest[0] if rest else none()
        if "type" in s:
            right = F.lit(False)
            for name in [s["type"]] if isinstance(s["type"], str) else s["type"]:
                right = right | is_type(v, name)
            told = F.when(right, told).otherwise(error("type", path))
        return F.concat(*first, told) if first else told

    def _string(self, s: dict, v: Column, path: Column, base: str) -> list[Column]:
        if not s.keys() & {"minLength", "maxLength", "pattern"} and s.get("format") not in FORMATS:
            return []
        t, out = text(v), []
        for keyword, bad in (("minLength", lambda n: F.length(t) < n), ("maxLength", lambda n: F.length(t) > n), ("pattern", lambda p: ~t.rlike(pattern_of(p)))):
            if keyword in s:
                out.append(errors_if(F.coalesce(bad(s[keyword]), F.lit(False)), keyword, path))
        if s.get("format") in FORMATS:
            out.append(errors_if(t.isNotNull() & ~F.coalesce(fits_format(t, s["format"]), F.lit(False)), "format", path))
        return out

    def _number(self, s: dict, v: Column, path: Column, base: str) -> list[Column]:
        if not s.keys() & {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"}:
            return []
        n = number(v)
        tests = {"minimum": lambda x: n < x, "maximum": lambda x: n > x, "exclusiveMinimum": lambda x: n <= x, "exclusiveMaximum": lambda x: n >= x}
        return [errors_if(F.coalesce(bad(float(s[k])), F.lit(False)), k, path) for k, bad in tests.items() if k in s]

    def _object(self, s: dict, v: Column, path: Column, base: str) -> list[Column]:
        out = [errors_if(has_members(v) & ~there(member(v, k)), "required", child(path, k)) for k in s.get("required", ())]
        for k, sub in s.get("properties", {}).items():
            if sub is not True and sub != {} and isinstance(v, Typed):
                x = member(v, k)
                out.append(F.when(x.col.isNotNull(), self._check(sub, x, child(path, k), base)).otherwise(none()))
                x.there()
            elif sub is not True and sub != {}:
                out.append(once(member(v, k), lambda x: F.when(x.isNotNull(), self._check(sub, x, child(path, k), base)).otherwise(none())))  # noqa: B023  called at once
        if s.keys() & {"minProperties", "patternProperties", "additionalProperties", "propertyNames"}:
            whole = v
            if isinstance(v, Typed):
                if not v.path:
                    raise Unsupported("members of unknown names in a list")
                v.ask("object")
                whole = F.try_variant_get("listed", v.path, "variant")
            out.append(once(fields(whole), lambda m: F.concat(none(), *self._members(s, m, path, base))))
        return out

    def _members(self, s: dict, m: Column, path: Column, base: str) -> list[Column]:
        """What a schema says of all members of an object, m its map or null."""
        out, known, patterns = [], s.get("properties", {}), s.get("patternProperties", {})
        if "minProperties" in s:
            out.append(errors_if(m.isNotNull() & (F.size(m) < s["minProperties"]), "minProperties", path))
        entries = F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:variant>>"))

        def each(make) -> Column:
            return F.flatten(F.transform(entries, make))

        for p, sub in patterns.items():
            rule = pattern_of(p)

            def ruled(e):
                return F.when(e["key"].rlike(rule), self._check(sub, e["value"], child(path, e["key"]), base)).otherwise(none())  # noqa: B023  called at once

            out.append(each(ruled))
        if "additionalProperties" in s and s["additionalProperties"] is not True:

            def other(e):
                listed_ = e["key"].isin(list(known)) if known else F.lit(False)
                for p in patterns:
                    listed_ = listed_ | e["key"].rlike(pattern_of(p))
                at = child(path, e["key"])
                found = error("additionalProperties", at) if s["additionalProperties"] is False else self._check(s["additionalProperties"], e["value"], at, base)
                return F.when(~listed_, found).otherwise(none())

            out.append(each(other))
        if "propertyNames" in s:
            bad = F.filter(F.map_keys(m), lambda k: ~self._named(s["propertyNames"], k, base))
            out.append(F.coalesce(F.transform(bad, lambda k: F.concat(F.lit("propertyNames\n"), child(path, k))), none()))
        return out

    def _named(self, s, key: Column, base: str) -> Column:
        """Whether a schema holds for a name: for a string, or, if it asks for other types as well, for a VARIANT."""
        try:
            return self._ok(s, Typed(key, Need()), base)
        except Unsupported:
            name = F.try_parse_json(F.to_json(F.array(key)))
            return once(F.try_variant_get(name, "$[0]", "variant"), lambda k: self._ok(s, k, base))

    def _array(self, s: dict, v: Column, path: Column, base: str) -> list[Column]:
        if not s.keys() & {"minItems", "maxItems", "uniqueItems", "prefixItems", "items", "contains"}:
            return []
        made = lambda a: F.when(a.isNotNull(), F.concat(none(), *self._items(s, a, v, path, base))).otherwise(none())
        return [made(listed(v)) if isinstance(v, Typed) else once(listed(v), made)]

    def _items(self, s: dict, a: Column, v: Column, path: Column, base: str) -> list[Column]:
        """What a schema says of the items a of an array v."""
        out = []
        for keyword, bad in (("minItems", lambda n: F.size(a) < n), ("maxItems", lambda n: F.size(a) > n)):
            if keyword in s:
                out.append(errors_if(a.isNotNull() & bad(s[keyword]), keyword, path))
        if s.get("uniqueItems"):
            if isinstance(v, Typed) and not v.path:
                raise Unsupported("whole items of a list in a list")
            whole = F.try_variant_get("listed", v.path, "array<variant>") if isinstance(v, Typed) else a
            alike = lambda x: lambda t: F.when(F.substring(t, 1, 1).isin(*"-0123456789"), F.concat(F.lit("#"), number(x).cast("string"))).otherwise(t)
            shown = F.transform(whole, lambda x: once(F.to_json(x), alike(x)))
            out.append(errors_if(F.coalesce(F.size(F.array_distinct(shown)) < F.size(a), F.lit(False)), "uniqueItems", path))
        first, rest = s.get("prefixItems", []), s.get("items", True)
        for k, sub in enumerate(first):
            item = Typed(F.get(a, F.lit(k)), v.need.item) if isinstance(v, Typed) else F.get(a, F.lit(k))
            out.append(F.when(a.isNotNull() & (F.size(a) > k), self._check(sub, item, child(path, str(k)), base)).otherwise(none()))
        if rest is not True and rest != {}:
            told = every(a, v, lambda x, k: F.when(k >= len(first), self._check(rest, x, F.concat(path, F.lit("/"), k.cast("string")), base)).otherwise(none()))
            out.append(F.coalesce(F.flatten(told), none()))
        if "contains" in s:
            hits = F.size(F.filter(every(a, v, lambda x, k: self._ok(s["contains"], x, base)), lambda x: x))
            out.append(errors_if(a.isNotNull() & (hits < s.get("minContains", 1)), "contains", path))
        return out
