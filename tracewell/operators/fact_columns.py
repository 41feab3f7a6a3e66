"""The facts of a record as column expressions over its VARIANT: what records.facts_of() finds, without a Python worker.

Spark's JSON parser reads what is plainly sound; plain() says which texts that are. It is careful: a text that only the strict
parser can judge (escapes that may hide a key or half a character, numbers that may overflow, very deep nesting, anything
after the value), or whose rules look at every value (withheld or deleted states, health and freshness), is not plain and is left to facts_of().

Most plain records are read without taking their VARIANT apart: what is asked of a Cell is noted, so that one from_json() takes
all of it from the text. That reader makes strings of other values, so a record where a string looks like one is read by VARIANT.
"""

from __future__ import annotations

import inspect
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tracewell.sources.strict_json import DEPTH

#: Columns of a fact but its record and place.
FIELDS = "kind string, path string, id string, a string, b string, c string, d string, n double, m double, expected array<string>"
_TYPES = {"string": StringType(), "double": DoubleType(), "array<string>": ArrayType(StringType())}
_FACT = StructType([StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in FIELDS.split(", "))])

#: Texts with this escape, or with these keys, are for the strict parser; values with these keys, or with a state of these, have
#: rules that look everywhere.
_ESCAPE, _KEYS = "\\u", ["__proto__"]
_RULED_KEYS, _STATES = ["health", "freshness"], ["withheld", "deleted"]
#: The words of _RULED_KEYS and _STATES that matter to facts of a kind.
_RULED = {"diagnostic": _RULED_KEYS, "times": ["freshness"], "ref": _STATES, "dangling": _STATES}
#: What numbers, objects and lists look like as text; numbers of at most _DIGITS digits that may overflow, and what all of these hold.
_OTHER = r"^(?:-?[0-9][0-9.eE+-]*|[{\[][\s\S]*)$"
_DIGITS, _LARGE, _EXPONENT = 100, r"[:,\[\s]-?[0-9][0-9.]*[eE][+]?[0-9]{3}", "[eE][+]?[0-9]{3}"


class Need:
    """What is asked of a value: its members, its items, itself as a string or a number, or only whether it is there ('any')."""

    def __init__(self):
        self.members, self.item, self.leaf = {}, None, None

    def ddl(self) -> str:
        if self.members:
            return f"struct<{','.join(f'`{k}`: {n.ddl()}' for k, n in self.members.items())}>"
        leaf = "string" if self.leaf == "any" else self.leaf
        return f"array<{self.item.ddl()}>" if self.item else leaf or "struct<`_`: string>"  # an item that only counts

    def sure(self) -> bool:
        """Whether no text can make it doubtful."""
        if self.members:
            return all(n.sure() for n in self.members.values())
        return self.item.sure() if self.item else self.leaf in (None, "any", "variant")

    def doubtful(self, x: Column, path: str | None = None) -> Column:
        """Whether a string in x may have been another value, or a number no number. path: where x stands in the VARIANT 'listed',
        which is asked for those that look like another value; without it they are doubtful."""
        if self.sure():
            return F.lit(False)
        if self.members:
            out = F.lit(False)
            for k, n in self.members.items():
                out = out | n.doubtful(x[k], path and f"{path}.{k}")
            return out
        if self.item:
            return F.coalesce(F.exists(x, lambda y: self.item.doubtful(y)), F.lit(False))
        if self.leaf == "double":
            return F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))
        other = x.isin("true", "false") | (F.substring(x, 1, 1).isin(*"-0123456789{[") & x.rlike(_OTHER))
        if path:
            other = other & ~text(F.try_variant_get("listed", path, "variant")).eqNullSafe(x)
        return F.coalesce(other, F.lit(False))


class Cell:
    """A value that from_json() has read, and what is asked of it."""

    def __init__(self, col: Column, need: Need):
        self.col, self.need = col, need

    def member(self, key: str) -> Cell:
        return Cell(self.col[key], self.need.members.setdefault(key, Need()))

    def items(self, key: str) -> Cell:
        v = self.member(key)
        v.need.item = v.need.item or Need()
        return Cell(F.coalesce(v.col, F.array()), v.need)

    def leaf(self, kind: str) -> Column:
        self.need.leaf = kind
        return self.col


def value(raw: Column) -> Column:
    """The VARIANT of raw, null if it does not parse or if anything follows its value.

    The parser stops after a value. So each text is parsed as the first item of a list whose second is a word made up for this
    call: whatever follows the value spoils the list, ends it before that word, or makes it longer."""
    word = uuid.uuid4().hex
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit(f',"{word}"]'))), "$", "array<variant>")
    return once(listed, lambda x: F.when((F.size(x) == 2) & (x[1].cast("string") == word), x[0]))


def read(records: DataFrame) -> DataFrame:
    """records (record_key, raw) with value; see value()."""
    return records.select("record_key", "raw", value(F.col("raw")).alias("value"))


def plain(raw: Column, value: Column, words: bool = True) -> Column:
    """Whether columns read a text with this value as the strict parser does, and, if words, can tell its facts.

    The value's schema tells most of it: it names every key, shows numbers that may overflow as DOUBLE, and is as deep as the
    value. It is short, as it merges the items of a list; what it merges to VARIANT it hides, and then the text is searched."""
    holds = lambda s, w: F.contains(s, F.lit(w))
    braces = lambda s, chars: sum((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(c))) for c in chars), F.lit(0))

    def odd(shape: Column) -> Column:
        hidden = holds(shape, "VARIANT")
        named = lambda key: holds(shape, key) | (hidden & holds(raw, key))
        out = holds(raw, _ESCAPE)
        for key in _KEYS + (_RULED_KEYS if words else []):
            out = out | named(key)
        if words:
            states = F.lit(False)
            for w in _STATES:
                states = states | holds(raw, w)
            out = out | (named("state") & states)
        out = out | ((hidden | holds(shape, "DOUBLE")) & raw.rlike("[eE][+]?[0-9]{3}|[0-9]{200}"))
        nested = hidden | ((F.octet_length(shape) >= DEPTH) & (braces(shape, "<") >= DEPTH))
        return out | (nested & (braces(raw, "{[") >= DEPTH))

    return F.coalesce(value.isNotNull() & ~once(F.schema_of_variant(value), odd), F.lit(False))


def once(x: Column, make) -> Column:
    """make(x), where x is worked out once however often make names it."""
    return F.get(F.transform(F.array(x), make), F.lit(0))


class Top:
    """A record whose members are columns already, so that each is taken from the VARIANT once."""

    def __init__(self, lists: list[str], members: list[str]):
        self.lists, self.members = lists, members

    def columns(self, v: Column) -> list[Column]:
        return [items(v, k).alias(f"list_{k}") for k in self.lists] + [member(v, k).alias(f"member_{k}") for k in self.members]


def member(v: Column | Top | Cell, key: str) -> Column | Cell:
    if isinstance(v, Cell):
        return v.member(key)
    return F.col(f"member_{key}") if isinstance(v, Top) else F.try_variant_get(v, f"$.{key}", "variant")


def items(v: Column | Top | Cell, key: str) -> Column | Cell:
    if isinstance(v, Cell):
        return v.items(key)
    return F.col(f"list_{key}") if isinstance(v, Top) else F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))


def text(v: Column | Cell) -> Column:
    """A VARIANT's string; null for anything else."""
    if isinstance(v, Cell):
        return v.leaf("string")
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))


def number(v: Column | Cell) -> Column:
    if isinstance(v, Cell):
        return v.leaf("double") + F.lit(0.0)  # no negative zero
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL)"), v.cast("double"))


def is_object(v: Column | Cell) -> Column:
    if isinstance(v, Cell):
        return v.col.isNotNull()
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def strings(v: Column, key: str) -> Column:
    """The strings of a list, without its other items."""
    return F.filter(mapped(items(v, key), text), lambda x: x.isNotNull())


def mapped(values: Column | Cell, make) -> Column:
    """make(value), or make(value, place), of every item of a list."""
    if not isinstance(values, Cell):
        return F.transform(values, make)
    cell = lambda x: Cell(x, values.need.item)
    return F.transform(values.col, (lambda x: make(cell(x))) if len(inspect.signature(make).parameters) == 1 else (lambda x, k: make(cell(x), k)))


def fact(kind: str, path: Column, **given: Column) -> Column:
    cells = {"kind": F.lit(kind), "path": path} | given
    return F.struct(*[cells.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _FACT.fields])


def some(facts: Column, when: Column | None = None) -> Column:
    """One fact, or none where the condition is not true."""
    one = F.array(facts)
    return one if when is None else F.when(when, one).otherwise(F.array().cast(ArrayType(_FACT)))


def each(values: Column, path: Column, make) -> Column:
    """make(value, its path) of every item of a list, one after another."""
    return F.flatten(mapped(values, lambda x, k: make(x, F.concat(path, F.lit("/"), k.cast("string")))))


def under(path: Column, *keys: str) -> Column:
    return F.concat(path, *[F.lit(f"/{k}") for k in keys])


def joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def expand(v: Column, pattern: str, path: Column, expected: list[str]) -> Column:
    """A fact for each reference that a pattern reaches. A list's strings are counted without its other items."""
    head, _, rest = pattern.partition(".")
    key, many = head.removesuffix("[]"), head.endswith("[]")
    at = under(path, key)
    kinds = F.array(*map(F.lit, expected)) if expected else F.lit(None)
    if not rest and many:
        return each(strings(v, key), at, lambda s, p: F.array(fact("ref", p, id=s, expected=kinds)))
    if not rest:
        s = text(member(v, key))
        return some(fact("ref", at, id=s, expected=kinds), s.isNotNull())
    if many:
        return each(items(v, key), at, lambda x, p: expand(x, rest, p, expected))
    return expand(member(v, key), rest, at, expected)


def references(v: Column, table: dict[str, list[str]], path: Column) -> Column:
    return joined([expand(v, pattern, path, kinds) for pattern, kinds in table.items()])


def entity(v: Column, collection: str, path: Column) -> Column:
    s = text(member(v, "id"))
    return some(fact("entity", path, id=s, a=F.lit(collection), b=text(member(v, "type")), c=text(member(v, "disclosure"))), s.isNotNull())


def many(values: Column | Cell) -> Column:
    return F.size(values.col if isinstance(values, Cell) else values)


def size(values: Column, name: str, path: str) -> Column:
    return some(fact("size", F.lit(path), a=F.lit(name), n=many(values)))


def ids_of(v: Top, events: Column, collections: list[str]) -> Column:
    """The ids of all entities of a record."""
    own = [mapped(items(v, name), lambda x: text(member(x, "id"))) for name in collections]
    rules = F.flatten(mapped(items(v, "policies"), lambda p: mapped(items(p, "rules"), lambda r: text(member(r, "id")))))
    every = F.concat(F.array(text(member(v, "id"))), *own, rules, mapped(events, lambda e: text(member(e, "id"))))
    return F.filter(every, lambda x: x.isNotNull())


def placed_ids(v: Top | Cell, events: Column | Cell, collections: list[str]) -> Column:
    """Id and path of all entities of a record, in their order."""
    own = lambda x, path: F.struct(text(member(x, "id")).alias("id"), path.alias("path"))
    placed = lambda values, *path: mapped(values, lambda x, k: own(x, F.concat(*path, F.lit("/"), k.cast("string"))))
    rules = F.flatten(mapped(items(v, "policies"), lambda p, k: placed(items(p, "rules"), F.lit("/policies/"), k.cast("string"), F.lit("/rules"))))
    every = F.concat(F.array(own(v, F.lit(""))), *[placed(items(v, name), F.lit(f"/{name}")) for name in collections], rules, placed(events, F.lit("/history/events")))
    return F.filter(every, lambda x: x["id"].isNotNull())


def twins(v: Top | Cell, events: Column | Cell, collections: list[str]) -> Column:
    """A fact for each entity whose id an earlier one of its record has, by id: sorted where they stand, so nothing is shuffled."""
    every = F.transform(placed_ids(v, events, collections), lambda x, k: F.struct(x["id"].alias("id"), k.alias("place"), x["path"].alias("path")))
    again = lambda s: F.filter(s, lambda x, k: (k > 0) & (F.get(s, k - 1)["id"] == x["id"]))
    return F.transform(once(F.sort_array(every), again), lambda x: fact("twin", x["path"], id=x["id"]))


def same_record(e: Column | Cell, record: Top | Cell) -> Column:
    """Whether a receipt names its record."""
    shown = lambda x: text(x) if isinstance(x, Cell) else F.coalesce(F.to_json(x), F.lit("null"))  # noqa: E731  a null and nothing are the same here
    return shown(member(e, "recordId")).eqNullSafe(shown(member(record, "id")))


def event_facts(e: Column, path: Column, record: Top, words, tables, wanted) -> list[Column]:
    """The facts of an event that are wanted, in order."""
    evaluation, parameters = member(e, "policyEvaluation"), member(e, "parameters")
    effect, own, kind = text(member(e, "effectClass")), text(member(e, "id")), text(member(e, "operationType"))
    none = F.array().cast(ArrayType(_FACT))
    parts = []
    if "event" in wanted:
        parts.append(some(fact("event", path, id=own, a=effect, b=text(member(e, "finalStatus")), c=text(member(evaluation, "result")), d=F.when(~same_record(e, record), F.lit("other record")), n=number(member(e, "sequence")))))
    if "times" in wanted:
        parts.append(some(fact("times", under(path, "endedAt"), a=text(member(e, "startedAt")), b=text(member(e, "endedAt")), c=F.lit("EVENT_SEQUENCE"))))
    for key in ("inputs", "outputs"):
        if key in wanted:
            parts.append(each(strings(e, key), under(path, key), lambda s, p, key=key: F.array(fact(key, p, id=own, a=s, b=effect, c=path))))
    if "ref" in wanted:
        parts += [references(e, tables["receipt"], path), references(evaluation, tables["evaluation"], under(path, "policyEvaluation"))]
        parts.append(F.when(effect == "generate", references(parameters, tables["generated"], under(path, "parameters"))).otherwise(none))
        parts.append(F.when(kind.isin([f"{words.operations}.{x}" for x in tables["processing"]]), references(parameters, tables["processed"], under(path, "parameters"))).otherwise(none))
    return parts


def graph(v: Top, words, acyclic: list[tuple[str, bool]]) -> Column:
    """Origin, target and path of each acyclic relation, one after another."""
    backwards = [f"{words.relations}:{name}" for name, reverse in acyclic if reverse]
    known = [f"{words.relations}:{name}" for name, _ in acyclic]

    def edge(r, path):
        predicate, subject, target = (text(member(r, k)) for k in ("predicate", "subject", "object"))
        back = predicate.isin(backwards)
        there = predicate.isin(known) & subject.isNotNull() & target.isNotNull()
        return F.when(there, F.array(F.when(back, target).otherwise(subject), F.when(back, subject).otherwise(target), path)).otherwise(F.array().cast("array<string>"))

    edges = each(items(v, "relations"), F.lit("/relations"), edge)
    return some(fact("graph", F.lit(""), expected=edges), F.size(edges) > 0)


#: All kinds of facts.
KINDS = frozenset(["record", "entity", "size", "external", "ref", "diagnostic", "event", "times", "inputs", "outputs", "relation", "window", "graph", "twin", "profile"])


def embedded(v: Top | Cell) -> Column | Cell:
    """The events that lie in a record."""
    history = member(v, "history")
    held, found = text(member(history, "mode")) == "embedded", items(history, "events")
    if isinstance(found, Cell):
        return Cell(F.when(held, found.col).otherwise(F.array()), found.need)
    return F.coalesce(F.when(held, found), F.array().cast("array<variant>"))


def listed(raw: Column, word: str) -> Column:
    """The VARIANT of a list of a text's value and a word: the word stands second if the text is one JSON value without repeated
    keys, see value()."""
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit(f',"{word}"]')))


def lean(raw: Column, words, tables, wanted: frozenset[str]) -> tuple[dict[str, Column], Column, Column]:
    """For records in a column raw: the columns 'listed' and 'lean', what from_json() takes from them; whether that is sure to be
    right, and the facts, both given these columns."""
    v = Cell(F.col("lean"), Need())
    text(v.member("id"))
    told = facts(v, embedded(v), words, tables, wanted)
    columns, fit = taken(raw, v, sorted({w for kind in wanted for w in _RULED.get(kind, [])}), "$[0]")
    return columns, fit, told


def taken(raw: Column, v: Cell, without: list[str], path: str | None = None) -> tuple[dict[str, Column], Column]:
    """For records in a column raw: the columns 'listed' and 'lean' for what v, a cell of lean, was asked; and whether that is sure
    to be right, given these columns. without: words that no such text holds. path: of the record in listed, see Need.doubtful()."""
    spoilt, word = f"_{uuid.uuid4().hex}", uuid.uuid4().hex
    fields = v.need.ddl().removeprefix("struct<").removesuffix(">")
    lean = F.from_json(raw, f"struct<{fields},{spoilt}: string>", {"columnNameOfCorruptRecord": spoilt, "maxNestingDepth": str(DEPTH), "maxNumLen": str(_DIGITS)})
    fit = (F.try_variant_get("listed", "$[1]", "string") == word) & F.startswith(raw, F.lit("{")) & F.col("lean").isNotNull() & v.col[spoilt].isNull()
    for s in [_ESCAPE, *_KEYS, *without]:
        fit = fit & ~F.contains(raw, F.lit(s))
    fit = fit & ~(raw.rlike(_EXPONENT) & raw.rlike(_LARGE)) & ~v.need.doubtful(v.col, path)
    return {"listed": listed(raw, word), "lean": lean}, F.coalesce(fit, F.lit(False))


def facts(v: Top | Cell, events: Column | Cell, words, tables, wanted: frozenset[str] = KINDS) -> Column:
    """The facts of an object of the kinds that are wanted, in the order of records.facts_of(). events: its embedded events."""
    history, publication, top = member(v, "history"), member(v, "publication"), F.lit("")
    own = text(member(v, "id"))
    none = F.array().cast(ArrayType(_FACT))
    parts = []

    def add(kind: str, make) -> None:
        if kind in wanted:
            parts.append(make())

    def record():
        ids = ids_of(v, events, tables["collections"])
        sizes = F.concat_ws(",", *[many(items(v, name)).cast("string") for name in tables["collections"]], many(events).cast("string"))
        return some(fact("record", top, id=own, a=text(member(v, words.version_member)), b=text(member(v, "disclosure")), c=sizes, n=number(member(v, "revision")), m=F.size(ids) - F.size(F.array_distinct(ids)), expected=strings(v, "profiles")))

    add("record", record)
    add("entity", lambda: entity(v, "record", top))
    for name in tables["collections"]:
        add("size", lambda name=name: size(items(v, name), name, f"/{name}"))
        add("entity", lambda name=name: each(items(v, name), F.lit(f"/{name}"), lambda x, p: entity(x, name, p)))
    add("entity", lambda: each(items(v, "policies"), F.lit("/policies"), lambda x, p: each(items(x, "rules"), under(p, "rules"), lambda r, q: entity(r, "policyRules", q))))
    add("size", lambda: size(events, "events", "/history/events"))
    add("entity", lambda: each(events, F.lit("/history/events"), lambda e, p: entity(e, "events", p)))

    def external():
        named = F.transform(strings(history, "eventIds"), lambda s: fact("external", F.lit("/history/eventIds"), id=s))
        return F.when(text(member(history, "mode")) == "external", named).otherwise(none)

    add("external", external)
    add("ref", lambda: references(v, tables["references"], top))

    def basis(b, path):
        role, ref = text(member(b, "role")), text(member(b, "ref"))
        kinds = F.lit(None).cast("array<string>")
        for name, collection in tables["roles"].items():
            kinds = F.when(role == name, F.array(F.lit(collection))).otherwise(kinds)
        return some(fact("ref", under(path, "ref"), id=ref, expected=kinds), ref.isNotNull() & ~role.eqNullSafe(F.lit("external")))

    for name in ("claims", "relations"):
        add("ref", lambda name=name: each(items(v, name), F.lit(f"/{name}"), lambda x, p: each(items(x, "basis"), under(p, "basis"), basis)))
    add("ref", lambda: references(member(publication, "policyEvaluation"), tables["evaluation"], F.lit("/publication/policyEvaluation")))
    other = is_object(publication) & (text(member(v, "disclosure")) == "public") & ~text(member(publication, "publicRecordId")).eqNullSafe(own)
    add("diagnostic", lambda: some(fact("diagnostic", F.lit("/publication/publicRecordId"), a=F.lit("PUBLIC_DISCLOSURE"), b=F.lit("error")), other))
    if wanted & {"event", "times", "inputs", "outputs", "ref"}:
        parts.append(each(events, F.lit("/history/events"), lambda e, p: F.when(is_object(e), joined(event_facts(e, p, v, words, tables, wanted))).otherwise(none)))

    def relation(r, path):
        predicate, subject, target = (text(member(r, k)) for k in ("predicate", "subject", "object"))
        return some(fact("relation", path, id=text(member(r, "operationRef")), a=predicate, b=subject, c=target), (predicate != "") & subject.isNotNull() & target.isNotNull())

    add("relation", lambda: each(items(v, "relations"), F.lit("/relations"), relation))
    late = F.lit("TEMPORAL_ORDER")
    for name in ("sources", "observations"):  # plain() leaves those with freshness to the parser
        add("times", lambda name=name: each(items(v, name), F.lit(f"/{name}"), lambda x, p: F.array(fact("times", under(p, "freshness", "retrievedAt"), c=late), fact("times", under(p, "freshness", "expiresAt"), c=late))))
    add("times", lambda: each(items(v, "policies"), F.lit("/policies"), lambda x, p: F.array(fact("times", under(p, "validUntil"), a=text(member(x, "validFrom")), b=text(member(x, "validUntil")), c=late))))
    window = lambda w, p: some(fact("window", under(p, "end"), n=number(member(w, "start")), m=number(member(w, "end"))), is_object(w))
    add("window", lambda: each(items(v, "apertures"), F.lit("/apertures"), lambda x, p: F.concat(*[each(items(x, k), under(p, k), window) for k in ("ranges", "windows")])))
    for name in ("claims", "measurements"):
        add("window", lambda name=name: each(items(v, name), F.lit(f"/{name}"), lambda x, p: window(member(x, "window"), under(p, "window"))))
    add("graph", lambda: graph(v, words, tables["acyclic"]))
    add("twin", lambda: twins(v, events, tables["collections"]))
    from tracewell.operators import profile_columns, rule_columns  # they build on this module

    parts += rule_columns.failing(v, events, words, tables, wanted)
    if "profile" in wanted:
        parts.append(profile_columns.facts(v, events, words))
    return joined(parts)
