"""Rules that look at one record alone, as column expressions: a fact for each place that fails, where the record stands, so
that no facts of what is sound are written, shuffled or joined. records.failing_facts() finds the same from parsed facts.

Ids are compared as sets first. Places are only made where an id fails, and looked up in the few that do; a record with many of
these, whose lists would be searched over and over, is left to the parser, which looks ids up in tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tracewell.operators.fact_columns import _FACT, Cell, Top, each, fact, facts, ids_of, is_object, items, joined, many, mapped, member, once, placed_ids, same_record, some, strings, text, under

#: Kinds of the facts of what fails.
FAILS = frozenset(["dangling", "foreign", "reused", "unreceipted"])
#: The same, and the graph of a record's descents.
KINDS = FAILS | {"descent"}
#: Ids that may fail in a record, and pairs of receipts and of what they are compared with, before it is left to the parser.
MOST, PAIRS = 100, 20_000


def none() -> Column:
    return F.array().cast(ArrayType(_FACT))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def left(kind: str) -> Column:
    """A fact that leaves a record to the parser, for facts of one kind."""
    return F.array(fact("unread", F.lit(""), a=F.col("raw"), b=F.lit(kind)))


def few(kind: str, ids: Column, told) -> Column:
    """told(ids), the facts of the ids that fail in a record, if there are any and few."""
    return once(ids, lambda u: F.when(F.size(u) == 0, none()).when(F.size(u) <= MOST, told(u)).otherwise(left(kind)))


def reached(v: Column | Cell, pattern: str) -> Column:
    """The strings, and nulls, that a pattern reaches."""
    head, _, rest = pattern.partition(".")
    key, is_list = head.removesuffix("[]"), head.endswith("[]")
    if not rest:
        return strings(v, key) if is_list else F.array(text(member(v, key)))
    return F.flatten(mapped(items(v, key), lambda x: reached(x, rest))) if is_list else reached(member(v, key), rest)


def grouped(patterns: dict[str, list[str]]) -> dict[str, list[str]]:
    """Patterns by the list that they go through ('' for those that start otherwise), so that each list is walked once."""
    out: dict[str, list[str]] = {}
    for pattern in patterns:
        head, _, rest = pattern.partition(".")
        through = head.endswith("[]") and rest
        out.setdefault(head.removesuffix("[]") if through else "", []).append(rest if through else pattern)
    return out


def all_reached(v: Column | Cell, patterns: dict[str, list[str]]) -> Column:
    def through(rest):
        return lambda x: joined([reached(x, p) for p in rest])

    return joined([F.flatten(mapped(items(v, key), through(rest))) if key else through(rest)(v) for key, rest in grouped(patterns).items()])


def referred(v: Top | Cell, events: Column | Cell, words, tables) -> Column:
    """The ids that an object refers to, but those of states."""

    def basis(b):
        return F.when(~text(member(b, "role")).eqNullSafe(F.lit("external")), text(member(b, "ref")))

    def event(e):
        parameters, effect, kind = member(e, "parameters"), text(member(e, "effectClass")), text(member(e, "operationType"))
        made = F.when(effect == "generate", all_reached(parameters, tables["generated"])).otherwise(no_strings())
        processed = F.when(kind.isin([f"{words.operations}.{x}" for x in tables["processing"]]), all_reached(parameters, tables["processed"])).otherwise(no_strings())
        return F.concat(all_reached(e, tables["receipt"]), all_reached(member(e, "policyEvaluation"), tables["evaluation"]), made, processed)

    based = [F.flatten(mapped(items(v, name), lambda x: mapped(items(x, "basis"), basis))) for name in ("claims", "relations")]
    published = all_reached(member(member(v, "publication"), "policyEvaluation"), tables["evaluation"])
    return F.concat(all_reached(v, tables["references"]), *based, published, F.flatten(mapped(events, event)))


def known_ids(v: Top | Cell, events: Column | Cell, tables) -> Column:
    """The ids of a record's entities, and of events that lie outside it."""
    history = member(v, "history")
    outside = F.when(text(member(history, "mode")) == "external", strings(history, "eventIds")).otherwise(no_strings())
    return F.concat(ids_of(v, events, tables["collections"]), outside)


def dangling(v: Top | Cell, events: Column | Cell, words, tables) -> Column:
    """References to what the record lacks."""
    lacking = F.array_except(F.filter(referred(v, events, words, tables), lambda x: x.isNotNull()), known_ids(v, events, tables))
    refs = facts(v, events, words, tables, frozenset(["ref"]))
    made = lambda r: fact("dangling", r["path"], id=r["id"])
    return few("dangling", lacking, lambda u: F.transform(F.filter(refs, lambda r: F.array_contains(u, r["id"])), made))


def foreign(v: Top | Cell, events: Column | Cell) -> Column:
    """Receipts that name another record."""
    return each(events, F.lit("/history/events"), lambda e, p: some(fact("foreign", under(p, "recordId")), is_object(e) & ~same_record(e, v)))


def works(v: Top | Cell) -> Column:
    return F.filter(mapped(items(v, "representations"), lambda x: text(member(x, "id"))), lambda x: x.isNotNull())


def descents(v: Top | Cell, words, tables) -> Column:
    """Parent, child, operation and path of each relation with a direction of descent."""
    named = lambda end: [f"{words.relations}:{name}" for name, descent in tables["descent"] if descent == end]

    def edge(r, k):
        predicate, subject, target = (text(member(r, key)) for key in ("predicate", "subject", "object"))
        first = F.when(predicate.isin(named("subject")), True).when(predicate.isin(named("object")), False)
        ends = [F.when(first, target).otherwise(subject), F.when(first, subject).otherwise(target)]
        there = first.isNotNull() & subject.isNotNull() & target.isNotNull()
        return F.when(there, F.struct(ends[0].alias("parent"), ends[1].alias("child"), text(member(r, "operationRef")).alias("operation"), F.concat(F.lit("/relations/"), k.cast("string")).alias("path")))

    return F.filter(mapped(items(v, "relations"), edge), lambda x: x.isNotNull())


def serious(e: Column | Cell, tables) -> Column:
    return F.coalesce(text(member(e, "effectClass")).isin(tables["consequential"]), F.lit(False))


def reused(v: Top | Cell, events: Column | Cell, words, tables) -> Column:
    """Outputs of what changes something that are its inputs as well, and works that descend from themselves."""

    def own(e, p):
        both = F.array_intersect(strings(e, "inputs"), strings(e, "outputs"))
        hit = lambda u: F.filter(F.transform(strings(e, "outputs"), lambda s, k: F.when(F.array_contains(u, s), fact("reused", F.concat(under(p, "outputs"), F.lit("/"), k.cast("string"))))), lambda x: x.isNotNull())
        return F.when(serious(e, tables), few("reused", both, hit)).otherwise(none())

    def loops(edges):
        back = F.filter(edges, lambda x: x["parent"] == x["child"])
        hit = lambda u, found: F.transform(F.filter(found, lambda x: F.array_contains(u, x["child"])), lambda x: fact("reused", F.concat(x["path"], F.lit("/subject"))))
        return once(back, lambda b: F.when(F.size(b) == 0, none()).otherwise(few("reused", F.array_intersect(F.transform(b, lambda x: x["child"]), works(v)), lambda u: hit(u, b))))

    return F.concat(each(events, F.lit("/history/events"), own), loops(descents(v, words, tables)))


def unreceipted(v: Top | Cell, events: Column | Cell, words, tables) -> Column:
    """Works whose descent names no receipt of the record, and receipts with a work that no relation ties to their inputs. Of
    receipts that share an id the first counts."""

    def unnamed(edges, own):
        lacking = F.array_except(F.transform(edges, lambda x: x["operation"]), known_ids(v, events, tables))
        found = lambda u: F.filter(edges, lambda x: (x["operation"].isNull() | F.array_contains(u, x["operation"])) & F.array_contains(own, x["child"]))
        return once(lacking, lambda u: F.when(F.size(u) == 0, none()).otherwise(F.transform(found(F.filter(u, lambda x: x.isNotNull())), lambda x: fact("unreceipted", F.concat(x["path"], F.lit("/operationRef"))))))

    def loose(edges, own, ids):
        def receipt(e, k):
            inputs, name = strings(e, "inputs"), text(member(e, "id"))
            tied = F.transform(F.filter(edges, lambda x: (x["operation"] == name) & F.array_contains(inputs, x["parent"])), lambda x: x["child"])
            stray = F.array_except(F.array_intersect(strings(e, "outputs"), own), tied)
            first = F.array_position(ids, name) == k + 1
            path = F.concat(F.lit("/history/events/"), k.cast("string"), F.lit("/outputs"))
            return F.when(serious(e, tables) & name.isNotNull() & first & (F.size(stray) > 0), fact("unreceipted", path))

        return F.filter(mapped(events, receipt), lambda x: x.isNotNull())

    def told(edges, own, ids):
        pairs = lambda a, b: F.size(a).cast("long") * F.size(b)
        inputs = F.aggregate(mapped(events, lambda e: many(items(e, "inputs"))), F.lit(0), lambda a, b: a + b)
        much = (pairs(edges, own) > PAIRS) | (pairs(ids, ids) > PAIRS) | (pairs(edges, ids) > PAIRS) | (inputs.cast("long") * F.size(edges) > PAIRS)
        return F.when(much, left("unreceipted")).otherwise(F.concat(unnamed(edges, own), loose(edges, own, ids)))

    names = mapped(events, lambda e: text(member(e, "id")))
    return once(descents(v, words, tables), lambda edges: once(works(v), lambda own: once(names, lambda ids: told(edges, own, ids))))


def descent(v: Top | Cell, events: Column | Cell, words, tables) -> Column:
    """One fact of all descents of a record: n of them, each a parent and a child, and then id and path of every entity."""

    def told(edges):
        ends = F.flatten(F.transform(edges, lambda x: F.array(x["parent"], x["child"])))
        places = F.flatten(F.transform(placed_ids(v, events, tables["collections"]), lambda x: F.array(x["id"], x["path"])))
        return F.when(F.size(edges) > 0, F.array(fact("descent", F.lit(""), n=F.size(edges), expected=F.concat(ends, places)))).otherwise(none())

    return once(descents(v, words, tables), told)


def failing(v: Top | Cell, events: Column | Cell, words, tables, wanted: frozenset[str]) -> list[Column]:
    made = {
        "foreign": lambda: foreign(v, events),
        "dangling": lambda: dangling(v, events, words, tables),
        "reused": lambda: reused(v, events, words, tables),
        "unreceipted": lambda: unreceipted(v, events, words, tables),
        "descent": lambda: descent(v, events, words, tables),
    }
    return [make() for kind, make in made.items() if kind in wanted]
