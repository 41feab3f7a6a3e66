"""The rules of profiles as column expressions over a record's VARIANT, or over what from_json() takes from its text: what
profiles.mismatches() finds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tracewell.operators import profiles, schema_columns
from tracewell.operators.fact_columns import _FACT, Cell, Need, Top, embedded, fact, is_object, items, many, member, once, strings, taken, text
from tracewell.operators.schema_columns import Typed


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def among(values: Column | Cell, make, of) -> Column:
    """make, a function of lists like exists(), of the items of a list and of(item)."""
    if isinstance(values, Cell):
        return make(values.col, lambda x: of(Typed(x, values.need.item)))
    return make(values, of)


def whole(v: Column | Typed, key: str) -> Column:
    """A member as VARIANT."""
    return v.member(key).leaf("variant") if isinstance(v, Typed) else member(v, key)


def told(values: Column | Cell) -> Column:
    """How many items of any type a list has."""
    if isinstance(values, Cell):
        values.need.item.leaf = values.need.item.leaf or "any"
    return many(values)


def truthy(v: Column | Top | Typed, key: str) -> Column:
    """Whether a member is there and is neither null, false, zero nor empty."""
    if isinstance(v, Typed):  # a list, as anything else is left to VARIANT
        return told(items(v, key)) > 0
    v = member(v, key)
    return true(~F.to_json(v).isin("null", "false", "0", "0.0", '""', "[]", "{}"))


def has(v: Column | Typed, *keys: str) -> Column:
    if isinstance(v, Typed):  # no text that holds a null is read so
        out = v.col.isNotNull()
        for k in keys:
            out = out & v.member(k).there()
        return out
    m = schema_columns.fields(v)
    out = F.lit(True)
    for k in keys:
        out = out & true(F.map_contains_key(m, k))
    return out


def finished(e: Column) -> Column:
    return true(text(member(e, "finalStatus")) == "completed")


def without_result(e: Column) -> Column:
    return finished(e) & ~truthy(e, "outputs")


def operation(e: Column, words, kinds: list[str], effects: list[str]) -> Column:
    return true(text(member(e, "operationType")).isin([f"{words.operations}.{k}" for k in kinds])) & true(text(member(e, "effectClass")).isin(effects))


def is_operation(e: Column, words, kind: str) -> Column:
    return true(text(member(e, "operationType")) == f"{words.operations}.{kind}")


def transformed(e: Column, words) -> Column:
    return operation(e, words, profiles.TRANSFORMING, ["derive", "transform", "render"])


def generated(e: Column, words) -> Column:
    p = whole(e, "parameters")
    ok = has(p, *profiles.GENERATION_PARAMETERS)
    ok = ok & (~is_operation(e, words, "graft") | (F.size(items(p, "parentRefs")) >= 2)) & (~is_operation(e, words, "inpaint") | (F.size(items(p, "regionRefs")) >= 1))
    return operation(e, words, profiles.GENERATING, ["generate"]) & ok & ~without_result(e)


def processed(e: Column, words) -> Column:
    shaped, given = F.lit(True), whole(e, "parameters")
    compiler = schema_columns.Compiler(profiles.PARAMETERS)
    for kind in profiles.PARAMETERS:
        shaped = F.when(is_operation(e, words, kind), F.size(compiler.errors(kind, given)) == 0).otherwise(shaped)
    shaped = ~has(e, "parameters") | shaped
    return operation(e, words, profiles.PROCESSING, ["derive", "transform"]) & shaped & ~without_result(e)


def operations(events: Column | Cell, words, found, also=None) -> Column:
    """Of each event, whether it is a fitting operation, and whether it completed with a result."""
    return among(events, F.transform, lambda e: F.struct(found(e, words).alias("fits"), (finished(e) & truthy(e, "outputs") & (also(e) if also else F.lit(True))).alias("done")))


def any_fits(found: Column) -> Column:
    return F.exists(found, lambda x: x["fits"])


def tied(v: Top | Cell, found: Column, words, relations: list[str]) -> Column:
    """If a fitting operation completed: two representations and a relation that names its operation."""
    names = [f"{words.relations}:{x}" for x in relations]
    two = F.size(among(items(v, "representations"), F.filter, is_object)) >= 2
    named = among(items(v, "relations"), F.exists, lambda r: true(text(member(r, "predicate")).isin(names)) & has(r, "operationRef"))
    return ~F.exists(found, lambda x: x["fits"] & x["done"]) | (two & named)


def rules(v: Top | Cell, events: Column | Cell, words) -> dict[str, list[Column] | tuple]:
    """Per profile, what must hold, in the order of profiles.PROFILES; or operations(), and what must hold as a function of them."""
    history, publication = member(v, "history"), member(v, "publication")
    external = true(text(member(history, "mode")) == "external")
    outside = told(items(history, "eventIds")) > 0
    any_ = lambda found: F.when(external, outside).otherwise(any_fits(found))
    count = lambda name: many(items(v, name)) >= 1
    permitted = lambda x: true(text(member(member(x, "policyEvaluation"), "result")) == "permitted")

    def receipt(e: Column) -> Column:
        ok = permitted(e) & is_operation(e, words, "publish")
        for k, x in profiles.PUBLISHED.items():
            ok = ok & true(text(member(e, k)) == x)
        return ok

    audio = among(items(v, "representations"), F.exists, lambda x: true(F.startswith(text(member(x, "mediaType")), F.lit("audio/"))) & is_object(member(x, "audio")))
    intent = lambda e: has(whole(e, "parameters"), "preservationIntent")
    return {
        "core": [],
        "audio": [audio],
        "listening": [count("encounters"), count("apertures"), count("listeningPasses")],
        "analysis": [truthy(v, "measurements") | truthy(v, "regions")],
        "transformation": (operations(events, words, transformed, intent), lambda x: [any_(x), tied(v, x, words, profiles.TRANSFORMED)]),
        "generation": (operations(events, words, generated), lambda x: [any_(x)]),
        "processing": (operations(events, words, processed), lambda x: [any_(x), tied(v, x, words, profiles.PROCESSED)]),
        "observation": [count("sources"), count("observations"), among(items(v, "observations"), F.forall, lambda x: ~is_object(x) | has(x, *profiles.OBSERVED_AXES))],
        "mapping": [count("observations"), count("mappings")],
        "agent": [among(items(v, "actors"), F.exists, lambda x: true(text(member(x, "actorKind")) == "agent")), count("agentRuns"), count("capabilities")],
        "publication": [true(text(member(v, "disclosure")) == "public") & permitted(publication) & F.when(external, outside).otherwise(among(events, F.exists, receipt))],
    }


def lean(raw: Column, words) -> tuple[dict[str, Column], Column, Column]:
    """fact_columns.lean(), for facts of the kind 'profile' alone."""
    v = Typed(F.col("lean"), Need())
    found = facts(v, embedded(v), words)
    columns, fit = taken(raw, v, ["null"])
    return columns, fit, found


def facts(v: Top, events: Column, words) -> Column:
    """A fact of the kind 'profile' for each rule that fails: a is the profile, n the rule."""
    declared, none = strings(v, "profiles"), F.array().cast(ArrayType(_FACT))
    made = lambda p, n: fact("profile", F.lit("/profiles"), a=p, n=F.lit(n))
    known = rules(v, events, words)
    unknown = F.transform(F.filter(declared, lambda p: ~p.isin(list(known))), lambda p: made(p, -1))
    core = F.when(F.array_contains(declared, "core"), none).otherwise(F.array(made(F.lit("core"), -1)))
    failed = {}
    failing = lambda name, checks: F.concat(*[F.when(ok, none).otherwise(F.array(made(F.lit(name), k))) for k, ok in enumerate(checks)])
    for name, checks in known.items():
        if isinstance(checks, tuple):
            failed[name] = once(checks[0], lambda x: failing(name, checks[1](x)))  # noqa: B023  called at once
        elif checks:
            failed[name] = failing(name, checks)

    def of(p: Column) -> Column:
        out = none
        for name, x in failed.items():
            out = F.when(p == name, x).otherwise(out)
        return out

    return F.concat(unknown, core, F.flatten(F.transform(F.array_distinct(declared), of)))
