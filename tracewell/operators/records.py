"""Records to long tables, and the semantic rules over them.

One pass reads each record and emits its facts: entities, references, receipts, their inputs and outputs, relations,
intervals and times; by columns over VARIANT where that is sure to be right, else by the strict parser. Rules are joins, windows and filters over those rows, keyed by record_key (never by the record's
own id, which may be missing, repeated or malicious). Diagnostics name the rule and the place, never a value.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import checks, fact_columns, rule_columns
from tracewell.operators.workspace import materialized
from tracewell.sources.strict_json import JsonError, parse, walk

#: The entity collections in scan order.
COLLECTIONS = [
    "actors", "sources", "representations", "encounters", "apertures", "listeningPasses", "claims", "measurements", "regions", "observations",
    "mappings", "relations", "policies", "contexts", "agentRuns", "capabilities",
]
#: Effects that change what exists.
CONSEQUENTIAL = ["delete", "derive", "expire", "external-action", "generate", "map", "perform", "publish", "remember", "render", "transform", "withhold"]
#: Local names of the processing operations.
PROCESSING = ["granulate", "extract", "reduce", "fragment", "timestretch", "pitchshift"]
#: Which collection evidence of a role must be in.
ROLES = {"source": "sources", "representation": "representations", "claim": "claims", "measurement": "measurements", "observation": "observations", "context": "contexts", "operation": "events"}
AUTHORITIES = ["actors", "policies", "policyRules"]
#: Where references stand ([] is every item), and the collections they must be in (none: any).
REFERENCES = {
    "createdBy": ["actors"],
    "actors[].authorityRefs[]": AUTHORITIES,
    "sources[].policyRefs[]": ["policies"],
    "sources[].causalClaimRefs[]": ["claims"],
    "representations[].policyRefs[]": ["policies"],
    "encounters[].actors[]": ["actors"],
    "encounters[].contextRefs[]": ["contexts"],
    "listeningPasses[].actors[]": ["actors"],
    "listeningPasses[].representations[]": ["representations"],
    "listeningPasses[].claimRefs[]": ["claims"],
    "listeningPasses[].encounterRef": ["encounters"],
    "listeningPasses[].apertureRef": ["apertures"],
    "claims[].about[]": [],
    "claims[].actor": ["actors"],
    "claims[].listeningPassRef": ["listeningPasses"],
    "claims[].alternativeClaimRefs[]": ["claims"],
    "claims[].method.apparatusRefs[]": [],
    "measurements[].about": [],
    "measurements[].actor": ["actors"],
    "measurements[].claimRef": ["claims"],
    "measurements[].method.apparatusRefs[]": [],
    "regions[].representationRef": ["representations"],
    "regions[].createdBy": ["actors"],
    "regions[].method.apparatusRefs[]": [],
    "observations[].sourceRef": ["sources"],
    "observations[].claimRef": ["claims"],
    "observations[].method.apparatusRefs[]": [],
    "mappings[].sourceObservationRefs[]": ["observations"],
    "mappings[].actors[]": ["actors"],
    "relations[].subject": [],
    "relations[].object": [],
    "relations[].assertedBy": ["actors"],
    "relations[].operationRef": ["events"],
    "policies[].issuer": ["actors"],
    "policies[].rules[].targets[]": [],
    "policies[].rules[].subjects[]": ["actors"],
    "agentRuns[].actorRef": ["actors"],
    "agentRuns[].capabilityRefs[]": ["capabilities"],
    "agentRuns[].memoryRefs[]": [],
    "agentRuns[].authorityRefs[]": [],
    "agentRuns[].operationRefs[]": ["events"],
    "publication.approvedBy": ["actors"],
}
#: The same inside a receipt, and inside a policy evaluation.
RECEIPT_REFERENCES = {"actors[]": ["actors"], "inputs[]": [], "outputs[]": [], "claimRefs[]": ["claims"]}
EVALUATION_REFERENCES = {"policyRefs[]": ["policies"], "authorityRefs[]": AUTHORITIES, "evaluator": ["actors"], "targets[]": []}
#: The same inside the parameters of a receipt that generates, and of one that processes.
GENERATED_REFERENCES = {"parentRefs[]": [], "conditioningRefs[]": [], "regionRefs[]": [], "rejectedOutputRefs[]": []}
PROCESSED_REFERENCES = {"regionRefs[]": ["regions"], "selection.regionRefs[]": ["regions"]}
#: Acyclic relations; the end that is the descendant (None: no direction of descent); and, of those stored
#: backwards in the cycle graph, the relation they are the inverse of.
ACYCLIC = [
    ("derived-from", "subject", None),
    ("derivation-of", "object", "derived-from"),
    ("version-of", "subject", None),
    ("revision-of", "subject", None),
    ("part-of", None, None),
    ("has-part", None, "part-of"),
    ("captured-from", "subject", None),
    ("transduced-from", "subject", None),
    ("measured-from", None, None),
    ("segmented-from", "subject", None),
    ("isolated-from", "subject", None),
    ("granulated-from", "subject", None),
    ("mapped-from", "subject", None),
    ("rendered-as", "object", None),
    ("performed-as", "object", None),
    ("parent-of", "object", None),
    ("child-of", "subject", "parent-of"),
    ("variation-of", "subject", None),
    ("continuation-of", "subject", None),
]

FACTS = "record_key string, kind string, place int, path string, id string, a string, b string, c string, d string, n double, m double, expected array<string>"


@dataclass(frozen=True)
class Vocabulary:
    """What a corpus calls things: the namespaces of its registered relations and of its operation types, the member that
    names the version of the record format, and the version that is read."""

    relations: str
    operations: str
    version_member: str = "formatVersion"
    version: str = "0.2.0"


def strings(value) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def expand(value, pattern: str, path: str = ""):
    """(pointer, string) for each place that a pattern reaches. A list's strings are counted without its other items."""
    head, _, rest = pattern.partition(".")
    key, many = head.removesuffix("[]"), head.endswith("[]")
    if not isinstance(value, dict):
        return
    v = value.get(key)
    if not rest:
        for k, s in enumerate(strings(v)) if many else [("", v)] if isinstance(v, str) else ():
            yield (f"{path}/{key}/{k}" if many else f"{path}/{key}"), s
    elif many:
        for k, item in enumerate(v if isinstance(v, list) else ()):
            yield from expand(item, rest, f"{path}/{key}/{k}")
    else:
        yield from expand(v, rest, f"{path}/{key}")


def _items(doc, key: str) -> list:
    v = doc.get(key) if isinstance(doc, dict) else None
    return v if isinstance(v, list) else []


def _text(v, key: str) -> str | None:
    x = v.get(key) if isinstance(v, dict) else None
    return x if isinstance(x, str) else None


def _number(v) -> float | None:
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None


def facts_of(doc: dict, words: Vocabulary) -> list[tuple]:
    """kind, place, path, id, a, b, c, d, n, m, expected of each fact of a record."""
    out: list[tuple] = []
    if not isinstance(doc, dict):
        return out

    def fact(kind, path, id=None, a=None, b=None, c=None, d=None, n=None, m=None, expected=None):
        out.append((kind, len(out), path, id, a, b, c, d, n, m, expected))

    def refs(value, table: dict[str, list[str]], path: str):
        for pattern, kinds in table.items():
            for p, s in expand(value, pattern, path):
                fact("ref", p, s, expected=kinds or None)

    def entity(value, collection, path):
        if isinstance(value, dict) and _text(value, "id") is not None:
            ids.append((value["id"], path))
            fact("entity", path, value["id"], collection, _text(value, "type"), _text(value, "disclosure"))

    ids: list[tuple[str, str]] = []
    history = doc.get("history") if isinstance(doc.get("history"), dict) else {}
    events = _items(history, "events") if history.get("mode") == "embedded" else []
    sizes = ",".join(str(len(x)) for x in [*(_items(doc, name) for name in COLLECTIONS), events])
    fact("record", "", _text(doc, "id"), _text(doc, words.version_member), _text(doc, "disclosure"), sizes, n=_number(doc.get("revision")), expected=strings(doc.get("profiles")))
    entity(doc, "record", "")
    for name in COLLECTIONS:
        fact("size", f"/{name}", a=name, n=float(len(_items(doc, name))))
        for k, v in enumerate(_items(doc, name)):
            entity(v, name, f"/{name}/{k}")
    for k, p in enumerate(_items(doc, "policies")):
        for j, r in enumerate(_items(p, "rules")):
            entity(r, "policyRules", f"/policies/{k}/rules/{j}")
    fact("size", "/history/events", a="events", n=float(len(events)))
    for k, e in enumerate(events):
        entity(e, "events", f"/history/events/{k}")
    for s in strings(history.get("eventIds")) if history.get("mode") == "external" else ():
        fact("external", "/history/eventIds", s)

    refs(doc, REFERENCES, "")
    for name in ("claims", "relations"):
        for k, v in enumerate(_items(doc, name)):
            for j, item in enumerate(_items(v, "basis")):
                role, ref = _text(item, "role"), _text(item, "ref")
                if ref is not None and role != "external":
                    fact("ref", f"/{name}/{k}/basis/{j}/ref", ref, expected=[ROLES[role]] if role in ROLES else None)
    publication = doc.get("publication")
    if isinstance(publication, dict):
        refs(publication.get("policyEvaluation"), EVALUATION_REFERENCES, "/publication/policyEvaluation")
        if doc.get("disclosure") == "public" and _text(publication, "publicRecordId") != _text(doc, "id"):
            fact("diagnostic", "/publication/publicRecordId", a="PUBLIC_DISCLOSURE", b="error")

    for k, e in enumerate(events):
        if not isinstance(e, dict):
            continue
        path = f"/history/events/{k}"
        evaluation = e.get("policyEvaluation")
        fact("event", path, _text(e, "id"), _text(e, "effectClass"), _text(e, "finalStatus"), _text(evaluation, "result"), None if e.get("recordId") == doc.get("id") else "other record", _number(e.get("sequence")))
        fact("times", f"{path}/endedAt", a=_text(e, "startedAt"), b=_text(e, "endedAt"), c="EVENT_SEQUENCE")
        for key in ("inputs", "outputs"):
            for j, s in enumerate(strings(e.get(key))):
                fact(key, f"{path}/{key}/{j}", _text(e, "id"), s, _text(e, "effectClass"), path)
        refs(e, RECEIPT_REFERENCES, path)
        refs(evaluation, EVALUATION_REFERENCES, f"{path}/policyEvaluation")
        parameters = e.get("parameters")
        if e.get("effectClass") == "generate":
            refs(parameters, GENERATED_REFERENCES, f"{path}/parameters")
        if _text(e, "operationType") in {f"{words.operations}.{x}" for x in PROCESSING}:
            refs(parameters, PROCESSED_REFERENCES, f"{path}/parameters")
    for k, r in enumerate(_items(doc, "relations")):
        predicate, subject, target = (_text(r, x) for x in ("predicate", "subject", "object"))
        if predicate and subject is not None and target is not None:
            fact("relation", f"/relations/{k}", _text(r, "operationRef"), predicate, subject, target)

    for name in ("sources", "observations"):
        for k, v in enumerate(_items(doc, name)):
            f = v.get("freshness") if isinstance(v, dict) else None
            fact("times", f"/{name}/{k}/freshness/retrievedAt", a=_text(f, "observedAt"), b=_text(f, "retrievedAt"), c="TEMPORAL_ORDER")
            fact("times", f"/{name}/{k}/freshness/expiresAt", a=_text(f, "retrievedAt"), b=_text(f, "expiresAt"), c="TEMPORAL_ORDER")
    for k, p in enumerate(_items(doc, "policies")):
        fact("times", f"/policies/{k}/validUntil", a=_text(p, "validFrom"), b=_text(p, "validUntil"), c="TEMPORAL_ORDER")
    spans = [(f"/apertures/{k}/{x}/{j}", w) for k, v in enumerate(_items(doc, "apertures")) for x in ("ranges", "windows") for j, w in enumerate(_items(v, x))]
    spans += [(f"/{x}/{k}/window", v.get("window")) for x in ("claims", "measurements") for k, v in enumerate(_items(doc, x)) if isinstance(v, dict)]
    for path, w in spans:
        if isinstance(w, dict):
            fact("window", f"{path}/end", n=_number(w.get("start")), m=_number(w.get("end")))

    for path, _, v, _ in walk(doc):
        if not isinstance(v, dict) or "/extensions/" in path:
            continue
        for state, key in (("withheld", "policyRefs"), ("deleted", "receiptRefs")):
            if v.get("state") == state:
                for k, s in enumerate(strings(v.get(key))):
                    fact("ref", f"{path}/{key}/{k}", s)
        unexplained = _text(v, "reason") is None
        if unexplained and path.endswith("/health") and v.get("status") in ("degraded", "error", "unavailable", "unknown"):
            fact("diagnostic", path, a="STATE_REASON_MISSING", b="warning")
        if unexplained and path.endswith("/freshness") and v.get("status") == "unknown":
            fact("diagnostic", path, a="STATE_REASON_MISSING", b="warning")
    known = {f"{words.relations}:{name}": inverse is not None for name, _, inverse in ACYCLIC}
    edges: list[str] = []
    for k, r in enumerate(_items(doc, "relations")):
        predicate, subject, target = (_text(r, x) for x in ("predicate", "subject", "object"))
        if predicate in known and subject is not None and target is not None:
            edges += [target, subject, f"/relations/{k}"] if known[predicate] else [subject, target, f"/relations/{k}"]
    if edges:
        fact("graph", "", expected=edges)
    by_id = sorted(ids, key=lambda x: x[0].encode("utf-8", "surrogatepass"))
    again = [x for before, x in pairwise(by_id) if before[0] == x[0]]
    for own, path in again:
        fact("twin", path, own)
    out[0] = (*out[0][:9], float(len(again)), out[0][10])
    return out


#: What the columns of fact_columns need to know of the record format.
TABLES = {
    "collections": COLLECTIONS,
    "references": REFERENCES,
    "receipt": RECEIPT_REFERENCES,
    "evaluation": EVALUATION_REFERENCES,
    "generated": GENERATED_REFERENCES,
    "processed": PROCESSED_REFERENCES,
    "processing": PROCESSING,
    "roles": ROLES,
    "acyclic": [(name, inverse is not None) for name, _, inverse in ACYCLIC],
    "descent": [(name, descent) for name, descent, _ in ACYCLIC if descent],
    "consequential": CONSEQUENTIAL,
}
_NAMES = [x.split()[0] for x in FACTS.split(", ")]


def descents(told: list[tuple], words: Vocabulary) -> list[tuple[str, str, str, str]]:
    """Path, operation, parent and child of a record's relations with a direction of descent, from its facts."""
    ends = {f"{words.relations}:{name}": descent for name, descent, _ in ACYCLIC if descent}
    return [(x[2], x[3], *((x[6], x[5]) if ends[x[4]] == "subject" else (x[5], x[6]))) for x in told if x[0] == "relation" and x[4] in ends]


def descent_facts(told: list[tuple], words: Vocabulary) -> list[tuple]:
    """rule_columns.descent(), from a record's facts."""
    edges = descents(told, words)
    flat = [s for _, _, parent, child in edges for s in (parent, child)] + [s for x in told if x[0] == "entity" for s in (x[3], x[2])]
    return [("descent", len(told), "", *[None] * 5, float(len(edges)), None, flat)] if edges else []


def failing_facts(told: list[tuple], words: Vocabulary) -> list[tuple]:
    """What rule_columns tells of a record, from its facts: kind, path and id of each place that fails."""
    of = lambda kind: [x for x in told if x[0] == kind]
    known = {x[3] for x in [*of("entity"), *of("external")]}
    works = {x[3] for x in of("entity") if x[4] == "representations"}
    out = [("dangling", x[2], x[3]) for x in of("ref") if x[3] not in known]
    out += [("foreign", f"{x[2]}/recordId", None) for x in of("event") if x[7]]
    used: dict[str, set] = {}
    for x in of("inputs"):
        used.setdefault(x[6], set()).add(x[4])
    serious = [x for x in of("outputs") if x[5] in CONSEQUENTIAL]
    out += [("reused", x[2], None) for x in serious if x[4] in used.get(x[6], ())]
    edges = descents(told, words)
    out += [("reused", f"{path}/subject", None) for path, _, parent, child in edges if parent == child and child in works]
    out += [("unreceipted", f"{path}/operationRef", None) for path, operation, _, child in edges if child in works and operation not in known]
    receipts: dict[str, str] = {}
    for x in of("event"):
        receipts.setdefault(x[3], x[2])
    tied = {(operation, child) for _, operation, parent, child in edges if parent in used.get(receipts.get(operation), ())}
    loose = {x[6] for x in serious if x[3] is not None and receipts[x[3]] == x[6] and x[4] in works and (x[3], x[4]) not in tied}
    return out + [("unreceipted", f"{path}/outputs", None) for path in sorted(loose)]


def parsed_facts(records: DataFrame, words: Vocabulary, kinds: Iterable[str] = fact_columns.KINDS) -> DataFrame:
    """The facts of records (record_key, raw) that parse, by the strict parser; those of what fails inside a record if kinds has them."""
    failing, descent = frozenset(kinds) & rule_columns.FAILS, "descent" in kinds
    from tracewell.operators import profiles  # it builds on this module

    types = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 6, pa.float64(), pa.float64(), pa.list_(pa.string())]

    def run(batches):
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    doc = parse(text or "")
                except JsonError:
                    continue
                told = facts_of(doc, words)
                failed = profiles.mismatches(doc, words) if isinstance(doc, dict) else []
                told += descent_facts(told, words) if descent else []
                if failing:
                    told += [(kind, len(told) + k, path, own, *[None] * 7) for k, (kind, path, own) in enumerate(failing_facts(told, words))]
                told += [("profile", len(told) + k, "/profiles", None, p, None, None, None, float(n), None, None) for k, (p, n) in enumerate(failed)]
                out += [(key, *f) for f in told]
            cols = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_NAMES)

    return records.select("record_key", "raw").mapInArrow(run, FACTS)


def column_facts(records: DataFrame, words: Vocabulary, wanted: frozenset[str] = fact_columns.KINDS) -> DataFrame:
    """The facts of the records that are plain, by columns; of any other one fact of the kind 'unread', which holds its text."""
    top = fact_columns.Top([*COLLECTIONS, "profiles"], ["id", "type", "disclosure", "revision", "createdBy", "history", "publication", "measurements", "regions", words.version_member])
    told = F.when(F.col("object"), fact_columns.facts(top, F.col("events"), words, TABLES, wanted)).otherwise(F.array().cast(f"array<struct<{fact_columns.FIELDS}>>"))
    told = F.when(F.col("plain"), told).otherwise(F.array(fact_columns.fact("unread", F.lit(""), a=F.col("raw"))))
    raw, v = F.col("raw"), F.col("value")
    if "profile" in wanted and len(wanted) > 1:  # its rules ask for other types than the rest
        rows = fact_columns.read(records).withColumn("fit", F.lit(False))
    else:
        from tracewell.operators import profile_columns  # its tables build on this module

        taken, fit, short = profile_columns.lean(raw, words) if wanted == {"profile"} else fact_columns.lean(raw, words, TABLES, wanted)
        rows = records.select("record_key", "raw", *[c.alias(name) for name, c in taken.items()]).withColumn("fit", fit)
        rows = rows.withColumn("value", fact_columns.value(F.when(~F.col("fit"), raw)))
        told = F.when(F.col("fit"), short).otherwise(told)
    kept = [c for c in ("lean", "fit") if c in rows.columns]
    rows = rows.select("record_key", *kept, F.when(~F.col("fit"), fact_columns.plain(raw, v)).alias("plain"), fact_columns.is_object(v).alias("object"), "raw", *top.columns(v))
    rows = rows.withColumn("events", fact_columns.embedded(top))
    rows = rows.select("record_key", F.posexplode(told).alias("place", "fact")).select("record_key", "place", "fact.*")
    return rows.select(*_NAMES)


def facts(records: DataFrame, words: Vocabulary, kinds: Iterable[str] = fact_columns.KINDS) -> DataFrame:
    """The facts of records (record_key, raw) that parse, of the kinds that are asked for, written once, in a folder per kind:
    what reads one kind reads no other. Records that columns cannot tell for sure, few in most corpora, are read by the
    strict parser. place orders the facts of a record."""
    kinds = frozenset(kinds)
    told = materialized(column_facts(records, words, kinds), "facts", by=["kind"]).select(*_NAMES)
    unread = told.where("kind = 'unread'").select("record_key", F.col("a").alias("raw"), F.col("b").alias("only"))
    told = told.where("kind <> 'unread'")
    if unread.isEmpty():
        return told
    parsed = parsed_facts(unread.where("only IS NULL"), words, kinds).where(F.col("kind").isin(*kinds))
    for kind in sorted(kinds & rule_columns.FAILS):  # of records that are plain but have many of these
        parsed = parsed.unionByName(parsed_facts(unread.where(F.col("only") == kind).distinct(), words, [kind]).where(F.col("kind") == kind))
    return told.unionByName(materialized(parsed, "facts-parsed", by=["kind"]).select(*_NAMES))


def registry(spark, words: Vocabulary) -> DataFrame:
    """(predicate, descent, reverse): the acyclic relations, which side descends, and whether they are stored backwards."""
    rows = [(f"{words.relations}:{name}", descent, inverse is not None) for name, descent, inverse in ACYCLIC]
    return spark.createDataFrame(rows, "predicate string, descent string, reverse boolean")


def lineage_edges(f: DataFrame, words: Vocabulary) -> DataFrame:
    """(record_key, path, operation, parent, child) of relations with a direction of descent."""
    known = F.broadcast(registry(f.sparkSession, words).where("descent IS NOT NULL"))  # a fixed table
    r = f.where("kind = 'relation'").join(known, F.col("a") == F.col("predicate"))
    first = F.col("descent") == "subject"
    return r.select("record_key", "path", F.col("id").alias("operation"), F.when(first, F.col("c")).otherwise(F.col("b")).alias("parent"), F.when(first, F.col("b")).otherwise(F.col("c")).alias("child"))


def diagnostic(rows: DataFrame, code: str | Column, path: Column, severity: str | Column = "error") -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select("record_key", lit(code).alias("code"), lit(severity).alias("severity"), path.alias("instance_path"))


#: The kinds of facts that each rule reads.
RULES = {
    "DUPLICATE_ID": ["twin"],
    "UNRESOLVED_REF": ["ref", "entity", "external", "event"],
    "REF_TYPE": ["ref", "entity"],
    "EVENT_SEQUENCE": ["event", "times"],
    "POLICY_DENIED": ["event"],
    "DESCENDANT_REUSES_INPUT": ["outputs", "inputs", "relation", "entity"],
    "DESCENDANT_RECEIPT": ["relation", "entity", "external", "outputs", "inputs", "event"],
    "TEMPORAL_ORDER": ["times"],
    "WINDOW_ORDER": ["window"],
    "PUBLIC_DISCLOSURE": ["diagnostic"],
    "STATE_REASON_MISSING": ["diagnostic"],
    "DERIVATION_CYCLE": ["graph"],
}


#: The kinds of facts of what fails, of rules that look at one record alone.
INSIDE = {
    "UNRESOLVED_REF": ["dangling", "foreign"],
    "DESCENDANT_RECEIPT": ["unreceipted"],
    "DESCENDANT_REUSES_INPUT": ["reused"],
}


def semantics(records: DataFrame, words: Vocabulary, codes: Iterable[str] = tuple(RULES)) -> DataFrame:
    """(record_key, code, severity, instance_path) of the semantic findings of records that parse, of the codes that are asked
    for: only the facts that their rules read are made. If not all are asked for, rules that look at one record alone are judged
    where it stands; all of them together join the facts that are made anyway."""
    codes = list(codes)
    inside = [c for c in codes if c in INSIDE] if set(codes) < set(RULES) else []
    f = facts(records, words, {kind for c in codes for kind in (INSIDE if c in inside else RULES)[c]})
    parts = [diagnostic(f.where(F.col("kind").isin(INSIDE[c])), c, F.col("path")) for c in inside]
    if others := [c for c in codes if c not in inside]:
        parts.append(findings(f, words, others))
    return reduce(DataFrame.unionByName, parts).distinct()


def findings(f: DataFrame, words: Vocabulary, codes: Iterable[str] = tuple(RULES)) -> DataFrame:
    """semantics(), from facts."""
    codes = list(codes)
    of = lambda kind: f.where(F.col("kind") == kind)
    path = F.col("path")
    parts = []

    def rule(rows: DataFrame, code: str, at: Column = path) -> None:
        parts.append(diagnostic(rows, code, at))

    entity = of("entity").select("record_key", "id", F.col("a").alias("collection"), "path", "place")
    known = entity.select("record_key", "id").unionByName(of("external").select("record_key", "id")).distinct()
    refs = of("ref").select("record_key", "path", "id", "expected")
    event, edges = of("event"), lineage_edges(f, words)
    works = of("entity").where("a = 'representations'").select("record_key", F.col("id").alias("child")).distinct()
    outputs = of("outputs").select("record_key", "path", F.col("id").alias("operation"), F.col("a").alias("child"), F.col("b").alias("effect"), F.col("c").alias("event_path"))
    inputs = of("inputs").select("record_key", F.col("id").alias("operation"), F.col("a").alias("parent"), F.col("c").alias("event_path"))
    serious = F.col("effect").isin(CONSEQUENTIAL)
    descends = edges.join(works, ["record_key", "child"], "left_semi")
    if "DUPLICATE_ID" in codes:
        rule(of("twin"), "DUPLICATE_ID")
    if "UNRESOLVED_REF" in codes:
        rule(checks.unresolved(refs, known, ["record_key", "id"]), "UNRESOLVED_REF")
        rule(event.where("d IS NOT NULL"), "UNRESOLVED_REF", F.concat(path, F.lit("/recordId")))
    if "REF_TYPE" in codes:
        first = entity.groupBy("record_key", "id").agg(F.min_by("collection", "place").alias("kind"))
        rule(checks.wrong_type(refs.where("expected IS NOT NULL"), first, ["record_key", "id"]), "REF_TYPE")
    if "EVENT_SEQUENCE" in codes:
        before = F.max("n").over(Window.partitionBy("record_key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        rising = event.withColumn("before", F.coalesce(before, F.lit(-1.0))).where(F.col("n").isNull() | (F.col("n") != F.floor("n")) | (F.col("n") <= F.col("before")))
        rule(rising, "EVENT_SEQUENCE", F.concat(path, F.lit("/sequence")))
    for code in ("EVENT_SEQUENCE", "TEMPORAL_ORDER"):
        if code in codes:
            rule(of("times").where(F.col("c") == code).where(F.try_to_timestamp("b") < F.try_to_timestamp("a")), code)
    if "POLICY_DENIED" in codes:
        unauthorised = event.where((F.col("b") == "completed") & F.col("a").isin(CONSEQUENTIAL) & ~F.coalesce(F.col("c").isin("permitted", "required"), F.lit(False)))
        rule(unauthorised, "POLICY_DENIED", F.concat(path, F.lit("/policyEvaluation/result")))
    if "DESCENDANT_REUSES_INPUT" in codes:
        reused = outputs.where(serious).join(inputs.select("record_key", "event_path", F.col("parent").alias("child")).distinct(), ["record_key", "event_path", "child"], "left_semi")
        rule(reused, "DESCENDANT_REUSES_INPUT")
        rule(descends.where("parent = child"), "DESCENDANT_REUSES_INPUT", F.concat(path, F.lit("/subject")))
    if "DESCENDANT_RECEIPT" in codes:
        # of receipts that share an id the first counts
        receipt = event.where("id IS NOT NULL").groupBy("record_key", F.col("id").alias("operation")).agg(F.min_by("path", "place").alias("event_path"))
        own = ["record_key", "operation", "event_path"]
        tied = edges.join(inputs.join(receipt, own, "left_semi").select("record_key", "operation", "parent").distinct(), ["record_key", "operation", "parent"], "left_semi").select("record_key", "operation", "child")
        loose = outputs.where(serious).join(receipt, own, "left_semi").join(works, ["record_key", "child"], "left_semi").join(tied, ["record_key", "operation", "child"], "left_anti")
        rule(descends.join(known.withColumnRenamed("id", "operation"), ["record_key", "operation"], "left_anti"), "DESCENDANT_RECEIPT", F.concat(path, F.lit("/operationRef")))
        rule(loose, "DESCENDANT_RECEIPT", F.concat("event_path", F.lit("/outputs")))
    if "WINDOW_ORDER" in codes:
        rule(of("window").where("m < n"), "WINDOW_ORDER")
    if told := [c for c in codes if RULES[c] == ["diagnostic"]]:
        parts.append(diagnostic(of("diagnostic").where(F.col("a").isin(told)), F.col("a"), path, F.col("b")))
    if "DERIVATION_CYCLE" in codes:
        rule(cycles(of("graph")), "DERIVATION_CYCLE")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def back_edges(edges: list[tuple[str, str, str]]) -> list[str]:
    """Paths of the edges (origin, target, path) that close a cycle, in a depth-first search from the sorted origins that
    follows edges in their order. A cursor per node keeps a long chain off the call stack."""
    after: dict[str, list[tuple[str, str]]] = {}
    for origin, target, path in edges:
        after.setdefault(origin, []).append((target, path))
    found, state = [], {}
    for start in sorted(after, key=lambda x: x.encode("utf-16-be", "surrogatepass")):
        if start in state:
            continue
        state[start], trail = "open", [(start, iter(after[start]))]
        while trail:
            node, rest = trail[-1]
            step = next(rest, None)
            if step is None:
                state[node] = "done"
                trail.pop()
            elif state.get(step[0]) == "open":
                found.append(step[1])
            elif step[0] not in state:
                state[step[0]] = "open"
                trail.append((step[0], iter(after.get(step[0], ()))))
    return found


def cycles(graph: DataFrame) -> DataFrame:
    """(record_key, path) of each relation that closes a cycle of its record. A record's edges stand in one fact, since a
    record is at most 16 MiB; nothing is shuffled."""

    def run(batches):
        for b in batches:
            keys, paths = [], []
            for key, flat in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = back_edges(list(zip(flat[::3], flat[1::3], flat[2::3], strict=True)))
                keys += [key] * len(found)
                paths += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(paths, pa.string())], names=["record_key", "path"])

    return graph.select("record_key", "expected").mapInArrow(run, "record_key string, path string")


def summary(f: DataFrame) -> DataFrame:
    """A row per record: id, version, revision, profiles, disclosure, how many items each collection lists, with or without
    ids, and how many ids repeat an earlier one. A record's one fact of the kind 'record' holds all of it; one grouping by record."""
    names = [*COLLECTIONS, "events"]
    listed = f.where("kind = 'record'").select("record_key", "id", "a", "b", "n", "m", "expected", F.split("c", ",").alias("sizes"))
    rows = listed.select("record_key", "id", "a", "b", "n", "m", "expected", *[F.get("sizes", F.lit(k)).cast("long").alias(x) for k, x in enumerate(names)])
    return rows.groupBy("record_key").agg(
        F.coalesce(F.max("id"), F.lit("")).alias("id"), F.coalesce(F.max("a"), F.lit("")).alias("version"), F.coalesce(F.max("n"), F.lit(0.0)).alias("revision"),
        F.max("expected").alias("profiles"), F.coalesce(F.max("b"), F.lit("")).alias("disclosure"), *[F.max(x).alias(x) for x in names], F.max("m").cast("long").alias("duplicate_ids"),
    )
