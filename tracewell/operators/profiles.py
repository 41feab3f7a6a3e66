"""What a record must hold for each profile it declares: the rules over a parsed record. profile_columns says the same in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.records import PROCESSING, Vocabulary, strings
from tracewell.operators.schema import Catalog

#: Local names of operations, and of the relations that tie their results to what they came from.
TRANSFORMING = ["segment", "isolate", "transform", "sculpt", "recompose", "render", "compensate"]
GENERATING = ["generate", "mutate", "graft", "continue", "inpaint"]
TRANSFORMED = ["derived-from", "derivation-of", "segmented-from", "isolated-from", "variation-of", "rendered-as", "parent-of", "child-of"]
PROCESSED = ["granulated-from", "derived-from", "derivation-of", "segmented-from", "isolated-from", "variation-of", "parent-of", "child-of"]
GENERATION_PARAMETERS = [
    "generationMethod", "parentRefs", "conditioningRefs", "regionRefs", "prompt", "negativePrompt", "model", "adapter", "provider",
    "providerPolicyState", "selection", "rejectedOutputRefs",
]
OBSERVED_AXES = ["epistemicStatus", "temporalCharacter", "signalKind"]
#: What a receipt of a publication is.
PUBLISHED = {"effectClass": "publish", "finalStatus": "completed", "reversibility": "irreversible"}

_ABOVE, _NOT_BELOW, _COUNT = {"type": "number", "exclusiveMinimum": 0}, {"type": "number", "minimum": 0}, {"type": "integer", "minimum": 1}
_SHARE = {"type": "number", "minimum": 0, "maximum": 1}
_REGIONS = {"type": "array", "items": {"type": "string", "format": "uri", "minLength": 5, "maxLength": 2048}, "uniqueItems": True}


def _one_of(*names: str) -> dict:
    return {"type": "string", "enum": list(names)}


def _object(required: str, closed: bool = True, **members) -> dict:
    return {"type": "object", "required": required.split(), "properties": members} | ({"additionalProperties": False} if closed else {})


def _needs(domain: str, member: str, **more) -> dict:
    return {"if": {"required": ["domain"], "properties": {"domain": {"const": domain}}}, "then": {"required": [member]} | more}


#: The parameters of each processing operation, as schemas.
PARAMETERS = {
    "granulate": _object(
        "grain emission selection output", closed=False,
        grain=_object("durationMs envelope", durationMs=_object("min max", min=_ABOVE, max=_ABOVE), envelope=_one_of("gaussian", "expodec", "rexpodec", "triangular", "trapezoidal", "custom"), pitchScatterCents=_NOT_BELOW, amplitudeScatter=_SHARE, panScatter=_SHARE),
        emission=_object("mode grainsPerSecond", mode=_one_of("synchronous", "quasi-synchronous", "asynchronous", "custom"), grainsPerSecond=_ABOVE, totalGrains=_COUNT),
        selection=_object("order", order=_one_of("linear", "random", "statistical", "authored", "custom"), regionRefs=_REGIONS),
        output=_object("kind", kind=_one_of("texture", "fragment-set")),
    ),
    "extract": _object(
        "domain", closed=False,
        domain=_one_of("spectral-band", "spectral-strata", "partials", "temporal-region", "custom"), bandHz=_object("lowHz highHz", lowHz=_NOT_BELOW, highHz=_ABOVE),
        strata=_object("count", count=_COUNT, method={"type": "string", "minLength": 1, "maxLength": 512}), partials=_object("count criterion", count=_COUNT, criterion=_one_of("loudest", "lowest", "harmonic-template", "custom")),
        regionRefs=_REGIONS, residual={"type": "boolean"},
    ) | {"allOf": [_needs("spectral-band", "bandHz"), _needs("spectral-strata", "strata"), _needs("partials", "partials"), _needs("temporal-region", "regionRefs", properties={"regionRefs": {"minItems": 1}})]},
    "reduce": _object("kind", closed=False, kind=_one_of("spectral-peaks", "envelope", "decimation", "mixdown", "denoise", "custom"), factor=_ABOVE, keepPartials=_COUNT, note={"type": "string", "minLength": 1, "maxLength": 2048}),
    "fragment": _object("strategy", closed=False, strategy=_one_of("regions", "transients", "equal-duration", "grains", "custom"), regionRefs=_REGIONS, count={"type": "integer", "minimum": 2}, fragmentDurationMs=_ABOVE),
    "timestretch": _object("factor", closed=False, factor=_ABOVE, transientMode=_one_of("preserve", "smear", "custom"), formantPreserved={"type": "boolean"}),
    "pitchshift": _object("cents", closed=False, cents={"type": "number", "minimum": -14400, "maximum": 14400}, formantPreserved={"type": "boolean"}),
}
_SHAPES = Catalog(PARAMETERS)


def items(record: dict, name: str) -> list:
    v = record.get(name)
    return [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []


def _count(name: str, least: int = 1):
    return lambda r, w: isinstance(r.get(name), list) and len(r[name]) >= least


def _history(r: dict) -> tuple[str | None, list]:
    h = r.get("history") if isinstance(r.get("history"), dict) else {}
    listed = h.get("events" if h.get("mode") == "embedded" else "eventIds")
    return h.get("mode"), listed if isinstance(listed, list) else []


def _operation(kinds: list[str], effects: list[str], fits=lambda e, kind: True):
    """An embedded receipt of one of the kinds and effects that fits, or an external history."""

    def found(r: dict, w: Vocabulary) -> list[dict]:
        out = []
        for e in _history(r)[1]:
            kind = str(e.get("operationType") if isinstance(e, dict) else "").removeprefix(f"{w.operations}.")
            if isinstance(e, dict) and kind in kinds and e.get("operationType") != kind and e.get("effectClass") in effects and fits(e, kind):
                out.append(e)
        return out

    return found


def _generated(e: dict, kind: str) -> bool:
    p = e.get("parameters")
    if not isinstance(p, dict) or any(k not in p for k in GENERATION_PARAMETERS):
        return False
    many = {"graft": ("parentRefs", 2), "inpaint": ("regionRefs", 1)}.get(kind)
    listed = p[many[0]] if many and isinstance(p[many[0]], list) else []
    return not (many and len(listed) < many[1]) and not (e.get("finalStatus") == "completed" and not e.get("outputs"))


def _tied(found, relations: list[str], also=lambda e: True):
    """If a fitting operation completed: two representations and a relation that names its operation."""

    def ok(r: dict, w: Vocabulary) -> bool:
        done = [e for e in found(r, w) if e.get("finalStatus") == "completed" and e.get("outputs") and also(e)]
        names = {f"{w.relations}:{x}" for x in relations}
        return not done or len(items(r, "representations")) >= 2 and any(x.get("predicate") in names and "operationRef" in x for x in items(r, "relations"))

    return ok


def _has(found):
    return lambda r, w: bool(_history(r)[1]) if _history(r)[0] == "external" else bool(found(r, w))


_TRANSFORM = _operation(TRANSFORMING, ["derive", "transform", "render"])
_GENERATE = _operation(GENERATING, ["generate"], _generated)


def _processed(e: dict, kind: str) -> bool:
    shaped = "parameters" not in e or not _SHAPES.errors(kind, e["parameters"])
    return shaped and not (e.get("finalStatus") == "completed" and not e.get("outputs"))


_PROCESS = _operation(PROCESSING, ["derive", "transform"], _processed)


def _published(r: dict, w: Vocabulary) -> bool:
    p = r.get("publication")
    allowed = isinstance(p, dict) and isinstance(p.get("policyEvaluation"), dict) and p["policyEvaluation"].get("result") == "permitted"
    wanted = PUBLISHED | {"operationType": f"{w.operations}.publish"}

    def receipt(e) -> bool:
        evaluation = e.get("policyEvaluation") if isinstance(e, dict) else None
        return isinstance(evaluation, dict) and evaluation.get("result") == "permitted" and all(e.get(k) == v for k, v in wanted.items())

    mode, listed = _history(r)
    return r.get("disclosure") == "public" and allowed and (bool(listed) if mode == "external" else any(map(receipt, listed)))


#: Per profile, what must hold; the first that fails is reported with its place in the list.
PROFILES = {
    "core": [],
    "audio": [lambda r, w: any(str(x.get("mediaType", "")).startswith("audio/") and isinstance(x.get("audio"), dict) for x in items(r, "representations"))],
    "listening": [_count("encounters"), _count("apertures"), _count("listeningPasses")],
    "analysis": [lambda r, w: bool(r.get("measurements") or r.get("regions"))],
    "transformation": [_has(_TRANSFORM), _tied(_TRANSFORM, TRANSFORMED, lambda e: isinstance(e.get("parameters"), dict) and "preservationIntent" in e["parameters"])],
    "generation": [_has(_GENERATE)],
    "processing": [_has(_PROCESS), _tied(_PROCESS, PROCESSED)],
    "observation": [_count("sources"), _count("observations"), lambda r, w: all(k in x for x in items(r, "observations") for k in OBSERVED_AXES)],
    "mapping": [_count("observations"), _count("mappings")],
    "agent": [lambda r, w: any(x.get("actorKind") == "agent" for x in items(r, "actors")), _count("agentRuns"), _count("capabilities")],
    "publication": [_published],
}


def mismatches(record: dict, words: Vocabulary) -> list[tuple[str, int]]:
    """(profile, rule) of what fails; an unknown profile, or core undeclared, fails with rule -1."""
    declared = strings(record.get("profiles"))
    out = [(p, -1) for p in declared if p not in PROFILES] + ([] if "core" in declared else [("core", -1)])
    return out + [(p, k) for p in dict.fromkeys(declared) for k, ok in enumerate(PROFILES.get(p, [])) if not ok(record, words)]


def check(f: DataFrame) -> DataFrame:
    """(record_key, code, profile, rule) of what fails, from the facts of records (kind 'profile'): no text is read for it."""
    failed = f.where("kind = 'profile'")
    return failed.select("record_key", F.lit("PROFILE_MISMATCH").alias("code"), F.col("a").alias("profile"), F.col("n").cast("int").alias("rule"))


def failed_rules(f: DataFrame) -> DataFrame:
    """(record_key, profile, rules): the failed rules of each declared profile as bits, folded over the record's facts; an
    unknown profile, or core undeclared, has the bits of -1."""
    bit = F.when(F.col("rule") < 0, F.lit(-1)).otherwise(F.expr("shiftleft(1, greatest(rule, 0))")).cast("long")
    return check(f).groupBy("record_key", "profile").agg(F.bit_or(bit).alias("rules"))
