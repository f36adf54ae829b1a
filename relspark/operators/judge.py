"""Structured relevance judgments: prompts, answers to judgments, retries, and resuming an interrupted run."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EVIDENCE_FIELDS, RELEVANCE, ContractError, checked_registry
from ..functions.text import cleaned_output
from .contracts import none_of
from .votes import relevance_of

KEYS = ["main_resource", "scope", "supporting_field", "quote", "reason"]
ANSWER = "struct<main_resource:string,scope:string,supporting_field:string,quote:string,reason:string,error:string,detail:string,raw_output:string,relevance:boolean>"

#: Prompt texts by name: instructions, one line of form, and what an example looks like.
BLUEPRINTS = {
    "tabular": {
        "instructions": "Decide whether the dataset satisfies the need behind the query. Judge only from the fields that are given.",
        "answer": 'Answer with one JSON object with the keys "main_resource", "scope", "supporting_field", "quote" and "reason".',
        "example": "Query: {query}\nTitle: {title}\nAnswer: {answer}",
    },
}


#: A second set of texts, for judges with little context.
BLUEPRINTS["short"] = {
    "instructions": "Does the dataset answer the query?",
    "answer": BLUEPRINTS["tabular"]["answer"],
    "example": "{query} / {title}: {answer}",
}


def blueprint_part(blueprint: str, part: str) -> str:
    """The instructions, answer form or example form of a blueprint."""
    if blueprint not in BLUEPRINTS or part not in BLUEPRINTS[blueprint]:
        raise ContractError(f"there is no {part} of a blueprint {blueprint}")
    return BLUEPRINTS[blueprint][part]


def few_shots(blueprint: str, examples: Sequence[Mapping[str, str]], shots: int) -> list[str]:
    """The texts of the first `shots` examples; fewer than that raise."""
    if shots > len(examples):
        raise ContractError(f"{shots} examples are asked for, {len(examples)} are there")
    return [blueprint_part(blueprint, "example").format(**e) for e in examples[:shots]]


class PerProcess:
    """A function whose costly part, made by `factory`, is built once in each worker process, at its first call."""

    _built: dict[str, Callable] = {}

    def __init__(self, name: str, factory: Callable[[], Callable]):
        self.name, self.factory = name, factory

    def __call__(self, *args):
        if self.name not in PerProcess._built:
            PerProcess._built[self.name] = self.factory()
        return PerProcess._built[self.name](*args)


def dispatched(models: dict, connectors: Mapping[str, Callable[[str, dict], Callable[[Sequence[str]], Sequence[str]]]]) -> dict[str, Callable[[Sequence[str]], Sequence[str]]]:
    """A judge for each model of a checked registry, by the connector of its platform, connected once a process.

    A connector takes the model's name and settings and returns a function from prompts to answers.
    """
    out = {}
    for model, backend in checked_registry(models).items():
        if backend not in connectors:
            raise ContractError(f"{model} needs a connector to {backend}")
        out[model] = PerProcess(f"judge {model}", functools.partial(connectors[backend], model, models[model]))
    return out


def input_fields(components: Sequence[str]) -> list[str]:
    """What a judge sees of a dataset: all components but the query."""
    return [c for c in components if c != "query"]


def response_schema(relevance: Mapping[str, bool] = RELEVANCE, evidence: Sequence[str] = EVIDENCE_FIELDS) -> dict:
    """The JSON schema that strict backends are given."""
    text = {"type": ["string", "null"]}
    props = {"main_resource": text, "scope": text, "supporting_field": {"type": ["string", "null"], "enum": [*evidence, None]}, "quote": text, "reason": {"type": "string", "enum": list(relevance)}}
    return {"type": "object", "properties": props, "required": list(props), "additionalProperties": False}


def prompts(pairs: DataFrame, blueprint: str = "tabular", fields: Sequence[str] = ("title", "description", "header", "content"), limits: Mapping[str, int] | None = None, examples: Sequence[Mapping[str, str]] = (), shots: int = 0) -> DataFrame:
    """pairs with a prompt: instructions, the first `shots` examples, the query and the fields cut to their limits."""
    b, limits = BLUEPRINTS[blueprint], {"content": 500} if limits is None else limits
    head = "\n\n".join([b["instructions"], *few_shots(blueprint, examples, shots)])
    parts = [F.concat(F.lit("Query: "), F.col("query"))]
    for f in fields:
        value = F.coalesce(F.col(f), F.lit(""))
        parts.append(F.concat(F.lit(f"{f.capitalize()}: "), F.substring(value, 1, limits[f]) if f in limits else value))
    return pairs.withColumn("prompt", F.concat_ws("\n", F.lit(head), *parts, F.lit(b["answer"])))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body reads it."""
    return F.transform(F.array(value), body)[0]


def parsed(raw: Column, relevance: Mapping[str, bool] = RELEVANCE, evidence: Sequence[str] = EVIDENCE_FIELDS) -> Column:
    """A judgment of a model's raw answer, as ANSWER: its values and derived relevance, or error with detail and raw_output.

    Negative judgments lose their evidence; a positive one needs a field among `evidence` and a quote that isn't blank.
    The answer is cleaned, parsed and its values read once each.
    """
    read = lambda x: F.struct(
        x["text"].alias("text"),
        x["value"].isNull().alias("broken"),
        F.coalesce(F.schema_of_variant(x["value"]).startswith("OBJECT"), F.lit(False)).alias("is_object"),
        F.coalesce(F.json_object_keys(x["text"]), F.array().cast("array<string>")).alias("names"),
        *[F.try_variant_get(x["value"], f"$.{k}", "string").alias(k) for k in KEYS],
    )
    value = lambda text: F.struct(text.alias("text"), F.try_parse_json(text).alias("value"))
    return let(let(let(cleaned_output(raw), value), read), lambda x: _judgment(x, relevance, evidence))


def _judgment(x: Column, relevance: Mapping[str, bool], evidence: Sequence[str]) -> Column:
    """The judgment of what parsed() has read of an answer."""
    text, is_object, names, get = x["text"], x["is_object"], x["names"], {k: x[k] for k in KEYS}
    reason = F.trim(get["reason"])
    rel = relevance_of(reason, None, relevance)
    missing = F.filter(F.array(*[F.lit(k) for k in sorted(KEYS) if k in ("reason", "supporting_field", "quote", "main_resource")]), lambda k: ~F.array_contains(names, k))
    missing = F.when(F.coalesce(rel, F.lit(True)), missing).otherwise(F.filter(missing, lambda k: ~k.isin("supporting_field", "quote")))
    detail = (
        F.when(~is_object, "not a JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ", ")))
        .when(rel.isNull(), F.concat(F.lit("unknown reason: "), F.coalesce(reason, F.lit("null"))))
        .when(rel & ~F.coalesce(get["supporting_field"].isin(*evidence), F.lit(False)), F.lit("supporting_field is no evidence field"))
        .when(rel & (F.trim(F.coalesce(get["quote"], F.lit(""))) == ""), F.lit("quote is missing"))
    )
    error = F.when(x["broken"], "invalid_json").when(detail.isNotNull(), "invalid_schema")
    fine = error.isNull()
    shown = lambda k: F.when(fine & (rel | F.lit(k not in ("supporting_field", "quote"))), reason if k == "reason" else get[k])
    return F.struct(*[shown(k).alias(k) for k in KEYS], error.alias("error"), F.when(~x["broken"], detail).alias("detail"), F.when(error.isNotNull(), text).alias("raw_output"), F.when(fine, rel).alias("relevance"))


def judged(pairs: DataFrame, judges: Mapping[str, Callable[[Sequence[str]], Sequence[str]]], attempts: int = 6, accept: Callable[[str], bool] | None = None) -> DataFrame:
    """(keys..., model, attempts, raw) of every judge on every prompt of pairs (id_query, id_dataset, prompt).

    A judge is a function from prompts to raw answers, built in each Python worker and called on Arrow batches;
    answers that `accept` refuses are asked for again, up to `attempts` times, and the last one stays.
    """
    import json

    def sound(raw: str) -> bool:
        try:
            return isinstance(json.loads(raw[raw.index("{") : raw.rindex("}") + 1]), dict)
        except ValueError:
            return False

    ok = accept or sound

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for model, ask in judges.items():
                raw, tries, open_ = [""] * len(b), [0] * len(b), list(range(len(b)))
                for _ in range(attempts):
                    if not open_:
                        break
                    for i, answer in zip(open_, ask([b["prompt"].iloc[i] for i in open_]), strict=True):
                        raw[i], tries[i] = answer, tries[i] + 1
                    open_ = [i for i in open_ if not ok(raw[i])]
                yield b[["id_query", "id_dataset"]].assign(model=model, attempts=tries, raw=raw)

    key = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("id_query", "id_dataset"))
    return pairs.select("id_query", "id_dataset", "prompt").mapInPandas(run, f"{key}, model string, attempts int, raw string")


def pending(pairs: DataFrame, models: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs x models (few) that have no valid judgment in done (id_query, id_dataset, model, error) yet."""
    if models.count() > 1_000:
        raise ContractError("at most 1000 models are broadcast")
    valid = done.filter("error is null").select("id_query", "id_dataset", "model")
    return pairs.select("id_query", "id_dataset").crossJoin(F.broadcast(models.select("model"))).join(valid, ["id_query", "id_dataset", "model"], "left_anti")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """One judgment for each pair and model: a valid one before an invalid one, a new one before an old one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.struct(F.col("error").isNull().alias("valid"), F.col("_new").alias("new"))
    names = [c for c in old.columns if c not in ("id_query", "id_dataset", "model")]
    out = both.groupBy("id_query", "id_dataset", "model").agg(F.max_by(F.struct(*names), rank).alias("x"))
    return out.select("id_query", "id_dataset", "model", "x.*")


def unchanged_evidence(stored: DataFrame, pool: DataFrame, fields: Sequence[str]) -> None:
    """Raises if a judged pair is gone from the pool or its fields have changed."""
    keys = ["id_query", "id_dataset"]
    x = stored.select(*keys, F.struct(*fields).alias("old")).join(pool.select(*keys, F.struct(*fields).alias("now"), F.lit(True).alias("there")), keys, "left")
    none_of(x.filter("there is null or not (old <=> now)").select(*keys), "evidence has changed under judgments")


def has_valid(done: DataFrame, model: str) -> bool:
    """Whether any judgment of a model can be used again."""
    return not done.filter((F.col("model") == model) & F.col("error").isNull()).isEmpty()


def stored_contract(annotations: DataFrame) -> DataFrame:
    """annotations with ok: an error, or else a relevance that follows from the reason."""
    fine = F.col("relevance").isNotNull() & (F.col("relevance") == relevance_of(F.col("reason")))
    return annotations.withColumn("ok", F.col("error").isNotNull() | F.coalesce(fine, F.lit(False)))


def by_judge(annotations: DataFrame, sample: DataFrame, judges: Sequence[str]) -> DataFrame:
    """Per pair of the sample (pair_key): each judge's relevance and reason in columns of their own, by one aggregate."""
    own = annotations.join(sample.select("pair_key").distinct(), "pair_key", "left_semi")
    pick = lambda j, c: F.max(F.when(F.col("judge") == j, F.col(c))).alias(f"{j}_{c}")
    return own.groupBy("pair_key").agg(*[pick(j, c) for j in judges for c in ("relevance", "reason")])


def consistent(annotations: DataFrame, relevance: Mapping[str, bool] = RELEVANCE) -> DataFrame:
    """annotations with relevance from their reasons; raises where a stored relevance contradicts it."""
    derived = relevance_of(F.col("reason"), F.col("error"), relevance)
    none_of(annotations.filter(F.coalesce(F.col("relevance") != derived, F.lit(False))), "stored relevance contradicts the reason")
    return annotations.withColumn("relevance", derived)
