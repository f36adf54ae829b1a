"""Settings of a benchmark run, checked as a whole before any job starts."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
from dataclasses import dataclass, field


class ContractError(ValueError):
    """Raised by every check of settings and tables."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ContractError(message)


def text_value(x: object, name: str) -> str:
    require(isinstance(x, str) and bool(x.strip()), f"{name} must be a non-blank string")
    return x


def whole_value(x: object, name: str, least: int | None = None) -> int:
    require(isinstance(x, int) and not isinstance(x, bool), f"{name} must be an integer")
    require(least is None or x >= least, f"{name} must be at least {least}")
    return x


def number_value(x: object, name: str) -> float:
    require(isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x), f"{name} must be a finite number")
    return float(x)


def unique_strings(xs: object, name: str, least: int = 1) -> list[str]:
    require(isinstance(xs, list) and len(xs) >= least, f"{name} must be a list of at least {least}")
    out = [text_value(x, f"{name}[{i}]") for i, x in enumerate(xs)]
    require(len(set(out)) == len(out), f"{name} has duplicates")
    return out


#: Reasons of a judgment and the relevance each stands for.
RELEVANCE = {
    "direct_match": True,
    "subtype": True,
    "generic": False,
    "unrelated": False,
    "insufficient_evidence": False,
}
#: Fields that may support a positive judgment.
EVIDENCE_FIELDS = ("title", "description", "header", "content")


@dataclass(frozen=True)
class Settings:
    judges: tuple[str, ...] = ()
    profiles: tuple[str, ...] = ()
    relevance: dict[str, bool] = field(default_factory=lambda: dict(RELEVANCE))
    evidence_fields: tuple[str, ...] = EVIDENCE_FIELDS
    panel_size: int = 3
    pool_depth: int = 50
    default_judge: str | None = None
    sample_size: int = 300
    sample_seed: int = 1
    annotators: int = 3
    bootstrap_iterations: int = 10_000
    bootstrap_seed: int = 0
    confidence: float = 0.95
    content_limit: int = 500
    attempts: int = 6

    def __post_init__(self) -> None:
        unique_strings(list(self.judges), "judges", 0)
        unique_strings(list(self.profiles), "profiles", 0)
        for name, least in (("panel_size", 1), ("pool_depth", 1), ("sample_size", 1), ("annotators", 1), ("bootstrap_iterations", 1), ("content_limit", 0), ("attempts", 1)):
            whole_value(getattr(self, name), name, least)
        require(self.panel_size == 3, "panels have three judges")
        require(0 < number_value(self.confidence, "confidence") < 1, "confidence must be between 0 and 1")
        require(bool(self.relevance) and all(isinstance(v, bool) for v in self.relevance.values()), "relevance must map reasons to booleans")
        require(self.default_judge is None or self.default_judge in self.judges, "default_judge must be one of judges")

    @staticmethod
    def from_json(text: str) -> Settings:
        raw = json.loads(text)
        require(isinstance(raw, dict), "settings must be a JSON object")
        known = Settings.__dataclass_fields__
        extra = sorted(set(raw) - set(known))
        require(not extra, f"unknown settings: {extra}")
        return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def _whole(least: int | None = None):
    return lambda x, name: whole_value(x, name, least)


def _flag(*allowed: bool):
    def check(x: object, name: str) -> None:
        require(isinstance(x, bool) and (not allowed or x in allowed), f"{name} must be {' or '.join(str(a).lower() for a in allowed or (True, False))}")

    return check


def _one_of(*allowed: object):
    def check(x: object, name: str) -> None:
        x = x.strip() if isinstance(x, str) else x
        close = isinstance(x, float) and any(isinstance(a, float) and math.isclose(x, a) for a in allowed)
        require(close or (not isinstance(x, bool) and x in allowed), f"{name} must be one of {list(allowed)}")

    return check


#: The parts of a benchmark configuration, by section, and what each must be.
BENCHMARK_FORMAT = {
    "benchmark.default_relevance_source": text_value,
    "collection.filtering.require_title": _flag(),
    "collection.filtering.require_description": _flag(),
    "collection.filtering.minimum_data_rows": _whole(1),
    "collection.resource_selection.resources_per_dataset": _whole(1),
    "collection.content_sampling.maximum_rows": _whole(1),
    "collection.content_sampling.random_seed": _whole(),
    "collection.content_sampling.file_order": _one_of("filesystem", "sorted"),
    "candidate_pool.pooling_depth": _whole(1),
    "llm_annotation.content_character_limit": _whole(0),
    "llm_annotation.maximum_attempts": _whole(1),
    "llm_annotation.few_shots": _flag(),
    "llm_annotation.few_shot_examples": _whole(0),
    "llm_annotation.prompt_blueprint": text_value,
    "llm_annotation.models": unique_strings,
    "llm_annotation.input_components": unique_strings,
    "llm_annotation.reason_labels": unique_strings,
    "llm_annotation.positive_evidence_fields": unique_strings,
    "llm_annotation.invalid_output_policy": _one_of("missing"),
    "human_audit.sample_size": _whole(1),
    "human_audit.sample_seed": _whole(),
    "human_audit.annotators": _whole(1),
    "human_audit.sampling": _one_of("simple_random_without_replacement"),
    "human_audit.human_majority.binary_rule": _one_of("2_out_of_3"),
    "judge_aggregation.judge_combination_size": _one_of(3),
    "judge_aggregation.number_of_combinations": _whole(1),
    "judge_aggregation.aggregation_rule": _one_of("2_out_of_3_majority_vote"),
    "judge_aggregation.require_all_three_valid_judgments": _flag(True),
    "judge_aggregation.missing_judgment_policy": _one_of("missing"),
    "evaluation.bootstrap.confidence_level": _one_of(0.95),
    "evaluation.bootstrap.method": _one_of("percentile"),
    "evaluation.bootstrap.iterations": _whole(1),
    "evaluation.bootstrap.seed": _whole(),
    "evaluation.bootstrap.resampling_unit": _one_of("query_dataset_pair"),
    "evaluation.bootstrap.paired": _flag(True),
}


def part_of(raw: object, path: str) -> object:
    """The value at a dotted path; whatever is on the way must be an object."""
    at = []
    for key in path.split("."):
        require(isinstance(raw, dict), f"{'.'.join(at) or 'the configuration'} must be an object")
        at.append(key)
        raw = raw.get(key)
    return raw


def benchmark_settings(raw: dict) -> Settings:
    """Settings of a benchmark configuration, each part checked by itself, then parts against each other."""
    got = {path: part_of(raw, path) for path in BENCHMARK_FORMAT}
    for path, check in BENCHMARK_FORMAT.items():
        check(got[path], path)
    llm = lambda name: got[f"llm_annotation.{name}"]
    require(not llm("few_shots") or llm("few_shot_examples") > 0, "few_shot_examples must be above 0 where few_shots is true")
    inputs, reasons, evidence = llm("input_components"), llm("reason_labels"), llm("positive_evidence_fields")
    require("query" in inputs, "input_components must contain query")
    meaning = part_of(raw, "llm_annotation.relevance_mapping")
    require(isinstance(meaning, dict) and set(meaning) == set(reasons) and all(isinstance(v, bool) for v in meaning.values()), f"relevance_mapping must map exactly {reasons} to booleans")
    require("query" not in evidence and set(evidence) <= set(inputs), "positive_evidence_fields must be input components other than query")
    cleared = part_of(raw, "llm_annotation.negative_evidence_normalization")
    require(cleared == {"supporting_field": None, "quote": None}, "negative_evidence_normalization must set supporting_field and quote to null")
    judges = llm("models")
    require(got["judge_aggregation.number_of_combinations"] == math.comb(len(judges), 3), "number_of_combinations must be that of three of the models")
    require(got["benchmark.default_relevance_source"] in judges, "default_relevance_source must be one of the models")
    profiles = part_of(raw, "candidate_pool.profiles") or {}
    require(isinstance(profiles, dict), "candidate_pool.profiles must be an object")
    return Settings(
        judges=tuple(judges), profiles=tuple(profiles), relevance=dict(meaning), evidence_fields=tuple(evidence), pool_depth=got["candidate_pool.pooling_depth"],
        default_judge=got["benchmark.default_relevance_source"], sample_size=got["human_audit.sample_size"], sample_seed=got["human_audit.sample_seed"], annotators=got["human_audit.annotators"],
        bootstrap_iterations=got["evaluation.bootstrap.iterations"], bootstrap_seed=got["evaluation.bootstrap.seed"], confidence=float(got["evaluation.bootstrap.confidence_level"]), content_limit=llm("content_character_limit"), attempts=llm("maximum_attempts"),
    )


#: Keys that a registry entry of each backend may have.
BACKEND_KEYS = {"ollama": {"model", "platform", "generation"}, "openai": {"model", "platform", "generation", "api"}, "vertex": {"model", "platform", "generation", "project", "location"}}


def backend_of(platform: str) -> str:
    """ollama before openai before vertex, by what the platform text mentions."""
    low = text_value(platform, "platform").lower()
    for name, words in (("ollama", ("ollama",)), ("openai", ("openai",)), ("vertex", ("vertex", "gemini", "google"))):
        if any(w in low for w in words):
            return name
    raise ContractError(f"unknown platform {platform!r}")


def checked_registry(models: dict) -> dict[str, str]:
    """model id -> backend, each entry with known keys only."""
    require(isinstance(models, dict) and bool(models), "the model registry must be a non-empty object")
    out = {}
    for name, entry in models.items():
        require(isinstance(entry, dict), f"{name} must be an object")
        out[name.strip()] = backend = backend_of(entry.get("platform"))
        extra = sorted(set(entry) - BACKEND_KEYS[backend])
        require(not extra, f"{name} has unknown keys {extra}")
    return out


def parse_named(text: str) -> list[tuple[str, str]]:
    """a=x,b=y as ordered pairs with unique names."""
    out = []
    for part in (p for p in text.split(",") if p.strip()):
        name, sign, value = part.partition("=")
        require(bool(sign and name.strip() and value.strip()), f"expected NAME=VALUE, not {part!r}")
        out.append((name.strip(), value.strip()))
    require(bool(out) and len({n for n, _ in out}) == len(out), "names must be unique and at least one")
    return out


def provenance(settings: Settings, inputs: dict[str, str], models: dict | None = None) -> dict:
    """What a run's results depend on: all settings, the MD5 of each input's text, and the model registry."""
    require(bool(inputs) and all(isinstance(v, str) for v in inputs.values()), "inputs must map names to texts")
    plain = json.loads(json.dumps(dataclasses.asdict(settings), sort_keys=True))
    return {"settings": plain, "inputs": {k: hashlib.md5(v.encode()).hexdigest() for k, v in sorted(inputs.items())}, "models": checked_registry(models) if models else {}}


def resumable(stored: dict | None, now: dict, ignored: tuple[str, ...] = ("attempts",)) -> None:
    """Raises where a run's stored provenance is of other settings, inputs or models than the one that would go on."""
    require(stored is not None, "results without provenance can't be resumed")
    for part in ("settings", "inputs", "models"):
        require(same_run(stored.get(part, {}), now[part], ignored), f"{part} differ from those of the results: {[k for k in now[part] if stored.get(part, {}).get(k) != now[part][k]]}")


def same_run(old: dict, new: dict, ignored: tuple[str, ...] = ("max_attempts",)) -> bool:
    """Whether results of two runs can be mixed: equal but for the ignored keys, at any depth."""

    def bare(x: object) -> object:
        return {k: bare(v) for k, v in x.items() if k not in ignored} if isinstance(x, dict) else x

    return bare(old) == bare(new)
