"""Configuration: presets, validation at start, and environment references.

Unknown keys are errors. Messages name keys and types, never values.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from veilspan.operators.anonymize import Method, Policy
from veilspan.operators.detect import COMMON, custom_rule
from veilspan.operators.languages import LANGUAGE_RULES, LANGUAGES
from veilspan.operators.merge import RESOLUTIONS
from veilspan.operators.policy import AllowRule
from veilspan.operators.secrets import SECRET_RULES

#: Detectors by preset: the rule set and the pluggable models it expects.
PRESETS: dict[str, tuple[str, ...]] = {
    "light": ("rules",),
    "standard": ("rules", "bert_ner"),
    "full": ("rules", "bert_ner", "mlmodel"),
    "onnx": ("rules", "onnx"),
    "max": ("rules", "onnx", "gliner"),
    "minilm": ("rules", "minilm"),
    "ultrafast": ("rules", "minilm"),
}


@dataclass(frozen=True)
class Config:
    preset: str = "onnx"
    languages: tuple[str, ...] = ("fr", "en")
    strategy: str = "union"
    resolution: str = "highest_score"
    method: str = "placeholder"
    overrides: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    block_types: tuple[str, ...] = ()
    allow: tuple[Mapping, ...] = ()
    custom: Mapping[str, str] = field(default_factory=dict)
    disabled_rules: tuple[str, ...] = ()
    on_error: str = "block"
    fuzzy_threshold: float | None = None

    def __post_init__(self) -> None:
        if self.preset not in PRESETS:
            raise ValueError(f"unknown preset; valid presets: {', '.join(PRESETS)}")
        if not self.languages or set(self.languages) - set(LANGUAGES):
            raise ValueError("languages must be among " + " ".join(LANGUAGES))
        if self.strategy not in ("union", "intersection") or self.resolution not in RESOLUTIONS:
            raise ValueError("unknown merge strategy or resolution")
        if self.strategy == "intersection" and len(self.detectors) < 2:
            raise ValueError("intersection needs two detectors")
        if self.on_error not in ("block", "allow"):
            raise ValueError("on_error is block or allow")
        if missing := set(self.block_types) - self.emitted_types():
            raise ValueError(f"no detector emits the blocked types {sorted(missing)}")
        self.allow_rules()

    @property
    def detectors(self) -> tuple[str, ...]:
        return PRESETS[self.preset]

    def rules(self) -> tuple:
        own = tuple(custom_rule(t, p) for t, p in self.custom.items())
        scoped = tuple(r for r in (*COMMON, *LANGUAGE_RULES, *SECRET_RULES) if r.langs is None or set(r.langs) & set(self.languages))
        return tuple(r for r in (*scoped, *own) if r.name not in self.disabled_rules)

    def emitted_types(self) -> set[str]:
        models = {"PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "LOCATION", "DATE_TIME", "URL", "FINANCIAL", "SECRET"} if len(self.detectors) > 1 else set()
        return {r.entity_type for r in self.rules()} | models

    def policy(self) -> Policy:
        return Policy(Method(self.method), {t: Method(**m) for t, m in self.overrides.items()})

    def allow_rules(self) -> tuple[AllowRule, ...]:
        return tuple(AllowRule(**{**a, **({"entity_types": tuple(a["entity_types"])} if a.get("entity_types") is not None else {})}) for a in self.allow)

    def fingerprint(self) -> str:
        """A digest of all that decides what is detected: part of the key wherever detections are kept."""
        told = [self.preset, self.languages, sorted(self.disabled_rules), sorted(self.custom.items()), [(r.name, r.whole, r.score) for r in self.rules()]]
        return hashlib.blake2b(json.dumps(told).encode(), digest_size=16).hexdigest()

    def warnings(self) -> list[str]:
        """Allow entries that name a blocked type: the gate wins."""
        return [f"an allow rule names the blocked type {t}" for r in self.allow_rules() for t in r.entity_types or () if t in self.block_types]


def fill_environment(value, env: Mapping[str, str] | None = None):
    """``${NAME}`` in strings by the environment; a name that isn't set is an error."""
    env = os.environ if env is None else env
    if isinstance(value, str):

        def one(m):
            if m[1] not in env:
                raise ValueError(f"environment variable {m[1]} is not set")
            return env[m[1]]

        return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", one, value)
    if isinstance(value, dict):
        return {k: fill_environment(v, env) for k, v in value.items()}
    return [fill_environment(v, env) for v in value] if isinstance(value, list) else value


def from_dict(raw: Mapping, env: Mapping[str, str] | None = None) -> Config:
    known = {f.name for f in dataclasses.fields(Config)}
    if unknown := set(raw) - known:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    given = fill_environment(dict(raw), env)
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def load(path: str, env: Mapping[str, str] | None = None) -> Config:
    """A configuration from a JSON or YAML file. What is wrong is told by key and place, never by value."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        try:
            raw = json.loads(text)
        except ValueError as e:
            raise ValueError(f"the configuration is no JSON: line {e.lineno}") from None
    else:
        try:
            import yaml
        except ImportError:
            raise ValueError("YAML can't be read here; give the configuration as JSON") from None
        try:
            raw = yaml.safe_load(text)
        except yaml.YAMLError as e:
            mark = getattr(e, "problem_mark", None)
            raise ValueError("the configuration is no YAML" + (f": line {mark.line + 1}" if mark else "")) from None
    if not isinstance(raw or {}, dict):
        raise ValueError("the configuration must be a table of keys")
    return from_dict(raw or {}, env)
