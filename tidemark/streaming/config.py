"""Configuration: immutable sources of properties, environment overrides, randomised values."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from datetime import timedelta
from typing import Any

RANDOMIZE = ".randomize"


@dataclass(frozen=True)
class ConfigSource:
    """Properties with a name; ``with_`` gives a new source. ``create`` applies all processors."""

    name: str
    properties: Mapping[str, Any] = field(default_factory=dict)
    processors: tuple[Callable[[dict], dict], ...] = ()
    required: tuple[str, ...] = ()

    def with_(self, key: str, value: Any) -> ConfigSource:
        return replace(self, properties={**self.properties, key: value})

    def with_all(self, properties: Mapping[str, Any]) -> ConfigSource:
        return replace(self, properties={**self.properties, **properties})

    def processed_by(self, processor: Callable[[dict], dict]) -> ConfigSource:
        return replace(self, processors=(*self.processors, processor))

    def requiring(self, *keys: str) -> ConfigSource:
        return replace(self, required=(*self.required, *keys))

    def create(self) -> dict[str, Any]:
        out = environment_overrides(self.name)(dict(self.properties))
        out = randomised(out)
        for p in self.processors:
            out = p(out)
        if missing := [k for k in self.required if out.get(k) is None]:
            raise ValueError(f"{self.name} lacks {', '.join(missing)}")
        return out


def environment_overrides(prefix: str, env: Mapping[str, str] | None = None) -> Callable[[dict], dict]:
    """``PREFIX_SOME_KEY`` overrides ``some.key``; keys that aren't there are added."""

    def run(properties: dict) -> dict:
        head = prefix.upper().replace("-", "_").replace(".", "_") + "_"
        found = {k[len(head) :].lower().replace("_", "."): v for k, v in (os.environ if env is None else env).items() if k.startswith(head)}
        return {**properties, **found}

    return run


def randomised(properties: dict) -> dict:
    """A key whose ``.randomize`` is true gets a UUID behind its value; the switches go."""
    on = {k.removesuffix(RANDOMIZE) for k, v in properties.items() if k.endswith(RANDOMIZE) and str(v).lower() == "true"}
    return {k: f"{v}-{uuid.uuid4()}" if k in on else v for k, v in properties.items() if not k.endswith(RANDOMIZE)}


def properties_file(path: str) -> Callable[[dict], dict]:
    """Adds ``key=value`` lines of a file; what is set already stays."""

    def run(properties: dict) -> dict:
        with open(path, encoding="utf-8") as f:
            pairs = [x.strip().partition("=") for x in f if "=" in x and not x.lstrip().startswith(("#", "!"))]
        return {**{k.strip(): v.strip() for k, _, v in pairs}, **properties}

    return run


def namespaced(properties: Mapping[str, Any], namespace: str, defaults: str = "defaults") -> dict[str, Any]:
    """Properties below ``namespace``, over those below ``defaults``."""
    pick = lambda n: {k[len(n) + 1 :]: v for k, v in properties.items() if k.startswith(n + ".")}
    return {**pick(defaults), **pick(namespace)}


def load(properties: Mapping[str, Any], key: str, kind: Callable[[Any], Any], default: Any = None) -> Any:
    """A value by key, converted; missing ones take the default."""
    value = properties.get(key)
    return default if value is None else kind(value)


def boolean(value: Any) -> bool:
    return value if isinstance(value, bool) else {"true": True, "false": False}[str(value).strip().lower()]


def duration(value: Any) -> timedelta:
    """ISO-8601 (``PT1M30S``, ``P1DT2H``) or a timedelta."""
    import re

    if isinstance(value, timedelta):
        return value
    m = re.fullmatch(r"(-)?P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", str(value).strip().upper())
    if not m or not any(m.groups()[1:]):
        raise ValueError(f"not a duration: {value}")
    d, h, mi, s = (float(x or 0) for x in m.groups()[1:])
    out = timedelta(days=d, hours=h, minutes=mi, seconds=s)
    return -out if m[1] else out


def names(value: Any) -> list[str]:
    """A list, or a comma-separated one."""
    return [x.strip() for x in value.split(",") if x.strip()] if isinstance(value, str) else list(value)
