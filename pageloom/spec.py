"""Site descriptions: small, validated job configuration held on the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any
from urllib.parse import urlsplit

import yaml

MISSING = object()


class SpecError(ValueError):
    """The site description is not valid."""


@dataclass(frozen=True)
class Field:
    name: str
    selector: str | None = None
    attr: str | None = None
    html: bool = False
    many: bool = False
    transform: tuple[str, ...] = ()
    default: Any = MISSING
    optional: bool = False

    @property
    def has_default(self) -> bool:
        return self.default is not MISSING


@dataclass(frozen=True)
class Pagination:
    type: str
    selector: str | None = None
    param: str | None = None
    start: int = 1
    step: int = 1
    max_pages: int = 1


@dataclass(frozen=True)
class Resource:
    name: str
    path: str
    fields: tuple[Field, ...]
    row_selector: str | None = None
    pagination: Pagination | None = None
    post_process: str | None = None
    description: str | None = None

    @property
    def is_list(self) -> bool:
        return self.row_selector is not None


@dataclass(frozen=True)
class Politeness:
    requests_per_second: float = 1.0
    respect_robots: bool = True
    cache_ttl_ms: int = 600_000
    user_agent: str = "pageloom-bot"
    timeout_ms: int = 15_000
    max_retries: int = 2


@dataclass(frozen=True)
class SiteSpec:
    name: str
    base_url: str
    resources: tuple[Resource, ...]
    description: str | None = None
    hooks: str | None = None
    politeness: Politeness = field(default_factory=Politeness)

    def resource(self, name: str) -> Resource:
        for resource in self.resources:
            if resource.name == name:
                return resource
        known = ", ".join(r.name for r in self.resources)
        raise KeyError(f"no resource is called {name!r}; this site has {known}")


# Milliseconds per duration unit.
UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def parse_duration(value: str | int | float) -> int | float:
    """Milliseconds for ``10m``, ``30s``, ``1.5h``, ``500`` or a number."""
    if isinstance(value, (int, float)):
        return value
    match = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*(ms|s|m|h|d)?", value.strip())
    if not match:
        raise SpecError(f"{value!r} is not a duration such as 10m or 1.5h")
    return int(float(match[1]) * UNIT_MS[match[2] or "ms"] + 0.5)


class _Reader:
    """Checks one mapping: every key known, every value of the right type."""

    def __init__(self, raw: Any, where: str) -> None:
        if not isinstance(raw, Mapping):
            raise SpecError(f"{where}: expected a mapping")
        self.raw, self.where, self.seen = raw, where, set()

    def get(self, key: str, kind: type | tuple[type, ...], default: Any = None) -> Any:
        self.seen.add(key)
        if key not in self.raw:
            if default is ...:
                raise SpecError(f"{self.where}.{key}: required")
            return default
        value = self.raw[key]
        kinds = kind if isinstance(kind, tuple) else (kind,)
        wrong_bool = isinstance(value, bool) and bool not in kinds
        if not isinstance(value, kinds) or wrong_bool:
            raise SpecError(f"{self.where}.{key}: wrong type {type(value).__name__}")
        return value

    def done(self) -> None:
        unknown = set(self.raw) - self.seen
        if unknown:
            raise SpecError(f"{self.where}: unknown key(s) {sorted(map(str, unknown))}")


def _field(name: str, raw: Any, where: str) -> Field:
    if isinstance(raw, str):
        return Field(name, selector=raw)
    r = _Reader(raw, where)
    transform = r.get("transform", (str, list), [])
    steps = (transform,) if isinstance(transform, str) else tuple(transform)
    if not all(isinstance(step, str) for step in steps):
        raise SpecError(f"{where}.transform: expected names")
    r.seen.add("default")
    result = Field(
        name=name,
        selector=r.get("selector", str),
        attr=r.get("attr", str),
        html=r.get("html", bool, False),
        many=r.get("many", bool, False),
        transform=steps,
        default=r.raw.get("default", MISSING),
        optional=r.get("optional", bool, False),
    )
    r.done()
    return result


def _fields(raw: Any, where: str) -> tuple[Field, ...]:
    if not isinstance(raw, Mapping):
        raise SpecError(f"{where}: expected a mapping")
    return tuple(_field(str(name), value, f"{where}.{name}") for name, value in raw.items())


def _pagination(raw: Any, where: str) -> Pagination:
    r = _Reader(raw, where)
    kind = r.get("type", str, ...)
    if kind not in ("link", "query"):
        raise SpecError(f"{where}.type: expected link or query")
    result = Pagination(
        type=kind,
        selector=r.get("selector", str),
        param=r.get("param", str),
        start=r.get("start", int, 1),
        step=r.get("step", int, 1),
        max_pages=r.get("maxPages", int, 1),
    )
    if result.max_pages < 1:
        raise SpecError(f"{where}.maxPages: must be positive")
    r.done()
    return result


def _resource(raw: Any, where: str) -> Resource:
    r = _Reader(raw, where)
    name = r.get("name", str, ...)
    if not re.fullmatch(r"[A-Za-z0-9-]+", name):
        raise SpecError(f"{where}.name: only letters, numbers and hyphens")
    fetch = _Reader(r.get("fetch", Mapping, ...), f"{where}.fetch")
    path = fetch.get("path", str, ...)
    paging = fetch.get("pagination", Mapping)
    fetch.done()
    rows, item = r.get("list", Mapping), r.get("item", Mapping)
    selector, fields = None, ()
    if item is not None:
        reader = _Reader(item, f"{where}.item")
        fields = _fields(reader.get("fields", Mapping, ...), f"{where}.item.fields")
        reader.done()
    if rows is not None:
        reader = _Reader(rows, f"{where}.list")
        selector = reader.get("selector", str, ...)
        fields = _fields(reader.get("fields", Mapping, ...), f"{where}.list.fields")
        reader.done()
    if rows is None and item is None:
        raise SpecError(f"{where}: one of list and item has to be given")
    result = Resource(
        name=name,
        path=path,
        fields=fields,
        row_selector=selector,
        pagination=None if paging is None else _pagination(paging, f"{where}.fetch.pagination"),
        post_process=r.get("postProcess", str),
        description=r.get("description", str),
    )
    r.done()
    return result


def _politeness(raw: Any) -> Politeness:
    r = _Reader(raw, "politeness")
    result = Politeness(
        requests_per_second=float(r.get("requestsPerSecond", (int, float), 1)),
        respect_robots=r.get("respectRobotsTxt", bool, True),
        cache_ttl_ms=parse_duration(r.get("cacheTtl", str, "10m")),
        user_agent=r.get("userAgent", str, Politeness.user_agent),
        timeout_ms=r.get("timeoutMs", int, 15_000),
        max_retries=r.get("maxRetries", int, 2),
    )
    if result.requests_per_second <= 0 or result.timeout_ms <= 0 or result.max_retries < 0:
        raise SpecError("politeness: numbers out of range")
    r.done()
    return result


def spec_from_dict(raw: Any) -> SiteSpec:
    r = _Reader(raw, "site")
    base_url = r.get("baseUrl", str, ...)
    parts = urlsplit(base_url)
    if not parts.scheme or (parts.scheme in ("http", "https") and not parts.netloc):
        raise SpecError("site.baseUrl: not a URL")
    resources = r.get("resources", list, ...)
    if not resources:
        raise SpecError("site.resources: at least one resource is needed")
    result = SiteSpec(
        name=r.get("name", str, ...),
        base_url=base_url,
        resources=tuple(_resource(x, f"resources[{i}]") for i, x in enumerate(resources)),
        description=r.get("description", str),
        hooks=r.get("hooks", str),
        politeness=_politeness(r.get("politeness", Mapping, {})),
    )
    r.done()
    return result


class _Yaml12(yaml.SafeLoader):
    """Only true/false are booleans; yes, no, on and off stay text."""


_Yaml12.yaml_implicit_resolvers = {
    first: [(tag, rx) for tag, rx in rules if tag not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")]
    for first, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
_Yaml12.add_implicit_resolver(
    "tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF")
)


def parse_spec(source: str) -> SiteSpec:
    """A site description from YAML or JSON text."""
    try:
        raw = json.loads(source)
    except ValueError:
        try:
            raw = yaml.load(source, Loader=_Yaml12)
        except yaml.YAMLError as err:
            raise SpecError(str(err)) from err
    return spec_from_dict(raw)


def load_spec(path: str | Path) -> SiteSpec:
    try:
        return parse_spec(Path(path).read_text(encoding="utf-8"))
    except SpecError as err:
        raise SpecError(f"{path} is no site description: {err}") from err
