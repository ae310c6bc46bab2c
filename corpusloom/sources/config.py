"""Settings: defaults, then a TOML file, then the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Http:
    max_bytes: int = 10 << 20
    timeout: float = 15.0
    per_second: float = 0.5
    redirects: int = 5
    respect_robots: bool = True
    allow_private: bool = False
    user_agent: str = "corpusloom/0.1"
    trusted: tuple[str, ...] = ("duckduckgo.com", "mojeek.com", "bing.com")  # result pages, fetched whatever robots.txt says


@dataclass(frozen=True)
class Embed:
    kind: str = "none"  # none, ollama or openai
    url: str = ""
    model: str = ""
    key: str = ""
    batch: int = 32
    timeout: float = 300.0

    def __post_init__(self):
        if self.kind not in ("none", "ollama", "openai"):
            raise ValueError(f"unknown embedder {self.kind!r}")
        if self.kind != "none" and not self.model:
            raise ValueError("an embedder needs a model")


@dataclass(frozen=True)
class Search:
    providers: tuple[str, ...] = ("ddg-html", "ddg-lite", "mojeek", "bing-browser")
    max_results: int = 10
    searx_urls: tuple[str, ...] = ()


@dataclass(frozen=True)
class Index:
    size: int = 3200
    overlap: int = 400
    auto: bool = False

    def __post_init__(self):
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be below the chunk size")


@dataclass(frozen=True)
class Browser:
    mode: str = ""  # empty: where HTTP meets a challenge; force: always
    renderer: str = ""  # module:function from url to html

    def __post_init__(self):
        object.__setattr__(self, "mode", browser_mode(self.mode))
        if self.mode not in ("", "none", "auto", "force", "solve"):
            raise ValueError(f"unknown browser mode {self.mode!r}")


@dataclass(frozen=True)
class Settings:
    data: str = ""
    http: Http = field(default_factory=Http)
    embed: Embed = field(default_factory=Embed)
    search: Search = field(default_factory=Search)
    index: Index = field(default_factory=Index)
    browser: Browser = field(default_factory=Browser)

    @property
    def folder(self) -> str:
        base = os.environ.get("XDG_DATA_HOME") or str(Path.home() / ".local/share")
        return self.data or f"{base}/corpusloom"


def browser_mode(value: str) -> str:
    """A mode, or a truth value for one: true forces the renderer, false overrides nothing."""
    if value in ("", "false", "False", "FALSE", "f", "F", "0"):
        return ""
    return "force" if value in ("true", "True", "TRUE", "t", "T", "1") else value


def truthy(s: str) -> bool:
    return s.strip().lower() in ("1", "true", "yes", "on")


def split_comma(s: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in s.split(",") if x.strip())


def _as(value, like):
    if isinstance(value, str) and not isinstance(like, str):
        return truthy(value) if isinstance(like, bool) else split_comma(value) if isinstance(like, tuple) else type(like)(value)
    return tuple(value) if isinstance(like, tuple) else value


def load(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Names in the environment are CORPUSLOOM_<SECTION>_<FIELD>, and CORPUSLOOM_DATA. Unknown names in the file are errors."""
    env = os.environ if env is None else env
    raw = tomllib.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    out = Settings(data=env.get("CORPUSLOOM_DATA", raw.pop("data", "")))
    for part in ("http", "embed", "search", "index", "browser"):
        own, given = getattr(out, part), dict(raw.pop(part, {}))
        names = {f.name for f in fields(own)}
        if unknown := set(given) - names:
            raise ValueError(f"unknown settings in [{part}]: {sorted(unknown)}")
        given |= {n: env[k] for n in names if (k := f"CORPUSLOOM_{part}_{n}".upper()) in env}
        out = replace(out, **{part: replace(own, **{k: _as(v, getattr(own, k)) for k, v in given.items()})})
    if raw:
        raise ValueError(f"unknown settings: {sorted(raw)}")
    return out
