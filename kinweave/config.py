"""Settings: thirteen tunables with bounds, from the environment, built once."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from functools import lru_cache


@dataclass(frozen=True)
class Settings:
    """Each field reads the environment variable of its name in upper case."""

    openai_api_key: str = ""
    openai_model: str = "gpt-4o-mini"
    database_url: str = ""
    default_pages: int = 2
    request_delay: float = 1.5
    sentences_per_chunk: int = 5
    max_parallel_articles: int = 1
    resolver_recency_enabled: bool = True
    resolver_llm_fallback_enabled: bool = True
    default_page_size: int = 20
    host: str = "0.0.0.0"
    port: int = 8000
    log_level: str = "info"

    def __post_init__(self) -> None:
        between("default_pages", self.default_pages, 1, 50)
        between("request_delay", self.request_delay, 0)
        between("sentences_per_chunk", self.sentences_per_chunk, 1)
        between("max_parallel_articles", self.max_parallel_articles, 1, 50)
        between("default_page_size", self.default_page_size, 1, 200)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        known = {k.lower(): v for k, v in (os.environ if env is None else env).items()}
        read = {"str": str, "int": int, "float": float, "bool": lambda x: x.strip().lower() in ("1", "true", "yes", "on")}
        return cls(**{f.name: read[f.type](known[f.name]) for f in fields(cls) if f.name in known})


def between(name: str, value: float | None, low: float, high: float | None = None) -> None:
    """Raises ValueError unless value is missing or within the bounds."""
    if value is not None and (value < low or (high is not None and value > high)):
        raise ValueError(f"{name} is {value}; it must be at least {low}" + (f" and at most {high}" if high is not None else ""))


@lru_cache(maxsize=1)
def settings() -> Settings:
    return Settings.from_env()
