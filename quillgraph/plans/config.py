"""Settings, with the environment's values over the defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from quillgraph.functions.fixed import WEIGHTS

PROVIDERS = {"ollama": None, "openai": "OPENAI_API_KEY", "gemini": "GEMINI_API_KEY", "echo": None}


def read_env_file(path: str = ".env") -> dict[str, str]:
    """``NAME=value`` lines of a file, if it is there."""
    found = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, eq, value = line.strip().partition("=")
                if eq and not name.startswith("#"):
                    found[name.strip()] = value.strip().strip("'\"")
    return found


@dataclass(frozen=True)
class Config:
    provider: str = "ollama"
    model: str = "llama3.2"
    top_k_vector: int = 5
    top_k_keyword: int = 5
    max_hops: int = 2
    max_chunks: int = 8
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    chunk_size: int = 512
    chunk_overlap: int = 64
    env: dict[str, str] = field(default_factory=dict, repr=False)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, **given) -> Config:
        env = {**read_env_file(), **os.environ} if env is None else env
        k = env.get("RETRIEVAL_TOP_K", "5")
        found = {
            "provider": env.get("LLM_PROVIDER", "ollama"), "model": env.get("LLM_MODEL", "llama3.2"),
            "top_k_vector": int(env.get("TOP_K_VECTOR", k)), "top_k_keyword": int(env.get("TOP_K_KEYWORD", 5)),
            "max_hops": int(env.get("MAX_HOPS", 2)), "max_chunks": int(env.get("MAX_CONTEXT_CHUNKS", 8)),
            "weights": {c: float(env.get(f"SCORE_WEIGHT_{c.upper()}", w)) for c, w in WEIGHTS.items()},
        }
        return cls(**{**found, **{k: v for k, v in given.items() if v is not None}}, env=env)

    def checked(self) -> Config:
        """Itself, or an error for an unknown provider, a blank model or a missing key."""
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider {self.provider!r}; known: {', '.join(PROVIDERS)}")
        if not self.model.strip():
            raise ValueError("no model is named")
        key = PROVIDERS[self.provider]
        if key and not self.env.get(key, "").strip():
            raise ValueError(f"{self.provider} needs {key}")
        return self
