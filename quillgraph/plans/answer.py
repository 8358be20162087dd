"""The language model at the end: a prompt, and providers to send it to."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.plans.config import Config

REFUSAL = "The documents do not hold enough to answer this."
PROMPT = (
    "Below are passages from a collection of documents, then a question.\n"
    "Rely on the passages and on nothing else. If they are not enough, reply with exactly: " + REFUSAL + "\n"
    "Keep it brief, and don't mention passage numbers.\n\nPassages:\n%s\n\nQuestion: %s\nReply:"
)


def prompt(context: Column, question: Column) -> Column:
    return F.format_string(PROMPT, context, question)


def _post(url: str, body: dict, headers: dict[str, str] | None = None) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=120) as reply:
        return json.load(reply)


def _ollama(text: str, c: Config) -> str:
    base = c.env.get("OLLAMA_HOST", "http://localhost:11434")
    return _post(f"{base}/api/generate", {"model": c.model, "prompt": text, "stream": False})["response"]


def _openai(text: str, c: Config) -> str:
    body = {"model": c.model, "temperature": 0.1, "messages": [{"role": "user", "content": text}]}
    got = _post("https://api.openai.com/v1/chat/completions", body, {"Authorization": f"Bearer {c.env['OPENAI_API_KEY']}"})
    return got["choices"][0]["message"]["content"]


def _gemini(text: str, c: Config) -> str:
    url = f"https://generativelanguage.googleapis.com/v1beta/models/{c.model}:generateContent"
    got = _post(url, {"contents": [{"parts": [{"text": text}]}]}, {"x-goog-api-key": c.env["GEMINI_API_KEY"]})
    return got["candidates"][0]["content"]["parts"][0]["text"]


CALLS: dict[str, Callable[[str, Config], str]] = {"ollama": _ollama, "openai": _openai, "gemini": _gemini, "echo": lambda text, c: text}


def call(text: str, config: Config) -> str:
    """The model's reply; whatever goes wrong is told in the reply, never raised."""
    try:
        return CALLS[config.provider](text, config).strip()
    except Exception as e:
        return f"[Error calling LLM: {e}]"
