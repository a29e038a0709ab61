"""Capabilities: objects with configuration and life cycle that modules call; one of each per Python worker.

Network clients are injected; the defaults are offline stubs, so nothing here calls out by itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from millrace.functions.vector import embed

_LIVE: dict[str, object] = {}


@dataclass(frozen=True)
class Capability:
    name: str
    factory: Callable[[dict], object]
    config: dict = field(default_factory=dict, hash=False, compare=False)
    methods: tuple[str, ...] = ()

    def spec(self) -> dict:
        return {"name": self.name, "methods": list(self.methods), "config": self.config}


def resource(c: Capability) -> object:
    """Made once per worker and configuration; ``reset`` is called when a task takes it up again."""
    key = f"{c.name}:{json.dumps(c.config, sort_keys=True, default=str)}"
    if key not in _LIVE:
        _LIVE[key] = c.factory(c.config)
    elif hasattr(_LIVE[key], "reset"):
        _LIVE[key].reset()
    return _LIVE[key]


class Transform:
    def __init__(self, config: dict):
        self.before, self.after, self.upper = config.get("prefix", ""), config.get("suffix", ""), config.get("uppercase", False)

    def transform(self, text: str) -> str:
        body = self.before + text
        return (body.upper() if self.upper else body) + self.after

    def batch(self, texts: list[str]) -> list[str]:
        return [self.transform(x) for x in texts]


class Counter:
    """Saturating; its scope is one worker's task, so global counts are a session's or an aggregate's work."""

    def __init__(self, config: dict):
        self.start, self.top = config.get("start", 0), config.get("max", 2**64 - 1)
        self.value = self.start

    def reset(self) -> None:
        self.value = self.start

    def add(self, n: int = 1) -> int:
        self.value = min(self.value + n, 2**64 - 1)
        if self.value > self.top:
            self.value = self.top
            raise ValueError("the counter's bound is reached")
        return self.value


class Http:
    """``client(method, url, body)`` is injected; URLs and methods must be allowed."""

    def __init__(self, config: dict):
        self.client = config.get("client") or (lambda method, url, body: {"status": "offline", "body": ""})
        self.urls, self.methods = config.get("urls", []), [m.upper() for m in config.get("methods", ["GET"])]

    def allowed(self, method: str, url: str) -> bool:
        return method.upper() in self.methods and any(url == p or url.startswith(f"{p}/") or p.endswith("/*") and url.startswith(p[:-2]) for p in self.urls)

    def request(self, method: str, url: str, body: str = "") -> dict:
        if not self.allowed(method, url):
            raise PermissionError(f"{method} {url} isn't allowed")
        return self.client(method.upper(), url, body)

    def get(self, url: str) -> dict:
        return self.request("GET", url)

    def post(self, url: str, body: str) -> dict:
        return self.request("POST", url, body)

    def put(self, url: str, body: str) -> dict:
        return self.request("PUT", url, body)

    def delete(self, url: str) -> dict:
        return self.request("DELETE", url)


class Llm:
    """``client(messages)`` is injected; a system prompt goes first if there is none."""

    def __init__(self, config: dict):
        self.client, self.system = config.get("client") or (lambda messages: f"echo: {messages[-1]['content']}"), config.get("system")

    def chat(self, messages: list[dict]) -> str:
        if self.system and not any(m["role"] == "system" for m in messages):
            messages = [{"role": "system", "content": self.system}, *messages]
        return self.client(messages)

    def generate(self, prompt: str) -> str:
        return self.chat([{"role": "user", "content": prompt}])


class Rag:
    """Search among configured documents (id, content)."""

    def __init__(self, config: dict):
        self.documents, self.k = config.get("documents", []), config.get("top_k", 3)
        self.vectors = [embed(d["content"].encode()).astype(np.float64) for d in self.documents]

    def search(self, query: str, k: int | None = None) -> list[dict]:
        q = embed(query.encode()).astype(np.float64)
        scores = [float(v @ q / (np.linalg.norm(v) * np.linalg.norm(q))) if v.any() and q.any() else 0.0 for v in self.vectors]
        order = sorted(range(len(scores)), key=lambda i: -scores[i])[: self.k if k is None else k]
        return [{**self.documents[i], "score": scores[i]} for i in order]


class Remote:
    """A capability behind a client made in the worker: ``connect()`` gives an object with ``call(method, *args)``."""

    def __init__(self, config: dict):
        self.client = config["connect"]()

    def __getattr__(self, method: str):
        return lambda *args: self.client.call(method, *args)


def cpu_count(spark) -> int:
    return spark.sparkContext.defaultParallelism
