"""HTTP clients for embedding and chat endpoints, behind the provider interfaces of ``providers``.

Requests go through ``send(url, headers, body, timeout) -> (status, headers, body)``,
which tests replace; the default uses the standard library.  What a status means for
a run (stop, wait, try again) is said by the exceptions of ``providers``.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from .providers import ModelNotFound, OutOfCredits, RateLimited

Send = Callable[[str, Mapping[str, str], bytes | None, float], tuple[int, Mapping[str, str], bytes]]


def over_http(url: str, headers: Mapping[str, str], body: bytes | None, timeout: float) -> tuple[int, Mapping[str, str], bytes]:
    request = urllib.request.Request(url, data=body, headers=dict(headers), method="GET" if body is None else "POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, dict(answer.headers), answer.read()
    except urllib.error.HTTPError as error:
        return error.code, dict(error.headers), error.read()


def _seconds(headers: Mapping[str, str]) -> float | None:
    said = next((v for k, v in headers.items() if k.lower() == "retry-after"), None)
    try:
        return None if said is None else float(said)
    except ValueError:
        return None


@dataclass
class _Client:
    url: str
    model: str
    key: str = ""
    timeout: float = 120.0
    send: Send = over_http

    def _call(self, path: str, payload: dict | None = None) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        body = None if payload is None else json.dumps(payload, ensure_ascii=False).encode()
        status, said, raw = self.send(self.url.rstrip("/") + path, headers, body, self.timeout)
        text = raw.decode("utf-8", "replace")
        if status in (401, 402, 403):
            raise OutOfCredits(f"{status}: the endpoint refuses the key or its credit is used up: {text[:200]}")
        if status == 404:
            raise ModelNotFound(f"404: no model {self.model!r}{self._offered() if payload is not None else ''}")
        if status == 429:
            raise RateLimited(f"429: {text[:200]}", _seconds(said))
        if status >= 400:
            raise RuntimeError(f"{status}: {text[:200]}")
        return json.loads(text)

    def models(self) -> list[str]:
        """Names of the models that the endpoint offers."""
        return [str(m["id"]) for m in self._call("/models").get("data", []) if isinstance(m, dict) and "id" in m]

    def _offered(self) -> str:
        try:
            return f"; there are {', '.join(self.models())}"
        except Exception:
            return ""


class HttpEmbedder(_Client):
    """``embed``: one vector a text, in order."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        rows = self._call("/embeddings", {"model": self.model, "input": list(texts)})["data"]
        rows = sorted(rows, key=lambda r: r.get("index", 0))
        if len(rows) != len(texts):
            raise ValueError(f"{len(rows)} vectors for {len(texts)} texts")
        return [[float(x) for x in r["embedding"]] for r in rows]


class HttpChat(_Client):
    """G1: ``complete``, at temperature 0.2."""

    def complete(self, prompt: str) -> str:
        said = self._call("/chat/completions", {"model": self.model, "temperature": 0.2, "messages": [{"role": "user", "content": prompt}]})
        return str(said["choices"][0]["message"]["content"])


def provider(name: str, **settings: object) -> object:
    """The provider that ``module:object`` names: called with the settings if it is a class or function."""
    import importlib

    module, _, attribute = name.partition(":")
    if not module or not attribute:
        raise ValueError(f"a provider is given as module:object, not {name!r}")
    made = getattr(importlib.import_module(module), attribute)
    return made(**{k: v for k, v in settings.items() if v}) if callable(made) else made
