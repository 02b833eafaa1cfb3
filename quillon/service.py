"""HTTP and command-line front of the search: routes, parameters, errors; no data logic of its own.

``GET /`` and ``/health`` describe the service; ``GET`` or ``POST /search`` answer a
query.  The body wins over URL parameters, blank ones use the defaults.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .functions.text import CLOSE_FILTERS
from .operators import search
from .providers import Chat, Embedder, HashingEmbedder, read_object, verify_prompt
from .remote import provider
from .sources import files

#: A page that asks for the hits at the default filter and has the first five verified, as ``/ui``.
PAGE = """<!doctype html><meta charset="utf-8"><title>Article search</title>
<style>body{font:16px sans-serif;max-width:50rem;margin:2rem auto}li{margin:1rem 0}small{color:#555}</style>
<form><input name="q" size="50" autofocus> <label><input type="checkbox" name="v"> verify</label> <button>Search</button></form><p id="said"></p><ol id="hits"></ol>
<script>
const form = document.querySelector("form"), said = document.getElementById("said"), hits = document.getElementById("hits");
form.onsubmit = async event => {
  event.preventDefault();
  hits.replaceChildren();
  said.textContent = "…";
  const body = {query: form.q.value, verify_results: form.v.checked, verify_top_n: 5};
  const got = await (await fetch("/search", {method: "POST", body: JSON.stringify(body)})).json();
  said.textContent = got.error || got.result_count + " hits " + (got.ai_verification.explanation || "");
  for (const hit of got.results || []) {
    const item = hits.appendChild(document.createElement("li")), note = item.appendChild(document.createElement("small"));
    note.textContent = [hit.document_name, hit.article_number, hit.pages, hit.similarity.toFixed(3), hit.closeness_label, hit.ai_is_relevant === undefined ? "" : hit.ai_is_relevant ? "relevant" : "not relevant"].filter(Boolean).join(" · ");
    item.appendChild(document.createElement("div")).textContent = hit.content;
  }
};
</script>
"""
SHOWN = (*files.ARTICLE_FIELDS, "embedded_file")


@dataclass
class Request:
    query: str = ""
    top_k: int = 5
    threshold: float = 0.0
    close_filter: str = "balanced"
    verify_results: bool = False
    verify_top_n: int = 5
    verify_model: str = "offline"
    model: str = "offline"
    api_key: str = ""

    @classmethod
    def read(cls, body: dict, url: dict[str, str]) -> Request:
        """ValueError where a value can't be read as its kind; a null number is a TypeError."""
        given = {}
        for f in fields(cls):
            value = body[f.name] if f.name in body else url.get(f.name)
            if f.name not in body and (value is None or not value.strip()):
                continue
            given[f.name] = truth(value) if f.type == "bool" else {"int": int, "float": float}.get(f.type, str)(value)
        return cls(**given)


def truth(value: object) -> bool:
    """F28."""
    if not isinstance(value, str):
        return isinstance(value, (bool, int, float)) and bool(value)
    return value.lower().strip() in frozenset("on yes true 1".split())


class Engine:
    """A corpus and the providers; the corpus is read once and kept in memory across queries."""

    def __init__(self, corpus: DataFrame | None, embedder: Embedder, source: str, chat: Chat | None = None):
        self.corpus, self.embedder, self.source, self.chat = corpus and corpus.cache(), embedder, source, chat

    @classmethod
    def at(cls, spark: SparkSession, source: str, embedder: Embedder, chat: Chat | None = None) -> Engine:
        """Over the files at a path; with no corpus where there is none."""
        try:
            corpus = files.embedded_corpus(spark, source)
        except (FileNotFoundError, AnalysisException) as error:
            if isinstance(error, AnalysisException) and error.getCondition() != "PATH_NOT_FOUND":
                raise
            corpus = None
        return cls(corpus, embedder, source, chat)

    def answer(self, r: Request) -> dict:
        """V11-V14 for one request."""
        threshold = search.checked(r.query, r.top_k, r.threshold, r.close_filter, r.verify_top_n)
        if self.corpus is None:
            raise RuntimeError(f"there are no embedded articles at {self.source}")
        (vector,) = self.embedder.embed([r.query])  # V3: one vector, on the driver
        order = [c for c in ("source_file", "pos") if c in self.corpus.columns]
        hits = search.search(self.corpus, vector, r.top_k, threshold, order)
        shown = [c for c in SHOWN if c in hits.columns]
        results = [row.asDict(recursive=True) for row in hits.select(*shown, "similarity", "closeness_label").collect()]  # top_k rows
        said = dict(enabled=False, model=r.verify_model, checked_count=0, relevant_count=0, overall="not-run", explanation="")
        if r.verify_results and results and self.chat is not None:
            try:
                said, results = verified(self.chat, r, results)
            except Exception as error:  # the hits stand without a verdict
                said |= {"explanation": "verification failed; hits are ranked by similarity alone", "error": str(error)}
        echo = {k: v for k, v in asdict(r).items() if k != "api_key"}
        least = CLOSE_FILTERS[r.close_filter.strip().lower()]
        return echo | {"close_filter_threshold": least, "effective_threshold": threshold, "top_similarity": results[0]["similarity"] if results else 0.0, "ai_verification": said, "embeddings_source": self.source, "result_count": len(results), "results": results}


def verified(chat: Chat, r: Request, results: list[dict]) -> tuple[dict, list[dict]]:
    """V14, A7, J5 for one response."""
    n = min(max(r.verify_top_n, 1), len(results))
    said = read_object(chat.complete(verify_prompt(r.query, results[:n])))
    items = {i["index"]: i for i in said.get("items") or [] if isinstance(i, dict) and isinstance(i.get("index"), int)}
    out = []
    for k, hit in enumerate(results):
        if k < n:
            judge = items.get(k, {})
            try:
                score = min(1.0, max(0.0, float(judge.get("score", 0))))
            except (ValueError, TypeError):
                score = 0.0
            hit = hit | {"ai_is_relevant": bool(judge.get("is_relevant")), "ai_relevance_score": score, "ai_reason": f"{judge.get('reason') or ''}"[:200]}
        out.append(hit)
    good = sum(h["ai_is_relevant"] for h in out[:n])
    own = str(said.get("overall", "")).strip().lower()
    band = "high" if good >= 0.75 * n else "low" if good <= 0.34 * n else "medium"
    summary = {"enabled": True, "model": r.verify_model, "checked_count": n, "relevant_count": good, "overall": own if own in ("high", "medium", "low") else band, "explanation": f"{said.get('explanation') or ''}".strip()[:300]}
    return summary, out


def respond(engine: Engine, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
    """Status and JSON of a request."""
    url = urlparse(target)
    if method == "GET" and url.path in ("/", "/index.html"):
        return 200, {"service": "article search", "routes": ["/health", "/search"]}
    if method == "GET" and url.path == "/health":
        return 200, {"file_count": 0 if engine.corpus is None else files.file_count(engine.corpus), "embeddings_source": engine.source, "status": "ok"}
    if url.path != "/search" or method not in ("GET", "POST"):
        return 404, {"error": "not found"}
    try:
        sent = json.loads(body) if method == "POST" and body else {}
        if not isinstance(sent, dict):
            raise ValueError("the body must be a JSON object")
        return 200, engine.answer(Request.read(sent, {k: v[-1] for k, v in parse_qs(url.query).items()}))
    except ValueError as error:
        return 400, {"error": str(error)}
    except Exception as error:
        return 500, {"error": str(error)}


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, payload: dict | None) -> None:
            raw = b"" if payload is None else json.dumps(payload, ensure_ascii=False).encode()
            self.send_response(status)
            allow = {"Origin": "*", "Methods": "OPTIONS, POST, GET", "Headers": "Content-Type"}
            headers = {"Content-Length": str(len(raw)), "Content-Type": "application/json;charset=UTF-8"} | {f"Access-Control-Allow-{k}": v for k, v in allow.items()}
            for name, value in headers.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(raw)

        def _page(self) -> None:
            raw = PAGE.encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/html;charset=UTF-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_OPTIONS(self) -> None:
            self._send(204, None)

        def do_GET(self) -> None:
            if urlparse(self.path).path == "/ui":
                return self._page()
            self._send(*respond(engine, "GET", self.path))

        def do_POST(self) -> None:
            self._send(*respond(engine, "POST", self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0))))

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def main(argv: list[str] | None = None, ask: Callable[[str], str] = input) -> None:
    p = argparse.ArgumentParser(description="Search embedded articles.")
    p.add_argument("source", help="JSON file or folder with embedded articles")
    p.add_argument("--query", "-q")
    for flags, kind, usual in (("--top-k -k", int, 5), ("--threshold -t", float, 0.0)):
        p.add_argument(*flags.split(), type=kind, default=usual)
    p.add_argument("--serve", type=int, metavar="PORT", help="answer HTTP requests instead")
    for what in ("provider", "chat"):
        p.add_argument(f"--{what}", metavar="MODULE:OBJECT", help="e.g. quillon.remote:Http" + ("Embedder" if what == "provider" else "Chat"))
    for what in ("url", "model", "key"):
        p.add_argument(f"--{what}", default="", help="passed to the provider")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("article-search").getOrCreate()
    given = {"url": a.url, "model": a.model, "key": a.key}
    embedder = provider(a.provider, **given) if a.provider else HashingEmbedder()
    engine = Engine.at(spark, a.source, embedder, provider(a.chat, **given) if a.chat else None)
    if a.serve is not None:
        ThreadingHTTPServer(("0.0.0.0", a.serve), handler(engine)).serve_forever()
    if engine.corpus is None:
        raise SystemExit(f"there are no embedded articles at {a.source}")
    while (query := a.query or ask("query (quit to leave): ")).strip().lower() != "quit":
        search.checked(query, a.top_k, a.threshold, "off")
        (vector,) = engine.embedder.embed([query])
        hits = search.ranked(search.search(engine.corpus, vector, a.top_k, a.threshold), ["source_file", "pos"])
        from .functions.text import result_text

        for row in hits.orderBy("rank").select(result_text("rank", "similarity", "article_number", "pages", "embedded_file", "content").alias("shown")).collect():
            print(row["shown"])
        if a.query:
            break


if __name__ == "__main__":
    main()
