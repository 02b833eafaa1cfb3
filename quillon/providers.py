"""Embedding and chat providers: the interface, retries (C5, C6, C8), offline stand-ins, and tolerant reading of what models say.

A provider is called in Arrow batches on the workers, never row by row from the
driver.  Anything with ``embed(texts)`` or ``complete(prompt)`` will do, and must be
picklable; ``remote`` has clients for HTTP endpoints.
"""

from __future__ import annotations

import functools
import hashlib
import json
import random
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RETRYABLE = frozenset("429 500 503 504 resource_exhausted unavailable internal deadline timeout".split())
WIDTH = 64


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Chat(Protocol):
    def complete(self, prompt: str) -> str: ...


class ModelNotFound(RuntimeError):
    """No such model: the run stops, what is done is kept."""


class OutOfCredits(RuntimeError):
    """The endpoint refuses: the run stops, what is done is kept."""


class RateLimited(RuntimeError):
    def __init__(self, message: str, retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


@functools.lru_cache(1 << 16)
def _short_place(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % WIDTH


def _place(word: str) -> int:
    """Where a word counts; those of usual lengths are remembered, up to a number."""
    return _short_place(word) if len(word) <= 32 else _short_place.__wrapped__(word)


class HashingEmbedder:
    """Stand-in: each lower-cased word counts in one of 64 places, scaled to length 1 (``stub_vector`` is the same in columns)."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * WIDTH
            for word in text.lower().split(" "):
                if word:
                    v[_place(word)] += 1
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


def stub_vector(text: Column) -> Column:
    """The stand-in's vector as a column expression."""
    words = F.filter(F.split(F.lower(text), " "), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(WIDTH)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))
    size = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(counts, lambda x: x / size)).otherwise(counts)


def wait(attempt: int, chance: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt, doubling to 30, and up to 0.35 more."""
    return min(30.0, 2.0 ** (attempt - 1)) + 0.35 * chance()


def is_retryable(error: Exception) -> bool:
    said = str(error).lower()
    return any(hint in said for hint in RETRYABLE)


def with_retries(call: Callable[[], Any], retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's result; errors that may pass are tried again."""
    for attempt in range(1, retries + 2):
        try:
            return call()
        except Exception as error:
            if attempt > retries or not is_retryable(error):
                raise
            sleep(wait(attempt))


def rate_limited(call: Callable[[], Any], attempts: int, sleep: Callable[[float], None] = time.sleep) -> Any:
    """After a rate limit waits as long as told, or 2 s doubling, within 1 to 60 s; after other errors 2 s; some errors end the run."""
    due = 2.0
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except (ModelNotFound, OutOfCredits):
            raise
        except RateLimited as error:
            if attempt == attempts:
                raise
            sleep(max(1.0, min(error.retry_after if error.retry_after is not None else due, 60.0)))
            due = min(2 * due, 60.0)
        except Exception:
            if attempt == attempts:
                raise
            sleep(2)


def embed_batch(provider: Embedder, texts: Sequence[str | None], size: int = 16, retries: int = 5, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text; blanks get neither; a failed batch goes one by one."""
    out: list[tuple[list[float] | None, str | None]] = [(None, None)] * len(texts)
    full = [i for i, t in enumerate(texts) if t and t.strip()]

    def ask(own: list[int]) -> list[list[float]]:
        got = with_retries(lambda: provider.embed([texts[i] for i in own]), retries, sleep)
        if len(got) != len(own):
            raise ValueError(f"{len(got)} vectors for {len(own)} texts")
        return got

    for k in range(0, len(full), max(1, size)):
        own = full[k : k + max(1, size)]
        try:
            for i, v in zip(own, ask(own)):
                out[i] = (list(v), None)
        except Exception:
            for i in own:
                try:
                    out[i] = (list(ask([i])[0]), None)
                except Exception as error:
                    out[i] = (None, str(error))
        if pause > 0:
            sleep(pause)
    return out


def embed_column(df: DataFrame, provider: Embedder, text: str = "content", size: int = 16, retries: int = 5, pause: float = 0.0) -> DataFrame:
    """Adds embedding (null for blank or failed) and embed_error; the order of rows is kept, unlike in the original (V6)."""

    @F.arrow_udf("embedding array<float>, embed_error string")
    def embedded(batch: pa.Array) -> pa.Array:
        got = embed_batch(provider, batch.to_pylist(), size, retries, pause)
        return pa.StructArray.from_arrays([pa.array([v for v, _ in got], pa.list_(pa.float32())), pa.array([e for _, e in got], pa.string())], ["embedding", "embed_error"])

    return df.withColumn("_e", embedded(text)).withColumn("embedding", F.col("_e.embedding")).withColumn("embed_error", F.col("_e.embed_error")).drop("_e")


def embed_arrays(provider: Embedder, size: int = 16, retries: int = 5) -> Callable[[Column], Column]:
    """Column function: vectors of an array of sentences; its ``stream`` yields them one by one, asking for ``size`` at a time, for packing by meaning."""

    def stream(sentences: Sequence[str]) -> Iterator[list[float]]:
        for k in range(0, len(sentences), max(1, size)):
            for v, error in embed_batch(provider, sentences[k : k + max(1, size)], size, retries):
                if error:
                    raise RuntimeError(error)
                yield v

    @F.arrow_udf("array<array<double>>")
    def embedded(batch: pa.Array) -> pa.Array:
        return pa.array([list(stream(sentences or [])) for sentences in batch.to_pylist()], pa.list_(pa.list_(pa.float64())))

    embedded.stream = stream
    return embedded


# what models say --------------------------------------------------------------


def repair_escapes(text: str) -> str:
    """inside strings, a backslash that starts no JSON escape becomes two."""
    out: list[str] = []
    inside, i = False, 0
    while i < len(text):
        c = text[i]
        step = 1
        if inside and c == "\\":
            after = text[i + 1 : i + 2]
            if after and after in '"\\/bfnrt':
                step = 2
            elif after == "u" and len(text) >= i + 6 and set(text[i + 2 : i + 6]) <= set("0123456789abcdefABCDEF"):
                step = 6
            else:
                out.append("\\")
        elif c == '"':
            inside = not inside
        out.append(text[i : i + step])
        i += step
    return "".join(out)


def read_object(said: str) -> dict:
    """F32: the JSON object in a model's answer: all of it, what a fence holds, or what the outer braces hold, each as it is and then repaired."""
    said = said.strip()
    tries = [said]
    rows = said.splitlines()
    if len(rows) > 2 and {rows[0][:3], rows[-1].strip()} == {"```"}:
        tries.append("\n".join(rows[1:-1]).strip())
    a, b = said.find("{"), said.rfind("}")
    if 0 <= a < b:
        tries.append(said[a : b + 1])
    for attempt in filter(None, tries):
        for form in (attempt, repair_escapes(attempt)):
            try:
                found = json.loads(form)
            except ValueError:
                continue
            if isinstance(found, dict):
                return found
    raise ValueError(f"no JSON object in: {said[:200]}")


def parsed_column(text: Column) -> Column:
    """F32 over rows: the object as JSON with sorted keys, null where there is none."""

    @F.arrow_udf("string")
    def parsed(batch: pa.Array) -> pa.Array:
        def one(said):
            try:
                return json.dumps(read_object(said), sort_keys=True, ensure_ascii=False) if said is not None else None
            except ValueError:
                return None

        return pa.array([one(s) for s in batch.to_pylist()], pa.string())

    return parsed(text)


# questions --------------------------------------------------------------------


def question_prompt(article: dict, n: int) -> str:
    """F35, in our own words; asks for the configured number."""
    return f"Read this legal article and write {n} short study questions about it in French, without answers.\nReply with one JSON object: the key questions holds a list of {n} strings.\n\n{json.dumps(article, ensure_ascii=False)}"


def top_up_prompt(article: dict, have: Iterable[str], n: int) -> str:
    return f"{n} more questions about this article are needed, none of them a repeat of:\n{json.dumps(list(have), ensure_ascii=False)}\nReply with one JSON object with the key questions.\n\n{json.dumps(article, ensure_ascii=False)}"


def verify_prompt(query: str, hits: list[dict]) -> str:
    shown = [{"index": i, "article_number": h.get("article_number"), "document_name": h.get("document_name"), "content": str(h.get("content") or "")[:900]} for i, h in enumerate(hits)]
    return f"Judge which of these passages help to answer the query {query!r}. Reply with one JSON object: overall (high, medium or low), explanation, and items, each with index, is_relevant, score from 0 to 1, reason.\n\n{json.dumps(shown, ensure_ascii=False)}"


class TemplateChat:
    """Stand-in: numbered questions about the first words of the article, in the prompt's own language of JSON."""

    def complete(self, prompt: str) -> str:
        n = next((int(w) for w in prompt.replace("\n", " ").split(" ") if w.isdigit()), 10)
        key = hashlib.md5(prompt.encode()).hexdigest()[:6]
        return json.dumps({"questions": [f"Que prévoit le point {k} ({key}) ?" for k in range(1, n + 1)]}, ensure_ascii=False)


def merged(have: list[str], more: Any, limit: int) -> list[str]:
    """A8 for one article."""
    out, seen = [], set()
    for q in [*have, *(more if isinstance(more, list) else [])]:
        q = str(q).strip()
        if q and q.casefold() not in seen and len(out) < limit:
            seen.add(q.casefold())
            out.append(q)
    return out


def ask_questions(chat: Chat, article: dict, n: int = 10, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """N distinct questions; one call for those missing; partial sets of failed attempts add up."""
    partial: list[str] = []

    def attempt() -> list[str]:
        nonlocal partial
        own = merged([], read_object(chat.complete(question_prompt(article, n))).get("questions"), n)
        if len(own) < n:
            own = merged(own, read_object(chat.complete(top_up_prompt(article, own, n - len(own)))).get("questions"), n)
        if len(own) < n:
            partial = merged(partial, own, n)
            raise ValueError(f"{len(own)} of {n} questions")
        return own

    try:
        return rate_limited(attempt, attempts, sleep)
    except (ModelNotFound, OutOfCredits, RateLimited):
        raise
    except Exception:
        if len(partial) >= n:
            return partial
        raise


STOPS = (ModelNotFound, OutOfCredits, RateLimited)


def question_column(df: DataFrame, chat: Chat, n: int = 10, attempts: int = 3, id: str = "id") -> DataFrame:
    """(article_id, questions, error, stop) of articles; the id is ours, not the model's.

    C9: what ends a run is a value, not an exception, which would have Spark repeat the
    task and its paid calls: the article that met it and the rest of its task get it as
    ``stop`` and no more calls are made there; what was finished before stands.
    """
    from .functions.text import prompt_record

    record = prompt_record(df.columns)
    made = df.select(F.col(id).alias("article_id"), record.alias("_article"))
    kinds = [pa.list_(pa.string()), pa.string(), pa.string()]

    def asked(batches):
        stop = None
        for batch in batches:
            rows = []
            for article in batch.column("_article").to_pylist():
                questions = error = None
                if stop is None:
                    try:
                        questions = ask_questions(chat, article, n, attempts)
                    except STOPS as reason:
                        stop = f"{type(reason).__name__}: {reason}"
                    except Exception as failure:
                        error = str(failure)
                rows.append((questions, error, stop))
            yield pa.RecordBatch.from_arrays([batch.column("article_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["article_id", "questions", "error", "stop"])

    schema = T.StructType([made.schema["article_id"], *T._parse_datatype_string("questions array<string>, error string, stop string")])
    return made.mapInArrow(asked, schema)
