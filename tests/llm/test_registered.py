"""The registered queries themselves, every contract column, against brute force: on a driver table and on one of odd rows."""

import hashlib
import io
import re
import wave
from math import log1p
from zlib import crc32

import numpy as np
import pytest

from quillon.llm import langid, pii, quality
from quillon.llm.registry import QUERIES

from .conftest import SCHEMA, corpus
from .test_documents import brute_counts, brute_pii

ODD = [None, "", " \n\t", "\x00", "日本語 naïve ²³", "a@b.cd 1.2.3.4 4111 1111 1111 1111 +1 (555) 234-5678", "x" * 5000, "word " * 3000, "<|endoftext|> a", "%PDF-1.4 x %%EOF"]


@pytest.fixture(scope="module", params=["driver", "odd"])
def case(request, spark, sf_dir, tmp_path_factory):
    """(folder, rows as (doc_id, text, lang), quality labels)."""
    if request.param == "driver":
        folder = sf_dir
    else:
        folder = str(tmp_path_factory.mktemp("odd"))
        rows = [r for r in corpus(5, 70)][:-1]
        rows += [(1000 + k, t, "en", "s", len(t or "")) for k, t in enumerate(ODD * 2)]
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
    return folder, rows, spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.no_truncation()
    made.no_padding()
    return made


def by_id(spark, name, folder):
    rows = QUERIES[name](spark, folder).collect()
    return {r["doc_id"]: r for r in rows}, len(rows)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def raw(ids) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_op2(spark, case, library):
    got, n = by_id(spark, "op2_bpe_round_trip", case[0])
    assert n == len(case[1])
    for d, t, _ in case[1]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), sha(raw(ids)), sha(decoded.encode()))


def test_op9(spark, case, library):
    got, n = by_id(spark, "op9_token_counts", case[0])
    assert n == len(case[1])
    for d, t, _ in case[1]:
        count = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[d]["n_bytes"], got[d]["n_tokens"], got[d]["over_limit"]) == (len((t or "").encode()), count, count > 512)


def test_op3(spark, case, library):
    rows = QUERIES["op3_best_fit_packing"](spark, case[0]).collect()
    own, sequences = {}, {}
    for r in rows:
        own.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for d, t, _ in case[1]:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        pieces = sorted(own[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // 2048)
        at = 0
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == crc32(raw(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 2048 for r in pieces[1:])
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + max(2, total // 2048 // 50)


def test_op4(spark, case):
    got, n = by_id(spark, "op4_pii", case[0])
    assert n == len(case[1])
    for d, t, _ in case[1]:
        base = sorted(brute_pii(t or ""))
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        r = got[d]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in range(4)] and r["base_sha256"] == sha(joined.encode())
        spans = [s for s in r["spans"].split(",") if s]
        assert set(filter(None, joined.split(","))) <= set(spans) and len(spans) == len(base) + r["n_added"]
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)


def test_op7(spark, case):
    got, n = by_id(spark, "op7_media_columns", case[0])
    assert n == len(case[1])
    for d, t, _ in case[1]:
        data = (t or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(payload)
        media, r, m = buffer.getvalue(), got[d], len(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), m, sha(payload), crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["media_type"]) == (len(media), sha(media), "audio/wav")
        total, squares = sum(payload), sum(x * x for x in payload)
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
        assert r["feature"] == f"audio/wav;rate=8000;n={m};mean_milli={1000 * total // m};var_milli={1000 * (m * squares - total * total) // (m * m)};crossings={crossings};peak={max(payload)}"
        if t == "%PDF-1.4 x %%EOF":
            assert (r["n_embedded"], r["embedded"]) == (1, f"application/pdf:0:{len(t)}")


def plain_vector(text):
    """Hypervector of a text letter by letter: 3-grams around each letter, the letters' vectors rolled by their place and multiplied, weighted by log of their number."""
    symbols = [0]
    for c in text:
        s = ord(c.lower()[0]) if c.isalpha() else 0
        if s or symbols[-1]:
            symbols.append(s)
    symbols += [0] * (symbols[-1] != 0)
    grams: dict = {}
    for k in range(1, len(symbols) - 1):
        if symbols[k]:
            g = tuple(symbols[k - 1 : k + 2])
            grams[g] = grams.get(g, 0) + 1
    out = np.zeros(langid.DIMENSIONS)
    for g, times in grams.items():
        bound = np.ones(langid.DIMENSIONS)
        for place, s in enumerate(g):
            bound *= np.roll(langid.letter_vectors(np.array([s]))[0], 2 - place)
        out += log1p(times) * bound
    return out / np.linalg.norm(out) if out.any() else out


def test_op8(spark, case):
    folder, rows, _ = case
    got, n = by_id(spark, "op8_language_id", folder)
    assert n == len(rows)
    assert all(got[d]["held_out"] == (crc32(str(d).encode()) % 5 == 0) for d, _, _ in rows)
    assert all((got[d]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[d]["score"] <= 1 for d, t, _ in rows)
    vectors = {d: plain_vector(t) for d, t, _ in rows if t and len(t) < 4000}
    learned: dict = {}
    for d, t, lang in rows:
        if lang is not None and t is not None and not got[d]["held_out"]:
            learned[lang] = learned.get(lang, 0) + (vectors[d] if d in vectors else plain_vector(t))
    learned = {k: v / np.linalg.norm(v) for k, v in learned.items() if v.any()}
    for d, v in list(vectors.items())[:60]:
        if v.any():
            cosines = {k: float(v @ p) for k, p in learned.items()}
            assert abs(max(cosines.values()) - got[d]["score"]) < 1e-3 or max(cosines.values()) < 0
            assert cosines[got[d]["lang_pred"]] > max(cosines.values()) - 1e-3


def test_op8_accuracy_on_what_was_held_out(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [r for r in QUERIES["op8_language_id"](spark, sf_dir).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.95


def plain_features(text):
    """The statistics of a text that the trees see, counted one by one."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dup, repeats = brute_counts(text)
    full = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    c, some = max(chars, 1), max(n, 1)
    return [log1p(n), chars / some, symbols / c, dup / max(len(full), 1), repeats / some, upper / max(upper + lower, 1), text.count("!") / c,
            len(re.findall("[0-9]", text)) / c, (text.count(",") + text.count(".")) / c, log1p(n / max(len(full), 1)), len(set(w)) / some]


def test_op10(spark, case):
    folder, rows, labels = case
    got, n = by_id(spark, "op10_quality_rules", folder)
    assert n == len(rows)
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    for d, t, _ in rows:
        r, want = got[d], brute_counts(t)
        assert [r[c] for c in quality.COUNTS] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        x, score = plain_features(t), model.bias
        for root in model.roots.tolist():
            node = root
            while model.left[node] != node:
                node = model.left[node] if x[model.feature[node]] <= model.threshold[node] else model.right[node]
            score += model.value[node]
        assert r["base_failed"] == failed and abs(r["quality_score"] - 1 / (1 + np.exp(-score))) < 1e-9
        assert r["kept"] == (not failed and r["quality_score"] >= 0.5)


def test_op10_trees_are_those_of_their_arrays():
    r = np.random.default_rng(9)
    x = r.random((500, 4))
    model = quality.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float), [0, 0, 0, 0])
    for row, score in zip(x[:40], model.raw(x[:40])):
        total = model.bias
        for root in model.roots.tolist():
            node = root
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        assert abs(total - score) < 1e-9
