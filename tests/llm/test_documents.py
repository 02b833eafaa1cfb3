"""Operators on single documents."""

import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import langid, media, pii, quality


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    g = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]


def test_quality(spark, docs, rows, none):
    labels = spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(rows)] + [(None, 1), (999, None), (998, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.judge(docs.withColumnRenamed("source", "kept"), model)
    assert out.columns.count("kept") == 1
    for r in out.collect():
        want = brute_counts(r["text"])
        assert [r[c] for c in quality.COUNTS] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["quality_score"] >= 0.5)
    assert quality.judge(none, model).count() == 0
    nothing = quality.train(none, labels)
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(docs, nothing).collect())


def test_trees_learn_and_keep_directions():
    r = np.random.default_rng(5)
    x = r.random((3000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.2) ^ (r.random(3000) < 0.02)).astype(float)
    model = quality.fit(x[:2000], y[:2000], [-1, 0, 0])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    grid = np.linspace(0, 1, 200)
    for _ in range(20):
        probe = np.repeat(r.random((1, 3)), 200, 0)
        probe[:, 0] = grid
        assert (np.diff(model.score(probe)) <= 1e-12).all()


def test_quality_separates_held_out_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    held = quality.judge(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), model).where("not base_failed").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in held]) > 0.9


def test_language(spark, sf_dir, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = langid.learn(docs.where("doc_id % 2 = 0"))
    out = langid.predict(docs.where("doc_id % 2 = 1"), learned).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95 and all(0 <= r["score"] <= 1 for r in out)
    assert langid.predict(none, learned).count() == 0 and langid.learn(none)[0] == []


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([(1, "the river and the stone", "en"), (2, "la rivière et la pierre", "fr"), (3, None, "de"), (4, "12 34", "xx"), (None, "abc", "yy")], "doc_id long, text string, lang string")
    learned = langid.learn(train)
    assert learned[0] == ["en", "fr"]
    texts = [None, "", "123 !?", "a", "the stone and the river", "la pierre"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, learned).collect()}
    assert [got[k] for k in range(3)] == ["und"] * 3 and got[3] in ("en", "fr") and (got[4], got[5]) == ("en", "fr")
    assert {r["lang_pred"] for r in langid.predict(df, ([], np.zeros((0, langid.DIMENSIONS)))).collect()} == {"und"}


SCRIPTS = {
    "el": "ο ποταμός και η πέτρα είναι κοντά στο χωριό μας σήμερα το πρωί",
    "ru": "река и камень сегодня утром были рядом с нашей деревней",
    "uk": "річка і камінь сьогодні вранці були поруч із нашим селом",
    "ja": "川と石は今朝わたしたちの村の近くにありました",
    "zh": "今天早上河流和石头就在我们村庄的附近",
    "pl": "rzeka i kamień są dziś rano blisko naszej wsi, żółta łódź też",
}
SHORT = {"el": "η πέτρα", "ru": "были рядом", "uk": "річка вранці", "ja": "村の近く", "zh": "我们村庄", "pl": "żółta łódź"}


def test_languages_of_other_scripts(spark):
    learned = langid.learn(spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(SCRIPTS.items())], "doc_id long, text string, lang string"))
    df = spark.createDataFrame(list(SHORT.items()), "lang string, text string")
    got = {r["lang"]: r["lang_pred"] for r in langid.predict(df, learned).collect()}
    assert got == {x: x for x in SHORT}
    made = langid.vectors(pa.array(["αβγδε μνξ", "абвгд мно", "אבגדה", "ابجده", "かきくけ", "ΑΒΓΔΕ ΜΝΞ"]))[0]
    cosine = made @ made.T
    assert np.abs(cosine[:5, :5] - np.eye(5)).max() < 0.2 and cosine[0, 5] > 0.999


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_as_the_patterns():
    r = random.Random(1)
    for _ in range(20000):
        t = "".join(r.choice("0123456789 .-+@()ab\né") for _ in range(r.randint(0, 50)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_base_spans_are_linear():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000 + "x", "@" * 100_000, "+1" + "(" * 100_000, "9" * 100_000 + "x"):
        pii.find([t])


def test_field_on_held_out_documents():
    texts, spans = pii._generated(77, 300)
    graph = pii._graph(texts, [pii.base_spans(t) for t in texts])
    y, p = pii._true_labels(graph, spans), pii._beliefs(graph, pii.trained())
    free = graph["clamp"] == 0
    assert (p.argmax(1) == y)[free].mean() > 0.95
    assert ((p.argmax(1) > 0) & (p.max(1) >= pii.SURE))[free & (y == 0)].mean() < 0.02


def test_other_spellings_follow_the_recognised_one(spark, docs, rows, none):
    known = "call +1 (555) 234-5678 now, later 555-234-5678 or nothing"
    alone = "order 555-234-5678 alone"
    df = spark.createDataFrame([(1, known), (2, alone), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.detect(df).collect()}
    assert got[1]["n_phone"] == 1 and got[1]["n_added"] == 1 and got[1]["spans"].count("phone") == 2
    assert got[2]["spans"] == got[3]["spans"] == got[4]["spans"] == ""
    hidden = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert hidden == {1: "call <PHONE> now, later <PHONE> or nothing", 2: alone, 3: None, 4: ""}
    assert pii.detect(docs).count() == len(rows) and pii.detect(none).count() == pii.mask(none).count() == 0


def phones(text):
    (base,), (added,) = pii.find([text])
    return sorted((a, b) for k, a, b in base + added if k == 3)


@pytest.mark.parametrize("first", [0, 50, 99])
def test_one_recognised_form_reaches_a_hundred_others(first):
    parts = ["so 555-234-5678 said"] * 100
    parts[first] = "so +1 (555) 234-5678 said"
    text = " ".join(parts)
    got = phones(text)
    assert len(got) == 100 and pii.masked(text, [(3, a, b) for a, b in got]) == " ".join(["so <PHONE> said"] * 100)
    assert phones(" ".join(["so 555-234-5678 said"] * 100)) == []


def test_beliefs_do_not_depend_on_the_batch_and_unsettled_documents_get_some(monkeypatch):
    texts = pii._generated(5, 40)[0]
    whole = pii.find(texts)[1]
    assert whole == [pii.find([t])[1][0] for t in texts]
    monkeypatch.setattr(pii, "PATIENCE", 1)
    monkeypatch.setattr(pii, "LEAST_STEP", 1)
    text = " ".join(["so 555-234-5678 said"] * 20 + ["+1 (555) 234-5678"])
    assert len(phones(text)) == 21


@pytest.mark.parametrize("known, other, kind", [
    ("+1 (555) 234-5678", "Tel:555-234-5678", "555-234-5678"),
    ("+1 (555) 234-5678", "ph.5552345678", "5552345678"),
    ("+1 (555) 234-5678", "234-5678", "234-5678"),
    ("+1 (555) 234-5678", "5-234-5678", "5-234-5678"),
    ("4111111111111111", "card=4111.1111.1111.1111", "4111.1111.1111.1111"),
])
def test_glued_and_local_spellings_follow_the_recognised_one(known, other, kind):
    text = f"say {known} now and {other} then and {other} too"
    (base,), (added,) = pii.find([text])
    assert len(base) == 1 and [text[a:b] for _, a, b in added] == [kind] * 2 and {k for k, _, _ in added} == {base[0][0]}
    alone = f"say {other} then and nothing"
    assert pii.find([alone])[1] == [[]] or other.startswith("card")


def test_identical_tokens_are_tied_whatever_they_are():
    for token in ("Tel:555-234-5678", "12", "x9y8", "234-5678", "a1b22c", "@me"):
        graph = pii._graph([f"{token} or {token}, not 77"], [[]])
        assert [0, 1, 1] in graph["edges"].tolist()


def png(payload=b"\0\0"):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(payload)) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x01\x02\xff\x00\x03\xff\xd9"
BMP = b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4


@pytest.mark.parametrize("content, kind", [(png(), "image/png"), (GIF, "image/gif"), (JPEG, "image/jpeg"), (BMP, "image/bmp"), (media.store_bytes(b"abc"), "audio/wav")])
def test_sniffing(content, kind):
    assert media.objects(content) == [(kind, 0, len(content))]
    found = media.objects(b"junk" + content + b"tail")
    assert found == [(kind, 4, len(content))]
    assert media.objects(content[:-3]) == []


def test_zip_gzip_pdf():
    import gzip
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a", "b")
    for content, kind in ((buffer.getvalue(), "application/zip"), (gzip.compress(b"x"), "application/gzip"), (b"%PDF-1.4 x %%EOF", "application/pdf")):
        assert media.objects(b"??" + content + b"..") == [(kind, 2, len(content))]


def pdf_update(before=b"%PDF-1.4\n", tail=b"\n"):
    return before + b"xref\n0 0\ntrailer <<>>\nstartxref\n" + str(len(before)).encode() + b"\n%%EOF" + tail


def test_whole_pdfs_and_zips(spark):
    import io
    import zipfile

    plain, updated = pdf_update(), pdf_update(pdf_update() + b"1 0 obj <<>> endobj\n", b"\r\n")
    linear = b"%PDF-1.4\n1 0 obj <<>> endobj\nxref\n0 0\nstartxref\n0\n%%EOF\n2 0 obj <<>> endobj\n"
    linear = pdf_update(linear)
    holding = pdf_update(b"%PDF-1.4\n1 0 obj stream\n" + plain + b"endstream endobj\n")
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a", "b")
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("c", "d")
    for content, kind in ((plain, "application/pdf"), (updated, "application/pdf"), (linear, "application/pdf"), (holding, "application/pdf"), (outer.getvalue(), "application/zip")):
        assert media.objects(b"??" + content + b"..") == [(kind, 2, len(content))]
        assert media.objects(content)[0] == (kind, 0, len(content))
        assert media.objects(b"?" + content + content) == [(kind, 1, len(content)), (kind, 1 + len(content), len(content))]
    df = spark.createDataFrame([(1, updated, "text/plain")], "doc_id long, content binary, declared_type string")
    (r,) = media.sniff(df).collect()
    assert (r["media_type"], r["corrected"], r["embedded"]) == ("application/pdf", True, [])


def test_sniff_and_carve(spark):
    carrier = media.store_bytes(b"before" + png() + b"after")
    rows = [(1, png(), "image/jpeg", "e"), (2, carrier, None, "e"), (3, b"plain", "text/plain", None), (4, None, "x", None), (5, b"", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, content binary, declared_type string, embedded string")
    got = {r["doc_id"]: (r["media_type"], r["corrected"], len(r["embedded"])) for r in media.sniff(df).collect()}
    assert got == {1: ("image/png", True, 0), 2: ("audio/wav", False, 1), 3: ("text/plain", False, 0), 4: (None, False, 0), 5: (media.UNKNOWN, False, 0)}
    (cut,) = media.carve(df).collect()
    assert cut["doc_id"] == 2 and bytes(cut["embedded"]) == png() and cut["embedded_type"] == "image/png"


def test_store_and_read_back(spark, docs, rows, none):
    out = media.read_back(media.store(docs))
    for r in out.collect():
        payload = (r["text"] or "").encode()
        payload = payload.ljust(max(64, -(-len(payload) // 64) * 64), b"\0")
        import hashlib

        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.read_samples(r["media"]) == payload and r["media_type"] == "audio/wav"
    assert out.count() == len(rows) and media.read_back(media.store(none)).count() == 0
    with pytest.raises(ValueError):
        media.read_samples(b"RIFFnothing")


def test_vectors_of_a_batch_do_not_depend_on_it():
    texts = ["the stone", None, "été", "a b c " * 50]
    whole, known = langid.vectors(pa.array(texts, pa.string()))
    assert known.tolist() == [True, False, True, True]
    for k, t in enumerate(texts):
        assert np.allclose(langid.vectors(pa.array([t], pa.string()))[0][0], whole[k], atol=1e-5)
