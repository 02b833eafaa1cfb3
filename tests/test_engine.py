import json
import math
import time
import weakref

import pytest
from pyspark.sql import functions as F

from quillon import providers, service
from quillon.operators import articles, chunks, lines, questions, search, tables
from quillon.sources import env, files
from quillon.streaming import incremental


def laid_out(spark, rows):
    """rows: (page, text, size, y0)"""
    schema = "doc string, page int, line_no int, text string, size double, fonts array<string>, y0 double, y1 double, page_height double"
    return spark.createDataFrame([("code", p, n, t, s, ["Body"], y, y + 1, 100.0) for n, (p, t, s, y) in enumerate(rows)], schema)


CODE = [
    (1, "Recueil des textes législatifs", 8.0, 2.0),
    (1, "LIVRE PREMIER", 14.0, 20.0),
    (1, "DES DISPOSITIONS", 14.0, 22.0),
    (1, "TITRE I", 12.0, 24.0),
    (1, "CHAPITRE IX9", 11.0, 26.0),
    (1, "De la monnaie", 11.0, 28.0),
    (1, "Article premier", 10.0, 30.0),
    (1, "Le présent code fixe les règles.", 10.0, 32.0),
    (1, "31 - Dahir n° 5 du code", 10.0, 34.0),
    (1, "Article 2", 10.0, 36.0),
    (1, "Première phrase", 10.0, 38.0),
    (1, "3", 10.0, 96.0),
    (2, "Recueil des textes législatifs", 8.0, 2.0),
    (2, "suite du texte.", 10.0, 30.0),
    (2, "Article 2", 10.0, 31.0),
    (2, "bis : Un ajout.", 10.0, 32.0),
    (2, "TITRE II", 12.0, 33.0),
    (2, "Article 310", 10.0, 34.0),
    (2, "(modifié par la loi) Contenu trois.", 10.0, 35.0),
    (2, "Voir article", 10.0, 36.0),
    (2, "Article 4", 10.0, 37.0),
    (2, "Texte cité.", 10.0, 38.0),
    (2, "Article 5", 10.0, 39.0),
    (2, "Le cinquième. SOUS-SECTION Du crédit", 10.0, 40.0),
]


def test_articles(spark):
    got = [r.asDict() for r in articles.extract(laid_out(spark, CODE)).orderBy("pos").collect()]
    assert [g["article_number"] for g in got] == ["1", "2", "2bis", "3.10", "5"]
    first, second, third, fourth, fifth = got
    assert first["livre"] == "LIVRE PREMIER DES DISPOSITIONS" and first["titre"] == "TITRE I" and first["chapitre"] == "CHAPITRE IX De la monnaie"
    assert first["content"] == "Le présent code fixe les règles." and first["pages"] == "1"
    assert second["pages"] == "1-2" and second["content"] == "Première phrase suite du texte."
    assert third["content"] == "Un ajout." and third["titre"] == "TITRE I" and third["pages"] == "2"
    assert fourth["titre"] == "TITRE II" and fourth["chapitre"] == "" and fourth["content"].startswith("(modifié")
    assert fifth["content"] == "Le cinquième." and fifth["sous_section"] == ""


def test_articles_of_nothing(spark):
    empty = laid_out(spark, CODE).where("false")
    assert articles.extract(empty).count() == 0
    assert articles.extract(laid_out(spark, [(1, "no article here", 10.0, 50.0)])).count() == 0


def test_margins(spark):
    table = laid_out(spark, CODE)
    assert [tuple(r) for r in lines.recurring(table).select("zone", "times").collect()] == [("top", 2)]
    kept = {r["text"] for r in lines.drop_margins(table).collect()}
    assert "3" not in kept and "Recueil des textes législatifs" not in kept and "TITRE II" in kept
    assert lines.body_sizes(table).first()["body_size"] == 10.0
    assert lines.body_sizes(table.withColumn("size", F.lit(0.0))).first()["body_size"] == 12.0
    assert lines.first_pages(table, 1).count() == 12 and lines.first_pages(table).count() == len(CODE)


def test_assembly(spark):
    spans = "array<struct<text:string,size:double,font:string>>"
    df = spark.createDataFrame([(0, [("Ti", 9.0, "A"), ("tre", 11.0, "A-Bold")]), (0, [(" ", 3.0, "A")]), (1, [("image", 9.0, "A")])], f"block_type int, spans {spans}")
    (row,) = lines.assemble(df).collect()
    assert (row["text"], row["size"], row["fonts"]) == ("Titre", 11.0, ["A", "A-Bold"])


def fold(sentences, vectors, target, most, like):
    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    out, now, v = [], sentences[0], vectors[0]
    for s, w in zip(sentences[1:], vectors[1:]):
        if len(now) + 1 + len(s) > most or len(now) >= target and cos(v, w) < like:
            out.append(now)
            now, v = s, w
        else:
            now, v = f"{now} {s}", [(x + y) / 2 for x, y in zip(v, w)]
    return out + [now]


def test_packing_as_a_plain_fold(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40)
    p = chunks.Packing(250, 500, 0.6)
    from quillon.functions import text as X

    made = chunks.pack_by_meaning(docs, providers.embed_arrays(providers.HashingEmbedder()), "text", p)
    plain = chunks.pack_by_length(docs, "text", p, "by_length")
    rows = made.join(plain.select("doc_id", "by_length"), "doc_id").withColumn("s", X.sentences(X.strip("text"), p.max_chars)).collect()
    split = 0
    for r in rows:
        vectors = providers.HashingEmbedder().embed(r["s"])
        assert r["chunks"] == (fold(r["s"], vectors, 250, 500, 0.6) if r["s"] else [])
        assert r["by_length"] == (fold(r["s"], [[1.0]] * len(r["s"]), 250, 500, 0.0) if r["s"] else [])
        assert " ".join(r["chunks"]) == " ".join(r["s"]) and all(len(c) <= 500 for c in r["chunks"])
        split += len(r["chunks"]) > len(r["by_length"])
    assert split


def test_vectors_are_made_as_they_are_packed(spark):
    """a provider is asked for one batch at a time, and of the vectors taken only the running mean is kept."""
    asked, alive, most = [], weakref.WeakSet(), 0

    class Vector(list):
        __hash__ = object.__hash__

    class Counting:
        def embed(self, texts):
            asked.append(len(texts))
            return [[1.0, float(len(asked))] for _ in texts]

    def made():
        nonlocal most
        for k in range(300):
            alive.add(v := Vector([1.0, float(k)]))
            most = max(most, len(alive))
            yield v

    stream = providers.embed_arrays(Counting()).stream(["x"] * 100)
    assert asked == [] and next(stream) and asked == [16] and len(list(stream)) == 99 and asked == [16] * 6 + [4]
    assert sum(chunks._bounds([400] * 300, made(), chunks.Packing())) == 300 and most <= 3


def test_articles_before_many_headings_are_not_walked_through():
    """an article's end is looked up; a walk through the headings after it made long documents quadratic."""
    rows = [(k // 40 + 1, f"Article {k + 1} mot", None, None, None, None) for k in range(15_000)]
    rows += [(k // 40 + 400, f"Section {k}", "section", None, None, None) for k in range(15_000)]
    began = time.time()
    got = articles.articles_of(rows)
    assert len(got) == 15_000 and got[-1]["content"] == "mot" and got[-1]["section"] == "" and time.time() - began < 4


def test_chunk_records(spark):
    df = spark.createDataFrame([("7", ["a", "b"]), ("", ["c"]), (None, [])], "article_number string, chunks array<string>")
    got = [(r["chunk_id"], r["chunk_index"], r["chunk_count"], r["content"]) for r in chunks.records(df).collect()]
    assert sorted(got) == [("7_001", 1, 2, "a"), ("7_002", 2, 2, "b"), ("unknown_001", 1, 1, "c")]
    assert chunks.Packing(1, 1, 7.0, 0, -2).clamped() == chunks.Packing(200, 300, 1.0, 1, 0)


def test_group_numbers(spark):
    rows = [(0, "2", "x"), (1, "1", "x"), (2, "2", "x"), (3, None, "y"), (4, "", "y"), (5, "1", "z 12 –"), (6, "1", " 3 -")]
    df = spark.createDataFrame([("f", *r) for r in rows], "file string, pos int, article_number string, content string")
    got = {r["pos"]: r["chunk_id"] for r in tables.clean_chunks(df, "file", "pos").collect()}
    assert got == {0: "2_001_g001", 1: "1_001_g002", 2: "2_002_g001", 3: "unknown_001_g003", 4: "unknown_002_g003", 5: "1_002_g002"}


def test_search(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [1.0, 1.0])]
    df = spark.createDataFrame([("f", *r) for r in rows], "source_file string, pos int, embedding array<float>")
    got = [(r["pos"], round(r["similarity"], 3), r["closeness_label"]) for r in search.search(df, [2.0, 0.0], 3, 0.0).collect()]
    assert got == [(0, 1.0, "very-close"), (1, 1.0, "very-close"), (8, 0.707, "very-close")]
    assert "TakeOrderedAndProject" in search.search(df, [2.0, 0.0], 3)._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        search.search(df, [1.0], 0)
    best = search.nearest(df.withColumn("vec_id", F.col("pos").cast("long")), df.withColumn("vec_id", F.col("pos").cast("long")).where("pos < 3"), 2, same=True, block=2)
    assert {(r["query_id"], r["vec_id"]) for r in best.where("rank = 1").collect()} == {(0, 1), (1, 0), (2, 8)}


@pytest.mark.parametrize("kw", [{"query": " "}, {"top_k": 0}, {"threshold": 1.5}, {"threshold": float("nan")}, {"close_filter": ""}, {"verify_top_n": 0}])
def test_requests_are_checked(kw):
    with pytest.raises(ValueError):
        search.checked(**({"query": "q"} | kw))
    assert search.checked("q", threshold=0.4, close_filter=" LOOSE ") == 0.4


def test_relevance_and_judging(spark):
    hits = spark.createDataFrame([(1,), (2,), (3,)], "rank int")
    items = spark.createDataFrame([(0, 0, True, "2", "r" * 300), (1, 0, False, "0.4", "later"), (2, 1, True, "x", None), (3, None, True, "1", "")], "pos int, index int, is_relevant boolean, score string, reason string")
    got = {r["rank"]: (r["ai_is_relevant"], r["ai_relevance_score"], r["ai_reason"]) for r in search.judged(hits, items, 2).collect()}
    assert got == {1: (False, 0.4, "later"), 2: (True, 0.0, ""), 3: (None, None, None)}
    said = spark.createDataFrame([("a", True, None), ("a", True, None), ("b", False, " High "), ("c", True, None), ("c", False, "no")], "k string, is_relevant boolean, word string")
    assert {r["k"]: r["overall"] for r in search.relevance(said, ["k"], "word").collect()} == {"a": "high", "b": "high", "c": "medium"}


def test_questions(spark):
    rows = [(1, 0, " Quoi ? "), (1, 1, "quoi ?"), (1, 2, ""), (1, 3, None), (1, 4, "STRASSE"), (1, 5, "straße"), (2, 0, "x"), (2, 1, "y"), (2, 2, "z")]
    df = spark.createDataFrame(rows, "k int, turn int, q string")
    sets = questions.merge_unique(df, "k", "q", "turn", 2)
    assert {r["k"]: r["questions"] for r in sets.collect()} == {1: ["Quoi ?", "STRASSE"], 2: ["x", "y"]}
    assert questions.wide(sets.where("k = 2"), 3).first().asDict() == {"k": 2, "question_1": "x", "question_2": "y", "question_3": ""}
    assert questions.target(30, 10, 100, 200) == 20 and questions.target(12, 10, 100, 200) == 12
    for bad in ((9, 10, 100, 200), (30, 300, 0, 200)):
        with pytest.raises(ValueError):
            questions.target(*bad)
    ids = sets.select(F.col("k").alias("article_id"), "questions")
    assert [r["status"] for r in (questions.summary(ids, "f", "m", 2, 5, 4).first(), questions.summary(ids, "f", "m", 2, 5, 6).first())] == ["completed", "stopped"]


class Flaky:
    def __init__(self, fail, message="503 unavailable"):
        self.fail, self.message, self.calls = fail, message, 0

    def embed(self, texts):
        self.calls += 1
        if self.calls <= self.fail or len(texts) > 1 and "bad" in texts or texts == ["bad"]:
            raise RuntimeError(self.message if "bad" not in texts else "no such text")
        return [[float(len(t))] for t in texts]


def test_embedding_falls_back_to_single_texts():
    waits = []
    assert providers.embed_batch(Flaky(2), ["a", None, " ", "bb"], sleep=waits.append) == [([1.0], None), (None, None), (None, None), ([2.0], None)]
    assert len(waits) == 2 and 1 <= waits[0] <= 1.35 and 2 <= waits[1] <= 2.35
    got = providers.embed_batch(Flaky(0), ["a", "bad", "ccc"], sleep=waits.append)
    assert got[0] == ([1.0], None) and got[1] == (None, "no such text") and got[2] == ([3.0], None)


def test_rate_limits():
    waits, left = [], [providers.RateLimited("429"), providers.RateLimited("429", 500.0), RuntimeError("x")]

    def call():
        if left:
            raise left.pop(0)
        return "done"

    assert providers.rate_limited(call, 5, waits.append) == "done" and waits == [2.0, 60.0, 2]
    with pytest.raises(providers.ModelNotFound):
        providers.rate_limited(lambda: (_ for _ in ()).throw(providers.ModelNotFound("m")), 5, waits.append)


@pytest.mark.parametrize("said", ['{"a": "b"}', '```json\n{"a": "b"}\n```', 'Here you are: {"a": "b"} !', '  {"a": "b"}\n'])
def test_reading_objects(said):
    assert providers.read_object(said) == {"a": "b"}


def test_repairing_escapes():
    assert providers.read_object('{"a": "\\l \\\\ \\u00e9 \\u12 \\"x"}') == {"a": "\\l \\ é \\u12 \"x"}
    assert providers.repair_escapes('\\x {"a\\') == '\\x {"a\\\\'
    with pytest.raises(ValueError):
        providers.read_object("[1]")


class Says:
    def __init__(self, *answers):
        self.answers = list(answers)

    def complete(self, prompt):
        return self.answers.pop(0)


def test_asking_questions():
    q = lambda *x: json.dumps({"questions": list(x)})
    assert providers.ask_questions(Says(q("a", "A", "b"), q("c", "d")), {}, 3) == ["a", "b", "c"]
    assert providers.ask_questions(Says(q("a"), q("a"), q("b"), q("b"), q("c"), q("c")), {}, 3, 3, lambda s: None) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        providers.ask_questions(Says(q("a"), q("a"), q("a"), q("a")), {}, 3, 2, lambda s: None)


def test_json_arrays(spark, tmp_path):
    (tmp_path / "a_embedded.json").write_text("﻿" + json.dumps([{"article_number": "1", "embedding": [1, 0], "extra": {"x": 1}}, {"article_number": "2", "embedding": {"values": [0, 1]}}, {"embedding": [["values", [1, 1]]]}, 5, {"article_number": "4"}]), "utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.json").write_text("[]")
    rows = files.embedded_corpus(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["pos"], r["article_number"], r["embedding"]) for r in rows] == [(0, "1", [1.0, 0.0]), (1, "2", [0.0, 1.0]), (2, None, [1.0, 1.0]), (4, "4", None)]
    assert rows[0]["embedded_file"] == "a_embedded.json"
    with pytest.raises(Exception, match="not an object"):
        files.json_items(spark, str(tmp_path / "a_embedded.json")).collect()
    (tmp_path / "c.json").write_text("{}")
    with pytest.raises(Exception, match="not a JSON array"):
        files.json_items(spark, str(tmp_path / "c.json"), strict=False).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f", 1, "b é", 'say "x"'), ("f", 0, "a", None)], "file string, pos int, document_name string, content string")
    files.csv(df.coalesce(1), str(tmp_path / "csv"), ("document_name", "content"))
    (part,) = (tmp_path / "csv").glob("*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfdocument_name,content") and '"say ""x"""' in part.read_text("utf-8-sig")
    files.json_document(df, str(tmp_path / "doc"), "file", "pos")
    (part,) = (tmp_path / "doc").rglob("*.txt")
    assert json.loads(part.read_text("utf-8")) == [{"document_name": "a", "content": None}, {"document_name": "b é", "content": 'say "x"'}]
    files.json_lines(df, str(tmp_path / "lines"), "pos")
    assert {p.parent.name for p in (tmp_path / "lines").rglob("*.json")} == {"pos=0", "pos=1"}


def test_env(tmp_path):
    (tmp_path / ".env").write_text("# no\nA='1'\nB = two\nGEMINI_API_KEY=k\nbroken\n")
    own = {"B": "kept"}
    assert env.load(tmp_path / ".env", own) == {"A": "1", "B": "two", "GEMINI_API_KEY": "k"} and own["B"] == "kept"
    assert env.api_key(None, own) == "k" and env.api_key("given", own) == "given" and env.load(tmp_path / "none", own) == {}


def test_backfill_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate(["a b", "", "c", None, "d"])], "source_file string, pos int, content string")
    store = str(tmp_path / "store")
    assert incremental.backfill(spark, rows.where("pos < 3"), store, providers.HashingEmbedder()) == 0
    assert incremental.backfill(spark, rows, store, providers.HashingEmbedder()) == 0
    assert sorted(r["pos"] for r in spark.read.parquet(store).collect()) == [0, 2, 4]
    joined = rows.join(spark.read.parquet(store).drop("content"), ["source_file", "pos"], "left")
    assert tuple(incremental.counts(joined).first()) == (3, 2)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    incremental.follow(stream, str(tmp_path / "out"), str(tmp_path / "check"), providers.HashingEmbedder()).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert incremental.settings({"a": 0, "b": None}, {"b": 2, "c": 3}, {"a": 1, "b": 1, "c": 1, "d": 4}) == {"a": 0, "b": 2, "c": 3, "d": 4}
    named = spark.createDataFrame([("x_000002.json",), ("x_000010.json",), ("odd.json",)], "path string")
    assert incremental.latest(named).first().asDict() == {"path": "x_000010.json", "number": 10}


def test_service(spark, tmp_path):
    items = [{"article_number": str(k), "content": t, "embedding": providers.HashingEmbedder().embed([t])[0]} for k, t in enumerate(["le droit du travail", "la monnaie", "le droit"])]
    (tmp_path / "x_embedded.json").write_text(json.dumps(items))
    verdict = json.dumps({"overall": "?", "items": [{"index": 0, "is_relevant": True, "score": 7, "reason": "r"}]})
    engine = service.Engine(files.embedded_corpus(spark, str(tmp_path)), providers.HashingEmbedder(), "src", Says(verdict))
    status, out = service.respond(engine, "GET", "/search?query=le+droit&top_k=2&close_filter=")
    assert status == 200 and [r["article_number"] for r in out["results"]] == ["2", "0"] and out["close_filter"] == "balanced" and out["top_similarity"] > 0.99
    status, out = service.respond(engine, "POST", "/search?top_k=1", json.dumps({"query": "le droit", "top_k": 3, "verify_results": "yes", "verify_top_n": 1}).encode())
    assert status == 200 and out["top_k"] == 3 and out["ai_verification"]["overall"] == "high" and out["results"][0]["ai_relevance_score"] == 1.0
    assert service.respond(engine, "GET", "/search")[0] == service.respond(engine, "POST", "/search", b"[]")[0] == 400
    assert service.respond(engine, "POST", "/search", b'{"query": "q", "top_k": null}')[0] == 500
    assert service.respond(engine, "GET", "/nope")[0] == 404 and service.respond(engine, "GET", "/health")[1]["file_count"] == 1
