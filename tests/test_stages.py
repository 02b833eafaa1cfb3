"""Stages from the command line, remote providers, stops, and stores that can be taken up again."""

import json

import pytest

from quillon import providers, remote, service, stages
from quillon.operators import questions
from quillon.sources import files
from quillon.streaming import incremental


def sends(*answers):
    left, seen = list(answers), []

    def send(url, headers, body, timeout):
        seen.append((url, headers, json.loads(body) if body else None, timeout))
        return left.pop(0)

    return send, seen


def test_http_embedder():
    rows = {"data": [{"index": 1, "embedding": [0, 1]}, {"index": 0, "embedding": [1, 0]}]}
    send, seen = sends((200, {}, json.dumps(rows).encode()))
    assert remote.HttpEmbedder("http://x/v1/", "m", "k", send=send).embed(["a", "b"]) == [[1.0, 0.0], [0.0, 1.0]]
    assert seen[0][0] == "http://x/v1/embeddings" and seen[0][1]["Authorization"] == "Bearer k" and seen[0][2] == {"model": "m", "input": ["a", "b"]}
    with pytest.raises(ValueError):
        remote.HttpEmbedder("u", "m", send=sends((200, {}, b'{"data": []}'))[0]).embed(["a"])


def test_http_chat_and_what_a_status_means():
    said = {"choices": [{"message": {"content": "hello"}}]}
    send, seen = sends((200, {}, json.dumps(said).encode()))
    assert remote.HttpChat("http://x", "m", send=send).complete("p") == "hello" and seen[0][2]["temperature"] == 0.2 and seen[0][3] == 120
    for status in (401, 403):
        with pytest.raises(providers.OutOfCredits):
            remote.HttpChat("u", "m", send=sends((status, {}, b"no"))[0]).complete("p")
    listed = json.dumps({"data": [{"id": "one"}, {"id": "two"}]}).encode()
    with pytest.raises(providers.ModelNotFound, match="one, two"):
        remote.HttpChat("u", "m", send=sends((404, {}, b""), (200, {}, listed))[0]).complete("p")
    with pytest.raises(providers.RateLimited) as caught:
        remote.HttpChat("u", "m", send=sends((429, {"retry-after": "7"}, b"slow"))[0]).complete("p")
    assert caught.value.retry_after == 7.0
    with pytest.raises(RuntimeError, match="503"):
        remote.HttpChat("u", "m", send=sends((503, {}, b"busy"))[0]).complete("p")


def test_providers_by_name():
    assert isinstance(remote.provider("quillon.providers:HashingEmbedder"), providers.HashingEmbedder)
    made = remote.provider("quillon.remote:HttpChat", url="http://x", model="m", key="")
    assert (made.url, made.model, made.key) == ("http://x", "m", "")
    with pytest.raises(ValueError):
        remote.provider("nothing")


class StopsAt:
    """Answers until an article whose content is ``word``."""

    def __init__(self, word, error=providers.OutOfCredits):
        self.word, self.error = word, error

    def complete(self, prompt):
        if self.word and f'"{self.word}"' in prompt:
            raise self.error("no more")
        return json.dumps({"questions": ["a", "b"]})


def test_a_stop_keeps_what_is_done_and_can_be_taken_up(spark, tmp_path):
    rows = spark.createDataFrame([(k, 10 + k, f"text{k}") for k in range(7)], "pos int, id long, content string")
    store = str(tmp_path / "q")
    said = questions.run(spark, rows, store, StopsAt("text5"), 2, chunk=3)
    assert said["status"] == "stopped" and "OutOfCredits" in said["stopped_reason"] and 4 <= said["total_articles"] <= 6
    answers = spark.read.parquet(f"{store}/answers")
    good = {r["article_id"] for r in answers.where("questions is not null").collect()}
    assert {10, 11, 12} <= good and 15 not in good
    questions.batch_files(answers, str(tmp_path / "batches"))
    assert {p.name for p in (tmp_path / "batches").glob("batch=*")} == {"batch=001"}
    said = questions.run(spark, rows, store, StopsAt(None), 2, chunk=3)
    assert said == {"status": "completed", "stopped_reason": "", "total_articles": 7}
    answers = spark.read.parquet(f"{store}/answers").where("questions is not null")
    assert answers.count() == answers.select("article_id").distinct().count() == 7


def test_a_budget_counts_articles_with_questions(spark, tmp_path):
    rows = spark.createDataFrame([(k, k, f"text{k}") for k in range(6)], "pos int, id long, content string")
    said = questions.run(spark, rows, str(tmp_path / "q"), StopsAt("text1", KeyError), 2, chunk=2, most=3, attempts=1)
    assert said == {"status": "completed", "stopped_reason": "", "total_articles": 3}
    got = spark.read.parquet(str(tmp_path / "q/answers"))
    assert {r["article_id"] for r in got.where("questions is not null").collect()} == {0, 2, 3}


def test_blank_texts_are_no_failures_and_a_batch_tried_again_writes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("f", 0, "a"), ("f", 1, "\n\t"), ("f", 2, " "), ("f", 3, "b"), ("f", 3, "b")], "source_file string, pos int, content string")
    store = str(tmp_path / "store")
    assert incremental.backfill(spark, rows.where("pos < 3"), store, providers.HashingEmbedder()) == 0
    assert [r["pos"] for r in spark.read.parquet(store).collect()] == [0]
    rows.write.parquet(str(tmp_path / "in"))
    for check in ("one", "two"):  # a second stream over the same files, as after a lost checkpoint
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        incremental.follow(stream, store, str(tmp_path / check), providers.HashingEmbedder()).awaitTermination()
    assert sorted(r["pos"] for r in spark.read.parquet(store).collect()) == [0, 3]

    class Fails:
        def embed(self, texts):
            raise ValueError("no")

    assert incremental.backfill(spark, rows.withColumn("pos", rows["pos"] + 10), store, Fails()) == 3


def laid_out(spark):
    rows = []
    for k, text in enumerate(["Titre premier", "Article 1", "Le premier texte dit ceci.", "Article 2", "Le second texte dit cela."]):
        rows.append(("doc", 1, k, text, 10.0, ["Body"], 300.0 + 10 * k, 308.0 + 10 * k, 1000.0))
    return spark.createDataFrame(rows, "doc string, page int, line_no int, text string, size double, fonts array<string>, y0 double, y1 double, page_height double")


def test_stages_from_lines_to_questions(spark, tmp_path, capsys):
    laid_out(spark).write.parquet(str(tmp_path / "lines"))
    run = lambda *a: stages.main([str(x) for x in a])
    run("extract", tmp_path / "lines", tmp_path / "articles", "--pages", 3)
    (folder,) = (tmp_path / "articles").glob("file=*")
    assert folder.name == "file=doc_first_3p_articles.json"
    (part,) = folder.glob("*.txt")
    made = tmp_path / "made"
    made.mkdir()
    (made / "doc_first_3p_articles.json").write_text(part.read_text())
    assert [r["article_number"] for r in files.fields(files.articles_with_ids(spark, str(made))).collect()] == ["1", "2"]
    run("ids", made, tmp_path / "ids", "--pattern", "*_articles.json")
    (folder,) = (tmp_path / "ids" / "json").glob("file=*")
    assert folder.name == "file=doc_first_3p_with_ids.json"
    (part,) = folder.glob("*.txt")
    with_ids = tmp_path / "with"
    with_ids.mkdir()
    (with_ids / "doc_with_ids.json").write_text(part.read_text())
    assert [i["id"] for i in json.loads(part.read_text())] == [1, 2]
    assert next((tmp_path / "ids" / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfid,")
    run("chunk", with_ids, tmp_path / "chunks")
    got = spark.read.json(str(tmp_path / "chunks")).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in got] == ["1_001_g001", "2_001_g002"] and got[0]["titre"] == "Titre premier"
    for stage in ("embed", "backfill"):
        run(stage, with_ids, tmp_path / "store")
        assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"failed": 0, "stored": 2}
    run("questions", with_ids, tmp_path / "asked", "--least", 20, "--per-article", 10)
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["total_articles"] == 2
    (row,) = spark.read.json(str(tmp_path / "asked" / "summary")).collect()
    assert row["status"] == "completed" and len(row["articles"]) == 2


def test_a_union_of_columns(spark, tmp_path):
    files.union_csv([spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, "y")], "a int, c string")], str(tmp_path / "u"))
    text = "".join(p.read_text("utf-8-sig") for p in sorted((tmp_path / "u").glob("*.csv")))
    assert "a,b,c" in text and "1,x," in text and "2,,y" in text.replace('""', "")


def test_search_with_a_named_provider(spark, tmp_path, capsys):
    items = [{"article_number": str(k), "content": t, "embedding": providers.HashingEmbedder().embed([t])[0]} for k, t in enumerate(["le droit", "la monnaie"])]
    (tmp_path / "x_embedded.json").write_text(json.dumps(items))
    service.main([str(tmp_path), "-q", "la monnaie", "-k", "1", "--provider", "quillon.providers:HashingEmbedder"])
    assert "la monnaie" in capsys.readouterr().out


def test_pdf_pages_become_lines(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "fitz.py").write_text(
        "class Rect:\n    height = 800.0\n\n\nclass Page:\n    rect = Rect()\n    def __init__(self, n): self.n = n\n"
        "    def get_text(self, kind):\n        span = {'text': f'page {self.n}', 'size': 10.0, 'font': 'Bold'}\n"
        "        return {'blocks': [{'type': 0, 'lines': [{'bbox': (0, 10, 50, 20), 'spans': [span, dict(span, text=' more')]}]}, {'type': 1}]}\n\n\n"
        "class open:\n    def __init__(self, stream, filetype): self.pages = [Page(1), Page(2), Page(3)]\n"
        "    def __enter__(self): return self.pages\n    def __exit__(self, *a): pass\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "lib" / "fitz.py"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    from quillon.operators import lines
    from quillon.sources import pdf

    got = lines.assemble(pdf.read(spark, str(tmp_path), 2)).orderBy("page").collect()
    assert [(r["doc"], r["page"], r["text"], r["size"], r["page_height"]) for r in got] == [("b", 1, "page 1 more", 10.0, 800.0), ("b", 2, "page 2 more", 10.0, 800.0)]


def test_a_missing_source_and_the_page(spark, tmp_path):
    import threading
    import urllib.request
    from http.server import ThreadingHTTPServer

    engine = service.Engine.at(spark, str(tmp_path / "none"), providers.HashingEmbedder())
    assert service.respond(engine, "GET", "/health")[1]["file_count"] == 0
    assert service.respond(engine, "GET", "/search?query=x")[0] == 500
    server = ThreadingHTTPServer(("127.0.0.1", 0), service.handler(engine))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/ui", timeout=10) as answer:
            assert answer.headers["Content-Type"].startswith("text/html") and b"<form>" in answer.read()
    finally:
        server.shutdown()


@pytest.mark.parametrize("limit", [0, 1 << 62])
def test_numbers_in_slices(spark, monkeypatch, limit):
    from quillon.operators import tables

    monkeypatch.setattr(tables, "ONE_TASK", limit)
    rows = [("hot", k * 7 % 1000) for k in range(1000)] + [(None, k) for k in range(5)] + [("a", 3), ("a", None), ("b", 1)]
    df = spark.createDataFrame(rows, "g string, o int").repartition(4)
    got = sorted(((r["g"] or "", r["o"] if r["o"] is not None else -1, r["n"]) for r in tables.numbered(df, ["g"], ["o"], "n").collect()))
    want = []
    for g in {r[0] for r in rows}:
        own = sorted(-1 if o is None else o for h, o in rows if h == g)
        want += [(g or "", o, k) for k, o in enumerate(own, 1)]
    assert got == sorted(want)
    named = tables.numbered(df.selectExpr("g", "cast(o as string) o"), ["g"], ["o"], "n")
    assert named.where("g = 'hot'").agg({"n": "max"}).first()[0] == 1000
    assert tables.numbered(df.where("1 = 0"), ["g"], ["o"], "n").count() == 0


def test_a_table_of_one_row_group_is_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    (path,) = one.inputFiles()
    assert files.row_groups(spark, [path]) == 1
    spread = files.spread(one, "id")
    assert spread.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread.count() == 100
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert files.spread(many) is many
    made = spark.range(3)
    assert files.spread(made) is made
