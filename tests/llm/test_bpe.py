import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "a \n b", "\n\n", "tab\tand\r\nfeed", "it's we'll", "été naïve ²³ x²", "日本語 テキスト", "😀 a", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "x" * 3000, "12345 1,000", "\x1c a \x85b\xa0c", "ſ Ⅷ ½", "end. ", "«\xa0oui\xa0»"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    for coder in (bpe.opened(PATH), bpe.opened_fast(PATH)):
        got = memoryview(coder.encode(text)).cast("I").tolist() if text else []
        assert got == want, text
    assert bpe.opened(PATH).count(text) == len(want)
    assert bpe.opened(PATH).decode(want) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_as_the_library(library, text):
    same(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcéÉñ 's\n\t.,!1²日€\xa0|<>endoftx"), max_size=60))
def test_any_text_as_the_library(library, text):
    same(library, text)


def test_broken_utf8_decodes_as_the_library(library):
    ids = library.encode("日本😀", add_special_tokens=False).ids
    for cut in range(1, len(ids)):
        assert bpe.opened(PATH).decode(ids[:cut]) == library.decode(ids[:cut], skip_special_tokens=False)


def test_columns(spark, docs, rows, none, library):
    wide = docs.withColumnRenamed("lang", "n_tokens")
    out = bpe.decode(bpe.encode(wide, PATH), PATH)
    assert out.columns.count("n_tokens") == 1 and set(docs.columns) - {"lang"} <= set(out.columns)
    for r in out.collect():
        assert r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
    assert out.count() == len(rows)
    assert bpe.encode(none, PATH).count() == bpe.count_tokens(none, PATH).count() == 0
    counted = {(r["doc_id"], r["n_tokens"], r["over_limit"]) for r in bpe.count_tokens(docs, PATH, 20).collect()}
    assert counted == {(r["doc_id"], r["n_tokens"], r["n_tokens"] > 20) for r in out.collect()}
    arrays = bpe.encode(docs, PATH).select("n_tokens", bpe.ids_array("ids").alias("a")).collect()
    assert all(len(r["a"]) == r["n_tokens"] for r in arrays)


def test_memo_overflow_changes_nothing(library):
    small = bpe.ByteBpe(PATH, memo=3)
    for text in ("one two three four five one two", "six seven, eight."):
        assert memoryview(small.encode(text)).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
def test_plan_uses_every_piece_once_and_few_bins(histogram):
    bins = packing.plan(histogram, 64)
    used = {}
    for items, times in bins:
        assert sum(items) <= 64 and times > 0
        assert sum(3 * n > 64 for n in items) <= 2
        for n in items:
            used[n] = used.get(n, 0) + times
    assert used == histogram
    least = max(-(-sum(n * c for n, c in histogram.items()) // 64), sum(c for n, c in histogram.items() if n > 32))
    assert sum(t for _, t in bins) <= max(least + 1, 1.7 * least)


def test_packing(spark, docs, rows, none, library):
    from zlib import crc32

    packed = packing.pack(docs, PATH, capacity=32, keep_ids=True)
    got = packed.collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] <= 128
    texts = {r[0]: r[1] or "" for r in rows}
    repeated = rows[-1][0]
    for doc, text in texts.items():
        want = library.encode(text, add_special_tokens=False).ids + [0]
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        own = own[:: 2 if doc == repeated else 1]
        assert sum(r["length"] for r in own) == len(want)
        assert b"".join(bytes(r["ids"]) for r in own) == b"".join(i.to_bytes(4, "little") for i in want)
        assert all(r["length"] == 32 for r in own[1:]) and own[0]["start"] == 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 32
    whole = packing.sequences(packed).collect()
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in got) and all(len(r["ids"]) == 4 * r["length"] for r in whole)
    assert packing.pack(none, PATH).count() == 0


def test_many_salts_give_the_same_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 7)
    df = spark.createDataFrame([(i, 0, 5 + i % 3) for i in range(100)], "doc_id long, piece int, length long")
    got = packing.place(df, 16).collect()
    assert len(got) == 100 and len({(r["sequence_id"], r["offset"]) for r in got}) == 100
