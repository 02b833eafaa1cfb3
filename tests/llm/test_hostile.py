"""Hot keys, long texts and texts built against hashes; each against brute force."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from quillon.llm import exchange, jaccard, lines, media, quality, suffixes, words

from .conftest import corpus
from .test_corpus import brute_bytes, brute_lines, shingle_sets
from .test_documents import brute_counts


def thue_morse(n, flip=0):
    return "".join("ab"[bin(k).count("1") % 2 ^ flip] for k in range(n))


MORSE = [(thue_morse(n), thue_morse(n, 1)) for n in (1024, 2048, 4096)]


@pytest.mark.parametrize("one, other", MORSE)
def test_words_and_lines_built_against_polynomial_hashes(spark, one, other):
    counts, _ = quality.statistics(pa.array([f"{one}\n{other}\n{one}", f"{one} x y {other} x y"]))
    assert [c.tolist() for c in counts] == [brute_counts(f"{one}\n{other}\n{one}"), brute_counts(f"{one} x y {other} x y")]
    (_, row, element), = jaccard.shingles(pa.array([one, other, one]))
    assert element[row == 0] == element[row == 2] != element[row == 1]
    w = lines.windows(pa.array([f"{one}\nb\nc", f"{other}\nb\nc", f"{one}\nb\nc"]))
    assert w[2][0] == w[2][2] != w[2][1] and w[3][0] == w[3][2] != w[3][1]


def test_removal_of_texts_built_against_polynomial_hashes(spark):
    rows = [(k, t) for k, t in enumerate(x for pair in MORSE for x in pair)] + [(9, MORSE[0][0][:500] + "x" + MORSE[0][1])]
    got = suffixes.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_bytes(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got} == want


def test_later_occurrences_of_a_hot_window_spread_over_the_targets():
    doc, tie = np.arange(1000, dtype=np.int64), np.full(1000, 7, np.int64)
    load = np.bincount(exchange.target_of(lines.home(doc, tie), 8), minlength=8)
    assert load.max() < 200


def test_hot_passage_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = [(k, f"own {k}\np q\nr s\nt u\nalso {k}") for k in range(400)]
        got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_lines(rows)
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got} == want


def by_brute_force(rows, n=5, t=(4, 5)):
    """doc_id -> (n_shingles, n_similar, component_id) of rows with distinct ids."""
    sets = shingle_sets(rows, n)
    root, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    seen = set()
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                pair = (min(a, b), max(a, b))
                if pair not in seen:
                    seen.add(pair)
                    if t[1] * len(sets[a] & sets[b]) >= t[0] * len(sets[a] | sets[b]):
                        links[a] += 1
                        links[b] += 1
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), links[d], find(d)) for d in sets}


def pairs_made(texts):
    """Candidate pairs of texts in one target."""
    (_, row, element), = jaccard.shingles(pa.array(texts))
    cls, key, owner, kind = jaccard._sketched(row, element, len(texts), jaccard.Bands())
    size = np.bincount(row, minlength=len(texts))
    table = np.zeros(len(texts), jaccard._CLASS)
    table["cls"], table["label"], table["size"] = cls, jaccard._labels(element, np.cumsum(size) - size), np.where(size <= jaccard.SMALL, size, 0)
    table["small"] = jaccard._small_parity(row, element, len(texts))
    left, right, large = jaccard._pairs_of_buckets(key, cls[owner], lambda x, y: jaccard._wanted(table[owner[x]], table[owner[y]], kind[x], kind[y], jaccard.Fraction(4, 5)))
    return len(left), large


def test_short_texts_with_one_footer_make_few_pairs(monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(jaccard, "BUCKET", 5000)
    monkeypatch.setattr(words, "CHUNK_BYTES", 1 << 30)
    monkeypatch.setattr(words.chunks, "__defaults__", (1 << 30,))
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(r.randint(8, 40))) + " all rights are reserved here" for _ in range(4000)]
    made, large = pairs_made(texts)
    assert made < 10_000 and not large


@pytest.mark.parametrize("bucket", [512, 8])
def test_near_copies_and_hot_passages(spark, monkeypatch, bucket):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    r = random.Random(bucket)
    word = lambda: f"w{r.randrange(3000)}"
    passage = " ".join(word() for _ in range(25))
    rows = []
    for size in (4, 12, 30, 90, 250):
        base = [word() for _ in range(size)]
        for _ in range(40):
            own = list(base)
            for _ in range(r.randrange(1 + size // 12)):
                own[r.randrange(size)] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, " ".join(word() for _ in range(r.randint(3, 200))) + " " + passage) for k in range(100)]
    got = {x["doc_id"]: tuple(x)[1:] for x in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = by_brute_force(rows)
    assert got == want and sum(v[1] for v in want.values()) > 1000


def test_nameless_rows_with_other_parameters(spark):
    a = "p q r s t u v w x y z"
    df = spark.createDataFrame([(None, a), (None, a + " zz"), (3, "x y")], "doc_id long, text string")
    got = sorted(((r["n_shingles"], r["n_similar"]) for r in jaccard.similar(df, n=3, t=jaccard.Fraction(7, 10)).collect()))
    assert got == [(1, 0), (9, 1), (10, 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("hot", [0, 3, 2000])
def test_bytes_of_several_corpora(spark, seed, hot):
    rows = corpus(seed, 90)
    got = suffixes.dedup_substrings(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(4), hot=hot).collect()
    want = brute_bytes(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == want[r["doc_id"]]


def test_a_long_text_in_pieces_and_a_hot_passage(spark, monkeypatch):
    r = random.Random(4)
    long = "".join(r.choice("abcdefgh \n") for _ in range(1_500_000))
    passage = "".join(r.choice("ijklmnop") for _ in range(90))
    rows = [(5, long), (6, "x" + long[100_000:100_300] + "y" + long[262_100:262_250] + "z" + long[-80:])]
    rows += [(10 + k, f"{r.random()}{passage}{r.random()}") for k in range(300)]
    want = brute_bytes(rows)
    for hot in (50, 2000):
        got = suffixes.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=hot).collect()
        assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in got} == want


def test_prose_whose_short_grams_all_repeat_is_hardly_sent(spark, monkeypatch):
    """Of these words nearly every 20-gram is in other documents too; what is exchanged must not follow it, nor grow as blocks times tasks."""
    made, write = {}, suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda df, name: made.setdefault(name, write(df, name)))
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7))) for _ in range(60)]
    rows = [(k, " ".join(r.choice(vocabulary) for _ in range(1000))) for k in range(400)]
    rows += [(1000 + k, f"{k} {rows[k][1][200:260]} {k}") for k in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = suffixes.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in got} == brute_bytes(rows)
    replies = [zstandard.decompress(x["reply"]) for x in made["first"].collect()]
    assert len(replies) <= 16
    assert sum(c > 0 for x in replies for c in x) < 0.1 * sum(map(len, replies))


def test_the_order_of_suffixes_survives_bad_hashes(monkeypatch):
    r = np.random.default_rng(3)
    data = r.choice(np.frombuffer(b"ab", np.uint8), 400)
    start = np.sort(r.integers(0, 390, 120))
    end, group = np.minimum(start + r.integers(1, 60, 120), 400), r.integers(0, 3, 120)
    monkeypatch.setattr(suffixes.Prefixes, "hash", lambda self, a, b: np.zeros(len(a), np.uint64))
    order, shared = suffixes.verified_order(suffixes.Prefixes(data), start, end, group)
    keys = [(group[k], data[start[k] : end[k]].tobytes()) for k in order]
    assert keys == sorted(keys)
    for (g, x), (h, y), n in zip(keys, keys[1:], shared.tolist()):
        assert n == (0 if g != h else next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))))


@pytest.mark.parametrize("signature", [b"%PDF-1.7 ", b"PK\x03\x04", b"\xff\xd8\xff\xda\x00\x02", b"\x1f\x8b\x08", b"BM", b"RIFF", b"GIF89a", b"GIF89a\0\0\0\0\0\0\0", b"\x89PNG\r\n\x1a\n", b"%PDF-1.7 startxref 0 %%EOF ", b"PK\x03\x04PK\x05\x06", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd"])
def test_sniffing_is_linear(signature):
    took = []
    for size in (1 << 20, 1 << 22):
        began = time.perf_counter()
        media.objects((signature * (size // len(signature)))[:size])
        took.append(time.perf_counter() - began)
    assert took[1] < 8 and took[1] < 12 * max(took[0], 0.05)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from quillon.llm.tables import shared_folder

    def session(master, folder=None):
        kept = {"spark.checkpoint.dir": folder}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: kept.get(k) or d, set=kept.__setitem__), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))
    one = session("local[4]")
    assert shared_folder(one) == shared_folder(one) and shared_folder(session("local"))
