"""Operators that compare documents, against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import jaccard, lines, suffixes
from quillon.llm.components import components


def brute_lines(rows):
    seen, out = {}, {}
    ordered = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: r[0])
    for doc, text in ordered:
        parts = text.split("\n")
        gone = set()
        for k in range(len(parts) - 2):
            w = tuple(parts[k : k + 3])
            if not re.search(r"[^ \t-\r]", "\n".join(w)):
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.setdefault(w, doc)
        out[doc] = ("\n".join(p for k, p in enumerate(parts) if k not in gone), len(parts), len(gone))
    return out


def test_lines(docs, rows, none):
    out = lines.dedup_lines(docs.withColumnRenamed("lang", "n_lines"))
    got, want = out.collect(), brute_lines(rows)
    assert len(got) == len(rows) and out.columns.count("n_lines") == 1
    for r in got:
        assert (r["text"], r["n_lines"], r["n_removed"]) == want.get(r["doc_id"], (None, 0, 0))
    assert sum(r["n_removed"] for r in got) > 0
    assert lines.dedup_lines(none).count() == 0


def test_lines_with_null_ids(spark):
    text = "a\nb\nc\nd"
    df = spark.createDataFrame([(None, text), (1, text), (2, "x\n" + text)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert got == {None: text, 1: "", 2: "x"}


def shingle_sets(rows, n=5):
    sets = {}
    for r in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or ""))
        sets[r[0]] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return sets


def test_jaccard(docs, rows, none):
    rows = rows[:-1]
    sets = shingle_sets(rows)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard.similar(docs.dropDuplicates(["doc_id"])).collect()}
    assert got == {d: (len(sets[d]), links[d], find(d)) for d in sets} and sum(links.values()) > 0
    assert jaccard.similar(none).count() == 0


def test_jaccard_of_repeated_and_nameless_rows(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "p q r s t u v w x y z a b c d e f g h i j k l m n o"), (None, "p q r s t u v w x y z a b c d e f g h i j k l m n oo")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_similar"], r["component_id"]) for r in jaccard.similar(df).collect()), key=str)
    assert got == [(0, 1, None), (0, 1, None), (0, 2, 1), (1, 2, 1), (1, 2, 1)]


def test_jaccard_of_one_id_with_different_texts(spark):
    base = {p: " ".join(f"{p}{k}" for k in range(40)) for p in "abcd"}
    rows = [(1, base["a"]), (1, base["b"]), (1, base["c"]), (2, base["a"] + " x"), (3, base["b"] + " x"), (4, base["c"] + " x"), (5, base["d"])]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = sorted((r["doc_id"], r["n_similar"], r["component_id"]) for r in jaccard.similar(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect())
        assert got == [(1, 1, 1)] * 3 + [(2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 0, 5)]


def test_only_the_set_of_a_class_counts_as_it():
    r = np.random.default_rng(2)
    a, b = (np.unique(r.integers(1, 1 << 63, 50, dtype=np.uint64)) for _ in range(2))
    cls, _, _ = jaccard.sketches(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2, jaccard.Bands())
    signed = cls.view(np.int64).tolist()
    assert [[jaccard._same_class(x, c) for x in (a, b)] for c in signed] == [[True, False], [False, True]]


@pytest.mark.parametrize("seed", range(4))
def test_sketches_lose_no_similar_pair(seed):
    """Every pair of sets at or above the threshold shares as many blocks as its classes ask for."""
    r = np.random.default_rng(seed)
    bands = jaccard.Bands()
    sets = []
    for size in r.integers(1, 400, 60):
        base = np.unique(r.integers(1, 1 << 63, size, dtype=np.uint64))
        sets.append(base)
        for _ in range(2):
            drop = r.random(len(base)) > r.choice([0.02, 0.1, 0.18])
            more = r.integers(1, 1 << 63, r.integers(0, 1 + len(base) // 8), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[drop], more])))
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cls, key, owner = jaccard.sketches(row, np.concatenate(sets), len(sets), bands)
    keys = {int(c): set(key[owner == c].tolist()) for c in set(owner.tolist())}
    similar = 0
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if len(sets[i]) and len(sets[j]) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and cls[i] != cls[j]:
                similar += 1
                need = min(int(cls[i]) & 15, int(cls[j]) & 15)
                assert len(keys[int(cls[i])] & keys[int(cls[j])]) >= need
    assert similar > 20


def test_parity_is_a_lower_bound():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(1, 1 << 63, 300, dtype=np.uint64))
    for keep in (0.5, 0.8, 1.0):
        b = a[r.random(len(a)) <= keep]
        x, y = (np.frombuffer(jaccard._parity(s), "<u8")[1:] for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a) - len(b)


def test_a_narrower_sketch_is_a_folded_one():
    r = np.random.default_rng(4)
    a, b = (np.unique(r.integers(1, 1 << 63, n, dtype=np.uint64)) for n in (3000, 700))
    wide, narrow = (np.frombuffer(jaccard._parity(a, bits), "<u8") for bits in (8192, 2048))
    assert jaccard._width(3000) == 8192 and jaccard._width(700) == 2048 and jaccard._width(1) == jaccard._width(512) == 1024
    assert jaccard._folded(wide, 32).tolist() == narrow.tolist()
    one, other = jaccard._parity(a, 8192), jaccard._parity(b, 2048)
    more = np.append(a[30:], r.integers(1, 1 << 63, 1500, dtype=np.uint64))
    near, far = jaccard._parity(a[30:], 8192), jaccard._parity(more, jaccard._width(len(more)))
    assert jaccard._alike([one, one, other, one, far], [other, near, one, far, near], jaccard.Fraction(4, 5)).tolist() == [False, True, False, False, False]


@pytest.mark.parametrize("t", [jaccard.Fraction(4, 5), jaccard.Fraction(7, 10), jaccard.Fraction(1, 20), jaccard.Fraction(1)])
def test_the_first_pass_loses_no_similar_pair(t):
    """Sets as unlike as may be send as many equal least elements as each is asked for, where the elements that differ are the least of all or any."""
    r = np.random.default_rng(5)
    for a in [*range(1, 60), 199, 200, 1000, 4999]:
        for b in {a, a + (int(a / t) - a) // 2, int(a / t)}:
            if b > 50_000:
                continue
            both = -(-(a + b) * t.numerator // (t.numerator + t.denominator))  # the least that makes them similar
            for low in (True, False):
                values = np.sort(r.choice(1 << 40, a + b - both, replace=False)) if low else r.choice(1 << 40, a + b - both, replace=False)
                x, y = np.sort(np.concatenate([values[: a - both], values[a + b - 2 * both :]])), np.sort(values[a - both :])
                assert (len(x), len(y)) == (a, b)
                sent, asked = jaccard._least(np.array([a, b]), t)
                shared = len(np.intersect1d(x[: sent[0]], y[: sent[1]]))
                assert (sent <= [a, b]).all() and (asked >= 1).all() and shared >= asked.max(), (a, b, low)


def long_texts(seed: int) -> list[tuple]:
    """Texts of 3 to 3,000 words, each with others that share more or less of it, about the threshold and far below."""
    r, rows = np.random.default_rng(seed), []
    for k, size in enumerate([3, 8, 40, 130, 500, 900, 3000]):
        base = [f"w{k}x{i}" for i in range(size)]
        for share in (1, 0.95, 0.9, 0.89, 0.88, 0.8, 0.6, 0.3):
            cut = int(size * share)
            rows.append((len(rows), " ".join(base[:cut] + [f"o{len(rows)}x{i}" for i in range((size - cut) * int(r.integers(0, 2)))])))
    return rows + [(1000 + k, " ".join(f"u{k}x{i}" for i in range(60 + k))) for k in range(30)]


@pytest.mark.parametrize("bucket", [512, 2])
def test_only_texts_with_company_send_blocks_and_only_near_ones_send_sets(spark, monkeypatch, bucket):
    """Class records went to nearly every target, whether any text was like theirs, and sketches of 1,024 bits let every pair of long texts pass."""
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    tables, plain = {}, jaccard.written

    def kept(df, name):
        tables[name] = plain(df, name)
        return tables[name]

    monkeypatch.setattr(jaccard, "written", kept)
    rows = long_texts(6)
    sets = shingle_sets([(d, t) for d, t in rows])
    similar = {d: sum(len(s & o) * 5 >= 4 * len(s | o) for e, o in sets.items() if e != d) for d, s in sets.items()}
    got = {r["doc_id"]: r["n_similar"] for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == similar and 0 < sum(similar.values())
    classes = {r["cls"]: r["rep"] for r in tables["classes"].collect()}
    sketched = {classes[r["a"]] for r in tables["blocks"].where("kind = 3").collect()}
    linked = {d for d, s in sets.items() if any(s != o and len(s & o) * 5 >= 4 * len(s | o) for o in sets.values())}
    assert linked & set(classes.values()) <= sketched and not any(d >= 1000 for d in sketched)
    close = [(classes[r["a"]], classes[r["b"]]) for r in tables["close"].collect()]
    shares = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in close if len(sets[a]) > 800]
    assert len(shares) > 5 and min(shares) > 0.7


def test_large_buckets_are_tiled(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:k] + [f"v{k}"] + words[k + 1 :]) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = sorted(map(tuple, jaccard.similar(df).collect()))
    key, cls = np.repeat(np.uint64(7), 9), np.arange(16, 160, 16, dtype=np.uint64)
    monkeypatch.setattr(jaccard, "BUCKET", 4)
    left, _, large = jaccard._pairs_of_buckets(key, cls)
    assert not len(left) and len(large) == 1 and len(large[0]) == 9
    assert len(plain) == 30 and all(r[3] == 0 for r in plain)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (5, 5), (None, 4), (40, 30), (30, 20), (20, 15), (15, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 15: 1, 20: 1, 30: 1, 40: 1, 10: 10, 11: 10, 12: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_bytes(rows):
    seen, out = set(), {}
    for doc, text in sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0]):
        b = (text or "").encode()
        gone, own = bytearray(len(b)), []
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                gone[p : p + 50] = b"\1" * 50
            own.append(b[p : p + 50])
        seen |= set(own)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [0, 2000])
def test_suffixes(docs, rows, none, hot):
    got = suffixes.dedup_substrings(docs, hot=hot).collect()
    want = brute_bytes(rows)
    assert len(got) == len(rows) and sum(r["n_removed"] for r in got) > 0
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == want[r["doc_id"]]
    assert suffixes.dedup_substrings(none).count() == 0


def test_suffixes_with_null_ids(spark):
    text = "".join(chr(97 + k * k % 26) for k in range(90))
    df = spark.createDataFrame([(None, text), (5, text), (6, "short")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffixes.dedup_substrings(df).collect()} == {None: 0, 5: 90, 6: 0}


def test_suffix_sort_is_a_sort():
    r = np.random.default_rng(3)
    data = r.choice(np.frombuffer(b"ab", np.uint8), 400)
    start = np.sort(r.integers(0, 390, 120))
    end = np.minimum(start + r.integers(1, 60, 120), 400)
    group = r.integers(0, 3, 120)
    order = suffixes.suffix_sort(suffixes.Prefixes(data), start, end, group)
    keys = [(group[k], data[start[k] : end[k]].tobytes()) for k in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(120))


def test_common_extension():
    data = np.frombuffer(b"abcabcabx", np.uint8)
    assert suffixes.Prefixes(data).common(np.array([0, 0, 1]), np.array([3, 6, 2]), np.array([6, 3, 5])).tolist() == [5, 2, 0]


def test_chunks_cover_all_texts():
    from quillon.llm import words

    texts = pa.array(["ab", None, "", "c" * 50, "d"], pa.string()).slice(1)
    got = [data.tobytes()[a:z] for _, data, b in words.chunks(texts, 10) for a, z in zip(b, b[1:])]
    assert got == [b"", b"", b"c" * 50, b"d"]
