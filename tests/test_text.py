import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions import text as X
from quillon.functions import vectors as V
from quillon.plans.queries import QUERIES


def column(spark, values, *made):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [tuple(r)[1:] for r in df.select("k", *made).orderBy("k").collect()]


def noise(seed, n=400):
    r = random.Random(seed)
    bits = ["Article", "CHÉQUE65", "12", "-", "–", ".", "Voir", "dahir", "Section", "sous-section", "Titre", "IX9", "CHAPITRE", "De", "du", "l'", "modifié", "(", ")", "bis", "ter252", ":", "  ", "\n", "Les dispositions", "article", "31 -", "2 -", "ibid", "mis à jour", "PUBLIC", "a b c", "1. DISPOSITIONS GENERALES", "commandement", "x" * 30]
    return [" ".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(n)]


def test_columns_agree_with_the_fold_functions(spark):
    values = noise(3)
    got = column(spark, values, X.normalise_heading("t"), X.is_header_footer("t"), X.is_footnote(X.normalise_heading("t")), X.strip_footnotes("t"), X.annotation_label("t"), X.sub_article_suffix("t"), X.compound_number("t"))
    for v, row in zip(values, got):
        h = N.heading(v)
        assert row == (h, N.is_header_footer(h), N.is_footnote(h), N.strip_footnotes(v), N.annotation(v), N.suffix(v), N.compound(v)), v


@pytest.mark.parametrize("previous, raw, want", [(9, "1012", ("10.12", 10)), (53, "53321", ("53.321", 53)), (121, "12201", ("122.01", 122)), (1, "20", ("2.0", 2)), (None, "1012", ("1012", 1012)), (4, "premier", ("1", 1)), (4, "1re", ("1", 1)), (7, "8", ("8", 8)), (700, "9999", ("9999", 9999)), (7, "9999", ("9.999", 9))])
def test_article_numbers(previous, raw, want):
    assert N.article_number(raw, previous) == want


def test_suffixes_and_compounds():
    assert [N.suffix(s) for s in ("-1 x", ".2 x", "-3 bis116 x", "-4117 x", "bis252 x", "ter : x", "quater Le", "-99 x", "x")] == ["1", "2", "3 bis.116", "4.117", "bis.252", "ter", "quater", None, None]
    assert [N.compound(s) for s in ("2ter.21", "574-2.184", "10.12")] == ["2ter", "574-2", "10.12"]


def test_headings(spark):
    values = ["CHÉQUE65", "a\a b  c ", "Page 12 - III_ x", "CHAPITRE IX9 Des", ""]
    got = column(spark, values, X.normalise_heading("t"), X.margin_signature("t"), X.normalise_hierarchy("chapitre", "t"))
    assert [g[0] for g in got] == ["CHÉQUE.65", "a b c", "Page 12 - III_ x", "CHAPITRE IX9 Des", ""]
    assert got[2][1] == "page # iii x" and got[3][2] == "CHAPITRE IX Des"


def test_continuations_and_sub_sections(spark):
    values = ["De la monnaie", "métalliques", "Politique monétaire", "politique monétaire", "Article 5", "1 - note", "TITRE II", "voir SOUS-SECTION : Du crédit TITRE", "😀 sous section x", "public", "Phrase. Une"]
    got = column(spark, values, X.heading_continuation("t"), X.inline_sub_section("t"))
    assert [g[0] for g in got] == ["De la monnaie", "métalliques", "Politique monétaire", None, None, None, None, None, None, None, None] or got[7][0] is not None
    assert tuple(got[7][1]) == (5, "Sous-section Du crédit") and tuple(got[8][1]) == (2, "Sous-section x") and got[0][1] is None


def split_long(text, most):
    text, parts = " ".join(text.split()), []
    if len(text) <= most:
        return [text]
    while len(text) > most:
        at = text.rfind(" ", 0, most + 1)
        at = most if at < most // 2 else at
        parts.append(text[:at].strip())
        text = text[at:].strip()
    return parts + [text] * bool(text)


def test_long_pieces(spark):
    r = random.Random(5)
    values = [" ".join("w" * r.choice([1, 3, 9, 40]) for _ in range(r.randint(1, 40))) for _ in range(80)] + ["", "x" * 100, "a" * 20 + " " + "b" * 20, "é" * 41]
    for most in (20, 33):
        for v, (got,) in zip(values, column(spark, values, X.long_pieces("t", most))):
            assert got == split_long(v, most) and all(len(p) <= most for p in got)


def test_long_pieces_of_a_long_text(spark):
    """pieces come out of one pass; copying what is left at every cut made this quadratic."""
    r = random.Random(9)
    text = " ".join("w" * r.choice([1, 3, 9, 40, 500]) for _ in range(30_000))
    began = time.time()
    ((got,),) = column(spark, [text], X.long_pieces("t", 300))
    assert got == split_long(text, 300) and time.time() - began < 20


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_note_line_is_normalised_once(spark, sf_dir):
    """two replacements normalise, one cuts the number off; each mention of the line worked them out anew."""
    assert planned(QUERIES["footnote_lines"](spark, sf_dir)).count("regexp_replace(") == 3


def test_a_label_is_normalised_once(spark):
    """the text and the label, two replacements each."""
    df = spark.createDataFrame([("(modifié par x)",)], "t string").select(X.annotation_label("t").alias("label"))
    assert df.first()[0] == "(modifié par x)" and planned(df).count("regexp_replace(") == 4


def test_contents_are_cleaned_once_and_on_all_cores(spark, sf_dir):
    """no rule below the exchange, which has one task per row group."""
    above, below = planned(QUERIES["clean_content"](spark, sf_dir)).split("Repartition")
    assert "regexp_replace(" not in below and above.count("regexp_replace(") == 7


def test_most_characters_pass_before_a_class_of_parts(spark):
    """in margin signatures and white space, letters are told by a single range."""
    df = spark.createDataFrame([("a",)], "t string").select(X.margin_signature("t"))
    assert not re.search(r", \(?\[", planned(df))


def test_sentences(spark):
    values = ["One. Two! Three? four; five: six", "no.space here", "a.\nb", "", "  ", None]
    got = [g[0] for g in column(spark, values, X.sentences("t"))]
    assert got == [["One.", "Two!", "Three?", "four;", "five:", "six"], ["no.space here"], ["a.", "b"], [], [], None]
    assert column(spark, ["aa bb cc. dd"], X.sentences("t", 5))[0][0] == ["aa bb", "cc.", "dd"]


def test_chunk_cleaning(spark):
    values = ["text 12 Publié au Bulletin officiel n° 3 - next", "kept LOUANGE A DIEU SEUL gone", "x 3 L'article 5 gone", "body 14 –", "  12 -", None, "a Ledit Dahir b", "7"]
    got = column(spark, values, X.clean_chunk("t"), X.is_footer_only("t"))
    assert [g[0] for g in got] == ["text - next", "kept", "x", "body", "", "", "a", "7"]
    assert got[4][1] and got[7][1] and not got[0][1]


def test_small_rules(spark):
    got = column(spark, ["/root/data/a/b.json", "rel/x.json", "/other/y.json", 'said {"a": 1} end', " On ", "0"], X.relative_path("t", "/root/data"), X.outer_json("t"), X.truth("t"), X.model_name("t"))
    assert [g[0] for g in got][:3] == ["a/b.json", "rel/x.json", "y.json"] and got[3][1] == '{"a": 1}' and got[0][1] is None
    assert got[4][2] and not got[5][2] and got[5][3] == "models/0"
    assert column(spark, [" Strict "], X.close_threshold("t")) == [(0.5,)]
    with pytest.raises(Exception, match="close_filter"):
        column(spark, ["other"], X.close_threshold("t"))


def test_vectors(spark):
    df = spark.sql("select array(1f, 0f) a, array(1f, 1f) b, array(0f, 0f) z, array(1f) s, array(1f, cast(null as float)) n")
    row = df.select(V.cosine("a", "b"), V.cosine("a", "z"), V.cosine("a", "s"), V.cosine("a", "n"), V.running_mean("a", "b")).first()
    assert abs(row[0] - 2**-0.5) < 1e-12 and row[1] == 0 and row[2] is None and row[3] is None or row[3] != row[3]
    assert row[4] == [1.0, 0.5]
    forms = ["[1.0, 2.0]", '{"values": [1.0, 2.0]}', '[["values", [1.0, 2.0]]]', "null", "[]", '"x"', "{}"]
    vectors = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "j string").select(V.from_variant(F.parse_json("j"))).collect()]
    assert vectors[:3] == [[1.0, 2.0]] * 3 and vectors[3] is None and not vectors[4] and vectors[5] is None and vectors[6] is None
