"""Text rules as column expressions; all of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

_BLANK = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # spelled out, which Java matches faster than the Unicode class
#: The same characters, for trimming.
_ENDS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _runs(more: str = "") -> str:
    """White space (and ``more``) but for a single blank, which a replacement by one would cost time and change nothing.

    Java walks a class of many ranges as nested calls, and slowly so once these no longer
    compile.  Single ranges looked at before spare nearly all characters that walk.
    """
    blank, letters = f"[{more}{_BLANK}]", "(?=[^\\xa1-\\u167f])(?=[^\\u3001-\\x{10ffff}])"
    return f"(?=[^ -~]){letters}{blank}+| (?=[^!-~]){letters}{blank}+"


BLANKS = _runs()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _like(c: Column, pattern: str, flags: str = "") -> Column:
    return F.coalesce(c.rlike(P.java(pattern, flags)), F.lit(False))


def _drop(c: Column, pattern: str, by: str = "", flags: str = "") -> Column:
    return F.regexp_replace(c, P.java(pattern, flags), by)


def _first(c: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    return F.regexp_extract(c, P.java(pattern, flags), group)


def _once(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a column that it names more than once: as a lambda's variable the column is worked out once."""
    return F.element_at(F.transform(F.array(c), then), 1)


def strip(c) -> Column:
    """Without white space at either end; ``trim`` would only drop blanks."""
    return F.btrim(_col(c), F.lit(_ENDS))


def has_text(c) -> Column:
    """Whether anything but white space is there; false for null."""
    return F.coalesce(_col(c).rlike(f"[^{_BLANK}]"), F.lit(False))


def normalise_spaces(c) -> Column:
    """runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), BLANKS, " "))


def normalise_heading(c) -> Column:
    """one readable line; a note number glued to the last word gets a dot.  Doing it twice changes nothing."""
    one = F.trim(F.regexp_replace(_col(c), _runs("\\x07"), " "))
    return F.regexp_replace(one, f"(?=\\d)(?<=[{P.LETTERS}])(\\d{{2,3}})$", ".$1")


def _normal(c, normal: bool) -> Column:
    """The line normalised, unless the caller says that it is: a rule names it often, and each mention would be worked out anew."""
    return _col(c) if normal else normalise_heading(c)


def margin_signature(c, normal: bool = False) -> Column:
    """what recurs in a header or footer when numbers and punctuation change."""
    counted = F.regexp_replace(F.lower(_normal(c, normal)), "(?U)\\d+", "#")
    # letters and blanks are passed by before a class of several parts is asked, as in ``_runs``
    spaced = F.regexp_replace(counted, f"(?=[^a-z])(?=[^ ])[{P.DASHES}_][ {P.DASHES}_]*| (?=[^a-z])[ {P.DASHES}_]+", " ")
    return F.trim(F.regexp_replace(spaced, "(?=[^a-z])(?=[^ ])[^# a-zà-öø-ÿ]+", ""))


def normalise_hierarchy(level: str | Column, c, normal: bool = False) -> Column:
    """F1, and for chapters without the digits glued to a Roman numeral."""
    heading = _normal(c, normal)
    chapter = _drop(heading, P.GLUED_CHAPTER, "$1$2")
    if isinstance(level, str):
        return chapter if level == "chapitre" else heading
    return F.when(level == "chapitre", chapter).otherwise(heading)


def starts_with_word(c, word: str) -> Column:
    """whether the line starts with the word, in any case."""
    return _like(_col(c), f"^{P.S}{word}{P.B}")


def is_header_footer(c, normal: bool = False) -> Column:
    """F5 of a normalised line."""
    return _like(_normal(c, normal), P.HEADER_FOOTER)


def is_upper_fragment(c) -> Column:
    """eight letters or more, three quarters of them capitals."""
    letters = F.length(F.regexp_replace(_col(c), "\\P{L}", ""))
    return (letters >= 8) & (F.length(F.regexp_replace(_col(c), "\\P{Lu}", "")) >= 0.75 * letters)


def is_short_continuation(c, normal: bool = False) -> Column:
    """a short wrapped piece of a heading."""
    n = _normal(c, normal)
    words = F.regexp_extract_all(n, F.lit(f"({P.WORD})"), 1)
    first = F.substring(F.try_element_at(words, F.lit(1)), 1, 1)
    plain = (n != "") & (F.length(n) <= 70) & ~n.rlike("[.;,:!?]") & ~_like(n, P.LEVEL_WORDS) & ~_like(n, P.DETERMINER)
    return plain & (F.size(words) >= 1) & (F.size(words) <= 8) & ((F.size(words) == 1) | F.coalesce(first.rlike("\\p{Lu}"), F.lit(False)))


def heading_continuation(c, normal: bool = False) -> Column:
    """F8: the normalised line where it continues a heading, else null."""
    n = _normal(c, normal)
    barred = is_header_footer(n, True) | _like(n, P.NOTE_LINE) | _like(n, P.LEVEL_WORDS) | _like(n, P.NUMBERED_SUB)
    goes_on = _like(n, P.OF_START) | is_upper_fragment(n) | is_short_continuation(n, True)
    return F.when((n != "") & (F.length(n) <= 160) & goes_on & ~barred, n)


def inline_sub_section(c, normal: bool = False) -> Column:
    """struct (offset, heading) of a sub-section named anywhere in the line, null where none is."""
    n = _normal(c, normal)
    before = F.element_at(F.split(n, P.java(P.INLINE_SUB), 2), 1)
    rest = strip(F.try_element_at(F.split(n, P.java(P.INLINE_SUB), 2), F.lit(2)))
    rest = strip(F.element_at(F.split(rest, P.java(P.NEXT_LEVEL), 2), 1))
    heading = F.when(rest != "", normalise_heading(F.concat(F.lit("Sous-section "), rest))).otherwise("Sous-section")
    return F.when(F.lower(n).contains("section") & _like(n, P.INLINE_SUB), F.struct(F.length(before).alias("offset"), heading.alias("heading")))


def is_footnote(c) -> Column:
    """a numbered line that reads like a note."""
    line = _col(c)
    number = F.expr("null")
    number = F.coalesce(_first(line, f"^{P.S}(\\d+){P.S}{P.DASH}").try_cast("long"), F.lit(10**9))

    def reads_so(body: Column) -> Column:
        cited = _like(body, P.NOTE_OPENING) | _like(body, P.NOTE_ANYWHERE)
        return F.when(body == "", False).when(_like(body, P.NOTE_ORDINARY), False).when(cited, True).otherwise(F.length(body) > 120)

    verdict = F.when(number >= 30, True).otherwise(_once(strip(_drop(line, P.NOTE_LINE + P.S)), reads_so))
    return F.when(_like(line, P.NOTE_LINE + ".*$"), verdict).otherwise(False)


def strip_footnotes(c) -> Column:
    """body text without note lines, a leading sub-article mark, and what follows the first inline note."""
    lines = F.transform(F.split(_col(c), "\r\n|[\n\r\\x0b\\x0c\\x1c-\\x1e\\x85  ]"), normalise_heading)
    kept = F.filter(lines, lambda x: (x != "") & ~is_header_footer(x) & ~is_footnote(x))
    text = F.regexp_replace(F.array_join(kept, "\n"), P.java(P.LEADING_SUB_TOKEN, "s"), "")
    return strip(reduce(lambda t, cut: F.element_at(F.split(t, P.java(cut), 2), 1), P.CUTS, text))


def annotation_label(c) -> Column:
    """"(label)" where the text starts with an amendment note, else null."""
    label = _once(normalise_heading(c), lambda n: normalise_heading(F.coalesce(F.nullif(_first(n, P.ANNOTATION, flags="s"), F.lit("")), _first(n, P.ANNOTATION_UNOPENED, flags="s"))))
    return _once(label, lambda own: F.when(own != "", F.concat(F.lit("("), own, F.lit(")"))))


def is_numbered_sub_title(c, normal: bool = False) -> Column:
    """F13."""
    n = _normal(c, normal)
    return (n != "") & (F.length(n) <= 90) & ~_like(n, P.CITATION) & _like(n, f"^(?:des?|du){P.B}")


def is_unlabeled_sub_title(c, normal: bool = False) -> Column:
    """F14."""
    n = _normal(c, normal)
    first = F.regexp_extract(n, f"([{P.LETTERS}])", 1)
    words = F.size(F.regexp_extract_all(n, F.lit(f"([{P.LETTERS}0-9'’-]+)"), 1))
    shape = (n != "") & (F.length(n) <= 90) & ~n.rlike(P.LEADERS) & ~_like(n, P.CITATION_OR_CODE) & _like(n, f"^(?:de(?:{P.S1}l{P.APOSTROPHE}?)?|du|des){P.B}")
    return shape & ~first.rlike("\\p{Ll}") & ~n.rlike("[.;:,]$") & words.between(2, 10)


def compound_number(c) -> Column:
    """article numbers without a note number behind a qualifier or a dash."""
    n = strip(c)
    qualified = F.regexp_replace(_first(n, P.COMPOUND_QUALIFIED), "(?U)\\s+", "")
    dashed = _first(n, P.COMPOUND_DASHED)
    return F.coalesce(F.nullif(qualified, F.lit("")), F.nullif(dashed, F.lit("")), n)


def sub_article_suffix(c) -> Column:
    """the sub-article mark that a body starts with, else null."""
    body = _col(c)
    note = F.concat_ws(".", F.lower(_first(body, P.SUFFIX_NOTE)), _first(body, P.SUFFIX_NOTE, 2))
    mark, word = F.lower(_first(body, P.SUFFIX_MARK)), F.lower(_first(body, P.SUFFIX_WORD))
    raw, qualifier, explicit = (_first(body, P.SUFFIX_NUMBER, k) for k in (1, 2, 3))
    base, compact = raw, F.lit("")
    for cut in (3, 1, 2):  # the last that fits wins: 2, then 1, then 3
        left, right = F.substring(raw, 1, cut), F.expr("null")
        right = raw.substr(F.lit(cut + 1), F.length(raw))
        fits = (F.length(raw) >= 3) & left.try_cast("int").between(1, 30) & F.length(right).between(2, 3)
        base, compact = F.when(fits, left.try_cast("int").cast("string")).otherwise(base), F.when(fits, right).otherwise(compact)
    number = base.try_cast("int")
    joined = F.concat(number.cast("string"), F.when(qualifier != "", F.concat(F.lit(" "), F.lower(qualifier))).otherwise(""))
    above = F.when(explicit != "", explicit).otherwise(compact)
    joined = F.concat(joined, F.when(above != "", F.concat(F.lit("."), above)).otherwise(""))
    return (
        F.when(_like(body, P.SUFFIX_NOTE), note)
        .when(_like(body, P.SUFFIX_MARK), mark)
        .when(_like(body, P.SUFFIX_WORD), word)
        .when(_like(body, P.SUFFIX_NUMBER) & number.between(1, 30), joined)
    )


def page_span(first, last) -> Column:
    """F19."""
    return F.when(_col(first) == _col(last), _col(first).cast("string")).otherwise(F.concat_ws("-", _col(first).cast("string"), _col(last).cast("string")))


def flatten(c) -> Column:
    """one line, single blanks."""
    return strip(F.regexp_replace(F.regexp_replace(_col(c), "(?:\r?\n)+", " "), "\t[ \t]*| [ \t]+", " "))


def clean_chunk(c) -> Column:
    """chunk text without what the next document or a note has left in it; null counts as empty."""
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), "\\x07", " ")
    for marker in P.CHUNK_MARKERS:
        text = F.substring_index(text, marker, 1)
    for note in P.CHUNK_NOTES:
        text = _drop(text, note, " ")
    return normalise_spaces(_drop(text, P.CHUNK_PAGE))


def is_footer_only(c) -> Column:
    """F23."""
    return _like(_col(c), P.FOOTER_ONLY)


def long_pieces(c, most: int) -> Column:
    """a normalised text in pieces of at most ``most`` characters, cut at the last blank of the second half or hard."""
    # what is left never starts with a blank, and no two blanks meet: the rest if it is short, up to the last blank, or as it comes
    piece = f"(?s) ?(.{{1,{most}}}\\z|.{{{max(1, most // 2)},{most}}}(?= )|.{{{most}}})"
    return _once(normalise_spaces(c), lambda t: F.when(F.length(t) <= most, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(piece), 1)))


def sentences(c, most: int | None = None) -> Column:
    """sentences, ended by one of ``. ! ? ; :`` before white space; long ones in pieces where ``most`` is given."""
    units = F.split(F.regexp_replace(_col(c), "\n", " "), P.java(P.SENTENCE_END))
    found = F.filter(F.transform(units, normalise_spaces), lambda x: x != "")
    if most is None:
        return found
    return F.flatten(F.transform(found, lambda x: F.when(F.length(x) <= most, F.array(x)).otherwise(long_pieces(x, most))))


def closeness(similarity) -> Column:
    """F26."""
    s = _col(similarity)
    return F.when(s >= 0.6, "very-close").when(s >= 0.45, "close").when(s >= 0.3, "moderate").otherwise("weak")


CLOSE_FILTERS = dict(zip(("off", "loose", "balanced", "strict"), (0.0, 0.2, 0.35, 0.5)))


def close_threshold(c) -> Column:
    """F27; an unknown or blank filter is an error."""
    key = F.lower(strip(F.coalesce(_col(c), F.lit(""))))
    known = reduce(lambda w, kv: w.when(key == kv[0], kv[1]), CLOSE_FILTERS.items(), F)
    return known.otherwise(F.raise_error(F.concat(F.lit("close_filter must be one of off, loose, balanced, strict; got "), key)).cast("double"))


def truth(c) -> Column:
    """F28 of a string column: numbers other than 0 have to be given as numbers."""
    return F.coalesce(F.lower(strip(_col(c))).isin(*"on yes true 1".split()), F.lit(False))


def relative_path(c, *roots: str) -> Column:
    """below the first root that contains it; a relative path as it is; else the name alone."""
    p = _col(c)
    out = F.when(~p.startswith("/"), p)
    for root in roots:
        base = root.rstrip("/") + "/"
        out = out.when(p.startswith(base), p.substr(F.lit(len(base) + 1), F.length(p)))
    return out.otherwise(F.substring_index(p, "/", -1))


def outer_json(c) -> Column:
    """from the first brace to the last; null where there are none."""
    return F.nullif(F.regexp_extract(_col(c), "(?s)(\\{.*\\})", 1), F.lit(""))


def clean_questions(c) -> Column:
    """stripped, without blanks; null counts as none."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.filter(F.transform(_col(c), strip), lambda q: q.isNotNull() & (q != "")), none)


def casefolded(c) -> Column:
    """Key for comparison regardless of case, with sharp s as ss."""
    return F.lower(F.upper(_col(c)))


PROMPT_FIELDS = tuple("id article_number document_name livre titre chapitre section sous_section pages content".split())


def prompt_record(columns: list[str]) -> Column:
    """the fields that a prompt shows; the first three null where missing, the others empty."""
    made = []
    for k, f in enumerate(PROMPT_FIELDS):
        own = F.col(f) if f in columns else F.lit(None).cast("string")
        made.append((own if k < 3 else F.coalesce(own.cast("string"), F.lit(""))).alias(f))
    return F.struct(*made)


def result_text(rank, similarity, article, pages, file, content) -> Column:
    """a hit as shown in a terminal."""
    shown = F.substring(F.coalesce(_col(content), F.lit("")), 1, 200)
    line = F.format_string("#%d - Similarity: %.4f (%.2f%%)\nArticle: %s\nPage(s): %s\n", _col(rank), _col(similarity), _col(similarity) * 100, F.coalesce(_col(article), F.lit("Unknown")), F.coalesce(F.nullif(_col(pages), F.lit("")), F.lit("?")))
    file_line = F.when(F.coalesce(_col(file), F.lit("")) != "", F.concat(F.lit("Embedded file: "), _col(file), F.lit("\n"))).otherwise("")
    return F.concat(line, file_line, F.when(shown != "", F.concat(F.lit("Content: "), shown, F.lit("...\n"))).otherwise(""))


def record_label(id, article_number, pos) -> Column:
    """id, else article number, else index-N; empty and zero count as missing."""
    blank = lambda c: F.nullif(F.nullif(_col(c).cast("string"), F.lit("")), F.lit("0"))
    return F.coalesce(blank(id), blank(article_number), F.concat(F.lit("index-"), _col(pos).cast("string")))


def model_name(c) -> Column:
    """F37."""
    return F.when(_col(c).startswith("models/"), _col(c)).otherwise(F.concat(F.lit("models/"), _col(c)))


def is_bold(fonts) -> Column:
    """whether any font's name says so."""
    return F.coalesce(F.exists(_col(fonts), lambda f: F.lower(f).rlike("bold|black|heavy")), F.lit(False))
