"""Articles out of lines (A1): headings with continuations (W4), hierarchy (W2, J2), numbers (F15-F18), pages.

What a line is (level, continuation, inline sub-section) is decided in columns; a
fold per document then does what depends on the lines before: which lines a
heading takes up, the present hierarchy, and the number of the last article kept.
Documents are hashed and sorted once and folded as a task meets them.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import patterns as P
from ..functions import text as X
from . import lines as L

LEVELS = tuple("livre titre chapitre section sous_section".split())
SCHEMA = "document_name string, pos int, article_number string, livre string, titre string, chapitre string, section string, sous_section string, pages string, content string, source_relative_path string"
_ARTICLE = P.python(P.ARTICLE, re.MULTILINE)
_QUOTED = P.python(P.QUOTED_BEFORE)
_RESTART = [P.python(P.IN_ADDITION), P.python(P.PAREN_NOTE_NEAR, re.DOTALL)]
_GLUED = P.python(P.GLUED_CHAPTER)
_PLAIN = P.python(f"\\d+{P.QUALIFIER}?")
_BREAKS, _SPACES = re.compile("(?:\r?\n)+"), re.compile("\t[ \t]*| [ \t]+")
_QUALIFIED = P.python(P.QUALIFIER + P.B)


def _title(level: str, text: str) -> str:
    n = N.heading(text)
    return _GLUED.sub(r"\1\2", n) if level == "chapitre" else n


def structure(rows: list[tuple]) -> tuple[str, list[tuple[int, int]], list[tuple[int, str, str]]]:
    """(text, (offset, page) of each page, events) from (page, text, level, continuation, inline offset, inline heading) of a document's kept lines."""
    parts, pages, events = [], [], []
    at, i = 0, 0
    while i < len(rows):
        page, text, level, _, inline, named = rows[i]
        if not pages or pages[-1][1] != page:
            pages.append((at, page))
        taken = 0
        if level == "sous_section":
            events.append((at, level, N.heading(text)))
        elif level:
            value = _title(level, text)
            while taken < 3 and i + taken + 1 < len(rows) and rows[i + taken + 1][0] == page and rows[i + taken + 1][3]:
                taken += 1
                value = _title(level, f"{value} {rows[i + taken][3]}")
            events.append((at, level, value))
        if inline is not None and inline == inline and not (level == "sous_section" and inline == 0):
            events.append((at + int(inline), "sous_section", named))
        for k in range(i, i + taken + 1):
            parts.append(rows[k][1])
            at += len(rows[k][1]) + 1
        i += taken + 1
    events.sort(key=lambda e: e[0])
    return "\n".join(parts), pages, events


def _quoted(text: str, start: int) -> bool:
    """Whether the line before is a citation."""
    for line in reversed(text[max(0, start - 1000) : start].splitlines()):
        if n := N.heading(line):
            return _QUOTED.search(n) is not None
    return False


def _restarted(text: str, start: int, raw: str, previous: int | None) -> bool:
    """P5: whether a low number far into the text stands in a block of notes."""
    if previous is None or previous < 10 or not raw.isdigit() or int(raw) > 5:
        return False
    near = [n for n in map(N.heading, text[max(0, start - 1800) : start].splitlines()) if n][-10:]
    return any(p.search("\n".join(near)) for p in _RESTART)


def articles_of(rows: list[tuple]) -> list[dict]:
    """The articles of one document, in order."""
    text, pages, events = structure(rows)
    starts, places = [p[0] for p in pages], [e[0] for e in events]
    page_at = lambda offset: pages[max(0, bisect_right(starts, offset) - 1)][1] if pages else 1
    matches = list(_ARTICLE.finditer(text))
    now = dict.fromkeys(LEVELS, "")
    out, k, previous = [], 0, None
    for i, m in enumerate(matches):
        while k < len(events) and events[k][0] <= m.start():
            _, level, value = events[k]
            for lower in LEVELS[LEVELS.index(level) + 1 :]:
                now[lower] = ""
            now[level] = value
            k += 1
        raw = m.group(1)
        if _quoted(text, m.start()) or _restarted(text, m.start(), raw, previous):
            continue
        number, base = N.article_number(raw, previous)
        stop = next((n.start() for n in matches[i + 1 : i + 2]), len(text))
        within = bisect_right(places, m.end(), k)  # not by a walk: a document may have as many events as articles
        stop = min(stop, places[within]) if within < len(places) else stop
        body = text[m.end() : stop]
        mark = N.suffix(body)
        if mark is not None and base is not None and previous == base and number.isdigit():
            number = f"{base}{'' if _QUALIFIED.match(mark) else '-'}{mark}"
        content = N.strip_footnotes(body)
        label = N.annotation(content)
        if label is not None and _PLAIN.fullmatch(number):
            number = f"{number} {label}"
        number = N.compound(number)
        content = _SPACES.sub(" ", _BREAKS.sub(" ", content)).strip()
        if not content:
            continue
        first, last = page_at(m.start()), page_at(max(stop - 1, m.start()))
        out.append({"article_number": number, **now, "pages": str(first) if first == last else f"{first}-{last}", "content": content})
        previous = base if base is not None else previous
    return out


def described(lines: DataFrame) -> DataFrame:
    """Kept lines with level, continuation and inline sub-section."""
    kept = L.drop_margins(lines)
    made = kept.select(
        "*",
        L.level(unlabeled=L.unlabeled_allowed()).alias("level"),
        X.heading_continuation("text", normal=True).alias("continuation"),
        X.inline_sub_section("text", normal=True).alias("_inline"),
    )
    return made.select(*kept.columns, "level", "continuation", F.col("_inline.offset").alias("inline_offset"), F.col("_inline.heading").alias("inline_heading"))


def extract(lines: DataFrame, source_path: str = "doc") -> DataFrame:
    """A1: the article table of a line table, an ordered fold per document.

    Lines are hashed by document once, in ``lines.drop_margins``, and sorted by place;
    a task folds one document after the other as they come: no call per group, and no
    more than one document in memory.
    """
    rows = described(lines).withColumn("source", F.col(source_path))
    placed = rows.sortWithinPartitions("doc", "page", "line_no")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    fields = ("page", "text", "level", "continuation", "inline_offset", "inline_heading")

    def table(doc: str, source: str, own: list[tuple]) -> pa.RecordBatch:
        made = [{"document_name": doc, "pos": i, **a, "source_relative_path": source} for i, a in enumerate(articles_of(own))]
        return pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], pa.int32() if c == "pos" else pa.string()) for c in names], names)

    def fold(batches):
        now, source, own = None, None, []
        for batch in batches:
            docs, sources = batch.column("doc").to_pylist(), batch.column("source").to_pylist()
            for doc, path, row in zip(docs, sources, zip(*(batch.column(f).to_pylist() for f in fields))):
                if doc != now:
                    if own:
                        yield table(now, source, own)
                    now, source, own = doc, path, []
                own.append(row)
        if own:
            yield table(now, source, own)

    return placed.withColumn("doc", F.col("doc").cast("string")).withColumn("source", F.col("source").cast("string")).mapInArrow(fold, SCHEMA)


def carry_hierarchy(lines: DataFrame, doc: str = "doc", order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """On every line the heading in force at each level; a higher level clears the lower ones.  Needs level and text.

    One window: the last heading of each level with its place, compared afterwards.
    """
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    headed = lines.withColumn("_h", F.when(F.col("level").isNotNull(), X.normalise_hierarchy(F.col("level"), "text")))
    entry = F.struct(F.struct(*order).alias("at"), F.col("_h").alias("value"))
    out = headed.select("*", *(F.last(F.when(F.col("level") == name, entry), ignorenulls=True).over(w).alias(f"_{name}") for name in LEVELS))
    shown = []
    for k, name in enumerate(LEVELS):
        cleared = F.lit(False)
        for higher in LEVELS[:k]:
            cleared = cleared | F.coalesce(F.col(f"_{higher}.at") > F.col(f"_{name}.at"), F.lit(False))
        shown.append(F.coalesce(F.when(~cleared, F.col(f"_{name}.value")), F.lit("")).alias(name))
    return out.select(*lines.columns, *shown)
