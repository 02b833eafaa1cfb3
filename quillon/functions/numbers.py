"""Article numbers, where the reading depends on the number before (F15, F16), and the text rules that the article fold needs row by row in Python."""

from __future__ import annotations

import re

from . import patterns as P

_GLUED = re.compile(f"([{P.LETTERS}])([0-9]{{2,3}})$")
_HEADER_FOOTER, _NOTE, _OPENING = P.python(P.HEADER_FOOTER), P.python(P.NOTE_LINE + ".*$"), P.python(P.NOTE_OPENING)
_ORDINARY, _ANYWHERE = P.python(P.NOTE_ORDINARY), P.python(P.NOTE_ANYWHERE)
_CUTS = [P.python(c) for c in P.CUTS]
_SUB_TOKEN = P.python(P.LEADING_SUB_TOKEN, re.DOTALL)
_ANNOTATIONS = [P.python(p, re.DOTALL) for p in (P.ANNOTATION, P.ANNOTATION_UNOPENED)]
_SUFFIXES = [P.python(p, re.DOTALL) for p in (P.SUFFIX_NOTE, P.SUFFIX_MARK, P.SUFFIX_WORD, P.SUFFIX_NUMBER)]
_COMPOUND = [P.python(p) for p in (P.COMPOUND_QUALIFIED, P.COMPOUND_DASHED)]
_FIRST = P.python("premi(?:er|ère)|1er|1re")


def heading(text: str) -> str:
    one = " ".join(text.replace("\a", " ").split())
    return _GLUED.sub(r"\1.\2", one) if one[-1:].isdigit() else one  # a search goes through the whole line


def is_header_footer(line: str) -> bool:
    return _HEADER_FOOTER.match(line) is not None


def is_footnote(line: str) -> bool:
    if not _NOTE.match(line):
        return False
    marker, _, body = re.match(rf"\s*(\d+)(\s*)[{P.DASHES}]([\s\S]*)", line).groups()
    body = body.strip()
    if int(marker) >= 30 or not body:
        return int(marker) >= 30
    if _ORDINARY.match(body):
        return False
    return bool(_OPENING.match(body) or _ANYWHERE.search(body)) or len(body) > 120


def strip_footnotes(body: str) -> str:
    kept = [n for n in map(heading, body.splitlines()) if n and not is_header_footer(n) and not is_footnote(n)]
    text = _SUB_TOKEN.sub("", "\n".join(kept), count=1)
    found = [m.start() for m in (cut.search(text) for cut in _CUTS) if m]
    return text[: min(found, default=len(text))].strip()


def annotation(content: str) -> str | None:
    n = heading(content)
    for pattern in _ANNOTATIONS:
        if m := pattern.match(n):
            label = heading(m.group(1))
            return f"({label})" if label else None
    return None


def suffix(body: str) -> str | None:
    note, mark, word, number = (p.match(body) for p in _SUFFIXES)
    if note:
        return f"{note.group(1).lower()}.{note.group(2)}"
    if mark or word:
        return (mark or word).group(1).lower()
    if not number:
        return None
    raw, qualifier, above = number.group(1), (number.group(2) or "").lower(), number.group(3) or ""
    base = raw
    for cut in (2, 1, 3):
        left, right = raw[:cut], raw[cut:]
        if len(raw) >= 3 and 1 <= int(left) <= 30 and len(right) in (2, 3):
            base, above = left, above or right
            break
    if not 1 <= int(base) <= 30:
        return None
    return str(int(base)) + (f" {qualifier}" if qualifier else "") + (f".{above}" if above else "")


def recovered(raw: str, previous: int) -> tuple[str, int] | None:
    """F16: a number with a note number glued to it, split where the article number comes nearest to the one before."""
    best: tuple[int, int, str] | None = None
    for tail in (3, 2):
        if len(raw) < 4 or not 1 <= int(raw[:-tail]) <= 2000:
            continue
        base = int(raw[:-tail])
        gap = abs(base - previous)
        score = (4 if gap <= 1 else 3 if gap <= 3 else 1 if gap <= 8 else 0) + (tail == 3)
        if best is None or score > best[0]:
            best = score, base, raw[-tail:]
    return (f"{best[1]}.{best[2]}", best[1]) if best and best[0] >= 2 else None


def article_number(raw: str, previous: int | None) -> tuple[str, int | None]:
    """(number as shown, its base)."""
    raw = raw.strip()
    if _FIRST.fullmatch(raw):
        return "1", 1
    if not raw.isdigit():
        return raw, previous
    if previous is not None:
        due = str(previous + 1)
        if raw.startswith(due) and 1 <= len(raw) - len(due) <= 3:
            return f"{due}.{raw[len(due):]}", previous + 1
        if found := recovered(raw, previous):
            return found
    return raw, int(raw)


def compound(number: str) -> str:
    number = number.strip()
    for k, pattern in enumerate(_COMPOUND):
        if m := pattern.match(number):
            return "".join(m.group(1).split()) if k == 0 else m.group(1)
    return number
