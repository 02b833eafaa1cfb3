"""Regular expressions of the heading, margin and note rules, for Java (columns) and Python (folds) alike.

Patterns are put together from named parts.  ``java`` prefixes the flags that make
Java read them as Python does: Unicode classes and case, ``\\n`` as the only line
end.  Never write a bare pattern in a column expression.
"""

from __future__ import annotations

import re

S, S1, N, B = r"\s*", r"\s+", r"\d+", r"\b"
DASHES = r"\-–—"
DASH = f"[{DASHES}]"
APOSTROPHE = "['’]"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
QUALIFIERS = "bis ter quater quinquies sexies septies octies nonies decies".split()


def one_of(*options: str) -> str:
    return "(?:" + "|".join(options) + ")"


_ACCENTS = {"E": "[ée]", "A": "[àa]", "U": "[uù]", "X": "[êe]", "G": "[èe]", "Q": APOSTROPHE}


def phrase(words: str) -> str:
    """Words with any white space between; capitals stand for letters with or without accent."""
    return S1.join("".join(_ACCENTS.get(c, c) for c in word) for word in words.split(" "))


QUALIFIER = one_of(*QUALIFIERS)
ROMAN = "[ivxlcdm]+"
ORDINAL = one_of("premier", ROMAN, N)

PAGE_NUMBER = f"^{S}{DASH}?{S}" + r"\d{1,4}" + f"{S}{DASH}?{S}$"
BANK = r"bank\s+al[\s-]?maghrib"
RUNNING_HEADS = one_of(
    f"public{S}$",
    phrase("recueil des textes lEgislatifs") + B + ".*$",
    phrase("mis A jour") + B + ".*$",
    f"{N}{S}[.]{S}" + phrase("statut de ") + BANK + B + ".*$",
    phrase("publiE au bulletin officiel") + B + ".*$",
)
NUMBERED_TITLE = f"{N}{S}[.]{S1}[" + "A-ZÀ-ÖØ-Þ" + r"\s'’\-" + "]{8,}" + f"{S}$"
HEADER_FOOTER = one_of(PAGE_NUMBER, f"^{S}{RUNNING_HEADS}", f"^{S}{NUMBERED_TITLE}")
MARGIN_WORDS = B + one_of(phrase("recueil des textes"), phrase("bulletin officiel"), BANK, "public", phrase("mis A jour")) + B

SUB_SECTION_START = f"^{S}sous" + one_of(f"{S}[{DASHES}‑]{S}", S1) + "section" + B
STRUCTURAL = f"^{S}" + one_of(
    f"livre{S1}{ORDINAL}", f"titre{S1}{ORDINAL}", f"c?hapitre{S1}" + one_of("premier", ROMAN + r"(?:\d{1,2})?", N), "section" + B, SUB_SECTION_START[len(f"^{S}") :]
)
LEVEL_WORDS = f"^{S}" + one_of("article", r"(?:sous[\s-]?)?section", "chapitre", "titre", "livre") + B
DETERMINER = f"^{S}" + one_of("la", "les?", f"l{APOSTROPHE}", "une?", "aux?") + B
OF_START = "^" + one_of(f"de(?:{S1}l{APOSTROPHE}?)?", "des", "du", f"d{APOSTROPHE}") + B
LIVRE = f"^{S}livre{B}"
TITRE = f"^{S}titre{S1}{ORDINAL}{B}"
CHAPITRE = f"^{S}c?hapitre{S1}" + one_of("premier", ROMAN + r"(?:\d{1,2})?", N) + B + f"(?:{S}[:：].*)?$"
SECTION = f"^{S}section{B}"
GLUED_CHAPTER = f"^{S}(c?hapitre{S1}{ROMAN})" + r"\d{1,2}" + f"({B}.*)$"
NUMBERED_SUB = f"^{S}" + r"(\d{1,2})" + f"{S}{DASH}{S1}(.+?){S}$"
INLINE_SUB = B + "sous[ -]?section" + B + f"{S}[:{DASHES}]?{S}"
NEXT_LEVEL = B + one_of("article", "sous[ -]?section", "section", "chapitre", "titre", "livre") + B
CITATION = B + one_of("article", "dahir", "bulletin", "officiel", "voir", "d[ée]cret", "loi", "pr[ée]cit[ée]e?") + B
CITATION_OR_CODE = one_of(CITATION, B + "code" + B)
LEADERS = r"\.{5,}"
WORD = f"[{LETTERS}][{LETTERS}'’" + r"\-]*"

NOTE_LINE = f"^{S}{N}{S}{DASH}"
NOTE_ORDINARY = "^" + one_of(f"l{APOSTROPHE}", *(w + B for w in ("les?", "la", "du", "des?")))
NOTE_OPENING = f"^{S}" + one_of(
    *(w + B for w in ("voir", "article", phrase("les dispositions"), "dahir", phrase("bulletin officiel"), "comparer", phrase("mXme remarque"), "ibid", "d[ée]cret", "loi", phrase("a comparer")))
)
NOTE_ANYWHERE = B + one_of("article", "dahir", phrase("bulletin officiel"), "d[ée]cret", "loi", "code") + B

ARTICLE = f"^{S}article{S1}(premi(?:er|ère)|1er|1re|{N}){B}"
QUOTED_BEFORE = one_of(B + phrase("voir articles?") + B, r"pr[ée]cit[ée]e?\." + f"{S}$")
IN_ADDITION = B + phrase("dispose en outre que") + B
PAREN_NOTE = r"\(\d{1,2}\)" + S
_PAREN_COMMON = [phrase("sont abrogEes"), phrase("dans les cas oU"), "modifi[ée]", "ajout[ée]", f"article{S1}{N}{S}[—-]"]
PAREN_NOTE_NEAR = PAREN_NOTE + one_of(phrase("lQemploi"), phrase("le ministre"), *_PAREN_COMMON)

LEADING_SUB_TOKEN = f"^{S}" + one_of(
    r"[.\-–—]" + S + r"\d{1,6}" + f"(?:{S}{QUALIFIER})?(?:{S}" + r"\d{2,3})?",
    f"{QUALIFIER}{S}" + r"\.?\s*\d{2,3}",
    QUALIFIER + one_of(f"{S}[:：{DASHES}]{S}", r"\s+\(", S1),
)
CUTS = (
    r"\n" + f"{S}{N}{S}{DASH}{S}" + one_of(phrase("les dispositions"), "dahir", phrase("bulletin officiel"), "voir", phrase("tel quQil")) + B,
    S1 + PAREN_NOTE + one_of(phrase("lQemploi"), phrase("le ministre dQetat"), *_PAREN_COMMON),
    f"{S1}{N}{S1}" + one_of(phrase("publiE au bulletin officiel"), phrase("les dispositions de l") + "[’']article", phrase("ledit dahir")) + B,
    f"{S1}{N}{S1}l.{{0,2}}article{S1}{N}{S}{QUALIFIER}?{B}",
    B + r"\d{2,4}" + S1 + one_of("circulaire", "dahir", "d[ée]cret", "arr[êe]t[ée]", "annexe", "mod[èe]le(?:-type)?") + B,
    B + one_of(r"2\.?\s*" + phrase("cadre relatif aux etablissements de credit"), phrase("louange a dieu seul"), phrase("a dEcidE ce qui suit")) + B,
)
ANNOTATION = f"^{S}" + r"\(" + S + "(" + one_of("modifi[ée]", "ajout[ée]", phrase("avant dernier"), "dernier", "paragraphes?", "alin[ée]as?", r"le\s+n[°º]?\d+", phrase("les numEros?")) + f"{S1}[^)]{{0,220}})" + r"\)"
ANNOTATION_UNOPENED = f"^{S}(" + one_of("modifi[ée]", "ajout[ée]") + f"{S1}[^)]{{0,220}})" + r"\)"

_ABOVE = r"(\d{2,3})"
SUFFIX_NOTE = f"^{S}" + r"(?:[.\-–—]\s*)?" + f"({QUALIFIER}){S}[.]?{S}{_ABOVE}{B}"
SUFFIX_MARK = f"^{S}" + r"(?:[.\-–—]\s*)?" + f"({QUALIFIER})" + one_of(f"{S}[:：{DASHES}]{S1}", r"\s+\(")
SUFFIX_WORD = f"^{S}" + r"(?:[.\-–—]\s*)?" + f"({QUALIFIER}){S1}(?=[{LETTERS}])"
SUFFIX_NUMBER = f"^{S}" + r"[.\-–—]" + S + r"(\d{1,6})" + f"(?:{S}({QUALIFIER}))?(?:{S}{_ABOVE})?{B}"
COMPOUND_QUALIFIED = f"^({N}{S}{QUALIFIER})" + r"\.\d{1,3}$"
COMPOUND_DASHED = f"^({N}(?:-{N})+)" + r"\.\d{1,3}$"

FOOTER_ONLY = f"^{S}{N}{S}[" + "­" + f"{DASHES}]*{S}$"
_UNTIL_ITEM = f".*?(?=$|{S1}-" + r"\s)"
CHUNK_MARKERS = ("A décidé ce qui suit", "LOUANGE A DIEU SEUL", "2.CADRE RELATIF AUX ETABLISSEMENTS DE CREDIT")
CHUNK_NOTES = (
    f"{S}{N}{S1}Publié au Bulletin officiel" + _UNTIL_ITEM,
    f"{S}{N}{S1}Les dispositions de l[’']article" + _UNTIL_ITEM,
    f"{S}Ledit Dahir" + _UNTIL_ITEM,
    f"{S}{N}{S1}L[’']article.*$",
)
CHUNK_PAGE = f"{S1}{N}{S}[" + "­" + f"{DASHES}]?{S}$"
SENTENCE_END = r"(?<=[.!?;:])\s+"


def java(pattern: str, flags: str = "") -> str:
    """The pattern for Spark: Unicode classes, Unix line ends, and case-insensitive unless flags contain 'c'."""
    return f"(?{'' if 'c' in flags else 'i'}Ud{flags.replace('c', '')}){pattern}"


def python(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE | flags)
