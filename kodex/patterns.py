"""The citation catalogue."""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    name: str
    kind: str
    regex: str
    groups: tuple[str, ...]
    #: A string that every match contains: the cheap test before the regular expression.
    holds: str


# The patterns, in the order that decides between equal spans.
PATTERNS = [
    Pattern("ref_no", "ref_no", r"č\.\s*j\.\s*(\d+\s+[A-Z][a-zA-Z]{1,4}\s+\d+/\d{4})(?:\s*-\s*(\d+))?", ("ref_no", "sheet_no"), "č."),
    Pattern("case_no_us", "case_no", r"sp\.\s*zn\.\s*((?:Pl\.|[IVX]+\.?)\s*ÚS\s+\d+/\d{2,4})", ("case_no",), "ÚS"),
    Pattern("case_no_gen", "case_no", r"sp\.\s*zn\.\s*(\d+\s+[A-Z][a-zA-Z]{1,4}\s+\d+/\d{4})", ("case_no",), "zn."),
    Pattern("ecli", "ecli", r"ECLI:CZ:(US|NSS|NS):\d{4}:[A-Za-z0-9_.]+", ("court",), "ECLI"),
    Pattern("journal", "journal_no", r"\bR\s+(\d+)/(\d{4})\b", ("journal_seq", "journal_year"), "R"),
    Pattern("provision", "provision", r"§\s*(\d+[a-z]?)(?:\s*odst\.\s*(\d+))?(?:[^.]{0,40}?zák(?:ona|\.)\s*č\.\s*(\d+/\d{4})\s*Sb\.)?", ("section", "subsec", "act_no"), "§"),
]

# Phrases, in lower case.
TRIGGERS = [
    "citovaného rozhodnutí", "citovaném rozhodnutí", "citovaného nálezu", "citovaného rozsudku", "citovaného usnesení",
    "výše uvedeného nálezu", "výše uvedeného rozsudku", "výše uvedeného rozhodnutí", "výše citovaného", "shora uvedeného rozhodnutí",
    "shora citovaného", "tamtéž", "posledně uvedeného rozhodnutí", "zmíněného rozsudku", "označeného rozhodnutí",
]
PARTY = [
    "stěžovatel odkazuje", "stěžovatel poukazuje", "stěžovatel namítá", "podle stěžovatele", "žalobce namítá", "žalobce odkazuje", "podle žalobce",
    "žalovaný namítá", "žalovaný odkazuje", "dovolatel poukazuje", "dovolatel namítá", "podle dovolatele", "navrhovatel namítá",
]
DEPARTURE = [
    "odchýlit se", "odchyluje se", "nelze setrvat", "překonán", "překonána", "překonáno", "koriguje", "mění dosavadní", "nesouhlasí s právním názorem",
    "postoupil rozšířenému senátu", "postoupil velkému senátu", "postupuje rozšířenému senátu", "postupuje velkému senátu",
]
NARROWING = [
    "nedopadá", "nedopadají", "nelze vztáhnout", "nelze aplikovat", "nelze bez dalšího", "nelze mechanicky", "nelze paušálně", "neuplatní se",
    "závěry nelze", "pouze tehdy", "jen tehdy",
]
QUASHING = ["se ruší", "se zrušuje", "zrušuje se", "zrušují se"]
