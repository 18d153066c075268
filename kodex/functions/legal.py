"""Dates, numbers and signs of courts and statutes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from kodex.functions.regex import let, matches
from kodex.functions.text import squeeze, unaccented

# Months as decisions write them, without diacritics, and the panels' Roman numerals.
MONTHS = {"ledna": 1, "unora": 2, "brezna": 3, "dubna": 4, "kvetna": 5, "cervna": 6, "cervence": 7, "srpna": 8, "zari": 9, "rijna": 10, "listopadu": 11, "prosince": 12}
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4"}
#: Characters before a marker in which a verb of referral takes it away.
LOOK_BACK = 48


def czech_date(text: Column) -> Column:
    """The first `9. 7. 2009`, else the first `9. července 2009`; null where there is none or no such day."""
    day = lambda s, p, m: F.try_make_timestamp(F.regexp_extract(s, p, 3).try_cast("int"), m, F.regexp_extract(s, p, 1).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    numeric, long = r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})", r"(\d{1,2})\.\s*([a-z]+)\s+(\d{4})"
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    folded = unaccented(text)
    return F.when(text.rlike(numeric), day(text, numeric, F.regexp_extract(text, numeric, 2).try_cast("int"))).otherwise(day(folded, long, F.try_element_at(months, F.regexp_extract(folded, long, 2))))


def czech_day(day: Column) -> Column:
    return F.date_format(day, "d. M. yyyy")


def split_ref_no(printed: Column) -> Column:
    """struct<case_no, ref_no>: `6 Afs 234/2023 - 50` is case 6 Afs 234/2023 and number 6 Afs 234/2023-50; without a sheet both are the same."""
    s, p = squeeze(printed), r"^(.*?\d/\d{4})\s*[-–]\s*(\d+)$"
    case = F.trim(F.regexp_extract(s, p, 1))
    return F.when(s.rlike(p), F.struct(case.alias("case_no"), F.concat(case, F.lit("-"), F.regexp_extract(s, p, 2)).alias("ref_no"))).otherwise(F.struct(s.alias("case_no"), s.alias("ref_no")))


_SIGN = r"(?i)^(?:(Pl)\.?|([IVX]+)\.?)\s*ÚS\s*(\d+)/(\d{2,4})$"


def sign_parts(case_no: Column) -> Column:
    """struct<designator, sequence, year> of a constitutional case number, the year by its last two digits; null if it isn't one."""
    s = F.trim(F.replace(case_no, F.lit("\xa0"), F.lit(" ")))
    who = F.when(F.regexp_extract(s, _SIGN, 1) != "", "Pl").otherwise(F.upper(F.regexp_extract(s, _SIGN, 2)))
    return F.when(s.rlike(_SIGN), F.struct(who.alias("designator"), F.regexp_extract(s, _SIGN, 3).alias("sequence"), F.right(F.regexp_extract(s, _SIGN, 4), F.lit(2)).alias("year")))


def sign_key(case_no: Column, ordinal: int = 1) -> Column:
    """Document key such as 4-3523-20_1; null where the string is no sign or its numeral no panel."""
    p = sign_parts(case_no)
    panel = F.when(p["designator"] == "Pl", "Pl").otherwise(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv]), p["designator"]))
    return F.concat(panel, F.lit("-"), p["sequence"], F.lit("-"), p["year"], F.lit(f"_{ordinal}"))


def sign_spellings(case_no: Column) -> Column:
    """Both spacings of a sign, `IV. ÚS 3523/20` and `IV.ÚS 3523/20`; an empty array if it isn't one."""
    p = sign_parts(case_no)
    tail = F.concat(F.lit("ÚS "), p["sequence"], F.lit("/"), p["year"])
    return F.when(p.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(p["designator"], F.lit(". "), tail), F.concat(p["designator"], F.lit("."), tail)))


def same_sign(a: Column, b: Column) -> Column:
    """Whether both strings are signs of one case; false if either isn't a sign."""
    return F.coalesce(sign_parts(a) == sign_parts(b), F.lit(False))


def section_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.replace(text, F.lit("§"), F.lit(" "))), r"\.+$", ""))


def subsection_form(text: Column) -> Column:
    s = F.trim(F.regexp_replace(F.trim(F.replace(text, F.lit("odst."), F.lit(" "))), r"^[()]+|[()]+$", ""))
    return F.nullif(s, F.lit(""))


def fragment_keys(path: Column) -> Column:
    """struct<section, subsec> from par_ and odst_ segments of a structural path; null where a segment is missing or no number."""
    number = r"^\d+[a-z]*$"
    seg = lambda name: F.nullif(F.regexp_extract(path, rf"(?:^|/){name}_([^/]+)", 1), F.lit(""))
    section = F.when(seg("par").rlike(number), seg("par"))
    return F.struct(section.alias("section"), F.when(section.isNotNull() & seg("odst").rlike(number), seg("odst")).alias("subsec"))


def asserts(text: Column, markers: list[str], referral: str, look_back: int = LOOK_BACK) -> Column:
    """Whether the unaccented text has a match of a marker that no match of `referral` within the characters before it takes away."""
    def free(folded: Column) -> Column:
        before = lambda m: F.substring(folded, F.greatest(m["start"] - look_back, F.lit(0)) + 1, F.least(m["start"], F.lit(look_back)))
        return reduce(or_, [F.exists(matches(folded, p), lambda m: ~before(m).rlike(referral)) for p in markers])

    return F.coalesce(let(unaccented(text), free), F.lit(False))


# Per court the names of its special panels and the verbs by which a panel refers a case to one, over unaccented text.
EXTENDED_NSS = [r"\brozsiren\w* senat\w*\b", r"\b\d+clenn\w* rs nss\b"]
PLENARY_NSS = [r"\bplen\w* nss\b"]
GRAND_NS = [r"\bvelk\w* senat\w*\b"]
PLENARY_US = [r"\bplen\w*\b"]
PLENARY_SIGN = r"^\s*pl\.?\s*us\b"
REFERRAL_NSS = r"\b(?:postoup\w*|postupuje|postupuji|predlozi\w*|predlozen\w*|predklad\w*|prikaz\w*|navrh\w* na postoupeni)\b"
REFERRAL_NS = r"\b(?:postoup\w*|postupuje|postupuji|predlozi\w*|predlozen\w*|predklad\w*|prikaz\w*|navrh\w* na postoupeni)\b"
REFERRAL_US = r"\b(?:postoup\w*|postupuje|predlozi\w*|predlozen\w*|predklad\w*|navrh\w* na postoupeni)\b"


def panel_type(court: Column, text: Column, case_no: Column) -> Column:
    """extended, grand, plenary, panel, or unknown where nothing is known, by each court's own names of panels.

    A special panel counts where the text or the case number asserts it; a constitutional case number with Pl. is plenary by itself.
    """
    known = (F.trim(F.coalesce(text, F.lit(""))) != "") | (F.trim(F.coalesce(case_no, F.lit(""))) != "")
    said = F.concat_ws(" ", text, case_no)
    return (
        F.when(~known, "unknown")
        .when((court == "US") & (F.coalesce(unaccented(case_no).rlike(PLENARY_SIGN), F.lit(False)) | asserts(text, PLENARY_US, REFERRAL_US)), "plenary")
        .when((court == "NSS") & asserts(said, EXTENDED_NSS, REFERRAL_NSS), "extended")
        .when((court == "NSS") & asserts(said, PLENARY_NSS, REFERRAL_NSS), "plenary")
        .when((court == "NS") & asserts(said, GRAND_NS, REFERRAL_NS), "grand")
        .otherwise("panel")
    )
