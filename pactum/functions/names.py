"""Scalar rules on codes, names, dates, paths and predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactum.functions.text import strip


def risk_label(score: Column) -> Column:
    """HIGH from 80, MEDIUM from 50, else LOW, on the score cut to an integer; null counts as 0."""
    whole = F.coalesce(score.cast("int"), F.lit(0))
    return F.when(whole >= 80, "HIGH").when(whole >= 50, "MEDIUM").otherwise("LOW")


def created_rule_code(name: Column) -> Column:
    """The code of a rule made by hand: upper case, blanks and dashes as underscores."""
    return F.translate(F.upper(name), " -", "__")


def rule_code(name: Column) -> Column:
    """The code of a rule made for a finding: as above, other characters than A-Z, 0-9 and _ dropped."""
    return F.regexp_replace(created_rule_code(name), "[^A-Z0-9_]", "")


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(strip(b))


def contains_any(text: str, *columns: Column) -> Column:
    """Whether any column holds the text, case aside; null columns are empty and an empty text is in all."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
    return out


def holds_all_terms(terms: str, *columns: Column) -> Column:
    """Search box of several words: each has to be in some column."""
    out = F.lit(True)
    for term in terms.split():
        out = out & contains_any(term, *columns)
    return out


def missing_fields(*names: str) -> Column:
    """Names of the columns that are null or blank, joined by commas; empty if none is."""
    blank = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) == ""
    return F.concat_ws(", ", *[F.when(blank(n), F.lit(n)) for n in names])


def certificate_serial(company_name: Column, user_id: Column) -> Column:
    """CERT-<first eight of the company>-<id of four digits at least>-<four digits by a digest>."""
    clean = F.substring(F.replace(F.regexp_replace(F.upper(company_name), r"(?U)[^\p{L}\p{N} ]", ""), F.lit(" "), F.lit("-")), 1, 8)
    tail = 1000 + F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", company_name, user_id.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(9000))
    return F.concat(F.lit("CERT-"), clean, F.lit("-"), F.format_string("%04d", user_id), F.lit("-"), tail.cast("string"))


def safe_file_code(code: Column) -> Column:
    """Letters, digits, dashes and underscores only."""
    return F.regexp_replace(code, r"(?U)[^\p{L}\p{N}_-]", "")


def media_path(url: Column, prefix: str = "/media/") -> Column:
    """Percent signs decoded (a plus stays one, and so does a percent sign that begins no escape), the prefix dropped where the path begins with it."""
    path = F.url_decode(F.regexp_replace(F.replace(url, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def days_later(moment: Column, days: Column) -> Column:
    return moment + F.make_dt_interval(days)


def iso_day(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def iso_moment(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def minute(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm")


def title_case(text: Column) -> Column:
    """Every run of letters begins with a capital, whatever stands before it."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def workflow_type(contract_type: Column) -> Column:
    """WF_ and the type in capitals, once; WF_STANDARD for none."""
    t = F.upper(strip(F.coalesce(contract_type, F.lit(""))))
    return F.when(F.startswith(t, F.lit("WF_")), t).when(t == "", "WF_STANDARD").otherwise(F.concat(F.lit("WF_"), t))


def workflow_name(kind: Column) -> Column:
    """The default name, with the type's label unless it is the standard one."""
    label = title_case(F.replace(kind, F.lit("WF_"), F.lit("")))
    base = F.lit("Quy trình Phê duyệt Mặc định")
    return F.when((label != "") & (label != "Standard"), F.concat(base, F.lit(" – "), label)).otherwise(base)
