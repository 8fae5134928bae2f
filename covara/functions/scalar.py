"""Scalar functions on labels, names, places and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " — "


def system_of(domain: Column, label: Column) -> Column:
    """The domain, or what stands before the separator in the label."""
    return F.coalesce(domain, F.trim(F.split_part(label, F.lit(SEPARATOR), F.lit(1))))


def topic_label(system: Column, subdomain: Column) -> Column:
    return F.when(F.coalesce(subdomain, F.lit("")) == "", system).otherwise(F.concat(system, F.lit(SEPARATOR), subdomain))


def described_label(sub_id: Column, stable_id: Column, description: Column) -> Column:
    return F.concat(F.coalesce(sub_id, stable_id), F.lit(": "), description)


def slug(text: Column, most: int = 80) -> Column:
    """Lower case, & as and, all else but letters and digits as one hyphen, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "&", "and"), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most)


def child_id(parent: Column, text: Column, most: int = 120, least_slug: int = 16) -> Column:
    room = F.greatest(F.lit(least_slug), F.lit(most) - F.length(parent) - 1)
    return F.substring(F.concat(parent, F.lit(":"), F.substr(slug(text), F.lit(1), room)), 1, most)


def scope_hint(label: Column, full: Column, most: int = 120) -> Column:
    """A short form of the full text; null where it is empty or says what the label says."""
    t = clean(full)
    short = F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("…"))).otherwise(t)
    restated = F.coalesce((clean(label) != "") & F.startswith(F.lower(t), F.lower(clean(label))), F.lit(False))
    return F.when((F.coalesce(t, F.lit("")) != "") & ~restated, short)


def collapse_label(label: Column) -> Column:
    """`P: X — X` as `P: X`."""
    return F.regexp_replace(label, r"(?s)^((?:[A-Za-z]+\d*:\s+)?+)(.*) — \2$", "$1$2")


#: The characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def clean(text: Column) -> Column:
    """Text without white space at the ends; no-break spaces count."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalised(text: Column) -> Column:
    return F.lower(clean(F.regexp_replace(text, r"(?U)\s+", " ")))


def activity_key(section: Column) -> Column:
    """`Activity N` with an upper-case letter if there is one; null for other sections."""
    n, letter = (F.regexp_extract(section, r"(?i)^\s*activity\s+(\d+)\s*([a-z]?)\b", i) for i in (1, 2))
    return F.when(n != "", F.concat(F.lit("Activity "), n, F.upper(letter)))


def objective_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\((EO-\d{4})\)\s*\.?\s*$", 1), F.lit(""))


def page_label(filename: Column, page: Column) -> Column:
    """`Page n` of a PDF, `Slide n` of slides; null for other files."""
    name = F.lower(filename)
    kind = F.when(F.endswith(name, F.lit(".pdf")), F.lit("Page ")).when(F.endswith(name, F.lit(".pptx")), F.lit("Slide "))
    return F.concat(kind, page.cast("string"))


def marker_count(text: Column, marker: str = "\ue000") -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / F.lit(len(marker))).cast("bigint")


def without_markers(text: Column, marker: str = "\ue000") -> Column:
    return F.replace(text, F.lit(marker), F.lit(""))


def locator(path: Column) -> Column:
    """`number/base/index.extension` from the end of a path of either style; null where there is none."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.nullif(F.regexp_extract(p, r"(?:^|/)(\d+/[^/]+/\d+\.[A-Za-z0-9]+)$", 1), F.lit(""))


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^(/|\\\\|[A-Za-z]:[\\/])")


def highlighted(text: Column, query: str) -> Column:
    quoted = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return text if not query else F.regexp_replace(text, f"(?i)({quoted})", "<mark>$1</mark>")


def suggested_action(label: Column) -> Column:
    return F.concat(F.lit("Consider adding a case or lecture addressing "), label, F.lit(" to close this coverage gap."))


def csv_cell(value: Column) -> Column:
    """A quoted cell; what a spreadsheet would take for a formula gets an apostrophe."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    guarded = F.when(v.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


def framework_of(stable_id: Column) -> Column:
    return F.when(F.contains(F.lower(stable_id), F.lit("epa")), F.lit("AAMC_EPA")).otherwise(F.lit("AAMC_PCRS"))


def guide_kind(filename: Column) -> Column:
    return F.when(F.contains(filename, F.lit("FacultyGuide")), F.lit("faculty")).otherwise(F.lit("self_study"))


def extraction_scope(kind: Column, file_type: Column) -> Column:
    """Which figures of a document's file are taken out; those of faculty guides in PDF wait."""
    faculty = kind == "faculty"
    return F.when(faculty & (file_type == "pdf"), "pdf_pending").when(faculty & (file_type == "docx"), "faculty").otherwise("self_study")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.6, "medium").otherwise("low")


def confidence_text(confidence: Column) -> Column:
    """Two decimals; null stays null."""
    return F.format_string("%.2f", confidence.cast("double"))


def percent(part: Column, total: Column) -> Column:
    """Whole percent, halves up; 0 of nothing."""
    return F.when(total > 0, F.floor(part * 100.0 / total + 0.5)).otherwise(F.lit(0)).cast("bigint")


def vector_from_text(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def vector_to_text(vector: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", F.transform(vector, lambda x: x.cast("string"))), F.lit("]"))
