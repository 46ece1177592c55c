"""Graders of answers as Columns: numbers, units, orderings, SQL, abstention, rubrics, completeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.canon import expert_words, let, normalize_text

#: A number as graded, fenced code, and phrases that say the evidence is missing (in lower case).
NUMBER = r"((?<![\w.])[-+]?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?)"
FENCE = r"(?s)```[ \t]*(?:python|py|sql)?[ \t]*\r?\n(.*?)```"
ABSTENTIONS = [
    r"\bcannot (?:be )?determin(?:e|ed)\b",
    r"\bcan(?:not|'t) determine\b",
    r"\bunable to determine\b",
    r"\binsufficient (?:information|evidence|context|data)\b",
    r"\bnot enough (?:information|evidence|context|data)\b",
    r"\b(?:information|evidence|value|percentage) (?:is|was) not (?:provided|available|given)\b",
    r"\bunknown from (?:the )?(?:provided|available) (?:information|evidence|context|data)\b",
]
#: Words a finished answer does not end with.
DANGLING = r"(?i)\b(?:and|or|to|with|because|including|such as)\s*[.!?]?\s*$"


def _said(x) -> Column:
    """Lower case, white-space runs as one blank, one minus sign."""
    return F.lower(normalize_text(F.translate(F.col(x) if isinstance(x, str) else x, "−", "-")))


def stated_numbers(x) -> Column:
    found = F.regexp_extract_all(F.translate(F.col(x) if isinstance(x, str) else x, "−", "-"), F.lit(NUMBER), F.lit(1))
    return F.array_compact(F.transform(found, lambda n: F.regexp_replace(n, ",", "").try_cast("double")))


def close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def grade_numeric(answer, expected: Column, rel: float = 1e-9, absolute: float = 1e-9) -> Column:
    """The last number stated is the expected one."""
    return F.coalesce(close(F.try_element_at(stated_numbers(answer), F.lit(-1)), expected, rel, absolute), F.lit(False))


def grade_unit(answer, expected: Column, unit: Column) -> Column:
    """As grade_numeric(), and the unit, if any, is named between word borders."""
    said = F.rlike(_said(answer), F.concat(F.lit(r"\b\Q"), _said(unit), F.lit(r"\E\b")))
    return grade_numeric(answer, expected) & ((_said(unit) == "") | said)


def grade_ordering(answer, expected: Column) -> Column:
    """The last numbers stated are the expected ones in order; names, where any is expected, all occur, each after the one before."""
    a = F.lower(F.col(answer) if isinstance(answer, str) else answer)
    values = F.transform(expected, lambda e: F.regexp_replace(e, ",", "").try_cast("double"))
    places = F.transform(expected, lambda e: F.instr(a, F.lower(e)))
    named = F.forall(places, lambda p: p > 0) & (places == F.array_sort(places))

    def tail(n: Column) -> Column:
        last = F.slice(n, F.greatest(F.lit(1), F.size(n) - F.size(values) + 1), F.size(values))
        return (F.size(n) >= F.size(values)) & F.forall(F.zip_with(last, values, lambda x, y: close(x, y)), lambda ok: ok)

    return F.when(F.exists(values, lambda v: v.isNull()), named).otherwise(let(stated_numbers(answer), tail))


def _sql(x) -> Column:
    """Code of a reply in lower case, white-space runs as one blank, without a final semicolon."""
    c = F.col(x) if isinstance(x, str) else x
    code = F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(FENCE), F.lit(1)), F.lit(1)), c)
    return F.lower(normalize_text(F.regexp_replace(normalize_text(code), ";+$", "")))


def grade_sql(answer, expected) -> Column:
    return (_sql(expected) != "") & (_sql(answer) == _sql(expected))


def grade_abstention(answer, forbid_numbers: bool = True) -> Column:
    """Says that evidence is missing, and guesses no number."""
    said = _said(answer).rlike("|".join(ABSTENTIONS))
    return said & (F.size(stated_numbers(answer)) == 0) if forbid_numbers else said


def grade(kind: Column, answer: Column, expected: Column, unit: Column) -> Column:
    """correct: graded by the kind of the specification (ordering: values parted by ">"); "none" is correct, an unknown kind null."""
    number = F.regexp_replace(expected, ",", "").try_cast("double")
    return (
        F.when(kind == "none", F.lit(True))
        .when(kind == "numeric", grade_numeric(answer, number))
        .when(kind == "unit", grade_unit(answer, number, unit))
        .when(kind == "ordering", grade_ordering(answer, F.split(expected, r"\s*>\s*")))
        .when(kind == "sql_exact", grade_sql(answer, expected))
        .when(kind == "abstention", grade_abstention(answer))
        .when(kind == "exact", F.trim(answer) == F.trim(expected))
    )


def rubric_coverage(answer, groups: Column) -> Column:
    """Share of rubric groups (label, any) of which a phrase occurs between word borders; no groups score 1."""
    a = F.concat(F.lit(" "), F.array_join(expert_words(answer), " "), F.lit(" "))
    hit = F.filter(groups, lambda g: F.exists(g["any"], lambda p: F.contains(a, F.concat(F.lit(" "), F.array_join(expert_words(p), " "), F.lit(" ")))))
    return F.when(F.size(groups) > 0, F.size(hit) / F.size(groups)).otherwise(F.lit(1.0))


def completion(answer, least_words: int, sections: list[str]) -> Column:
    """0.35 for length, 0.45 for sections named, 0.10 without placeholders, 0.10 for a proper end."""
    a = F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit(""))
    n = F.least(F.lit(1.0), F.size(expert_words(a)) / float(max(1, least_words)))
    groups = F.array(*[F.struct(F.lit(s).alias("label"), F.array(F.lit(s)).alias("any")) for s in sections])
    clean = (~a.rlike(r"(?i)\b(?:todo|tbd|lorem ipsum|placeholder)\b|\.\.\.\s*$")).cast("int")
    end = F.regexp_replace(a, r"(?U)\s+$", "")
    ended = (end.rlike(r"(?:[.!?)\]}]|```)$") & ~end.rlike(DANGLING)).cast("int")
    return F.round(0.35 * n + (0.45 * rubric_coverage(a, groups) if sections else F.lit(0.45)) + 0.10 * clean + 0.10 * ended, 6)


def unsupported_sentences(answer, forbidden: list[str]) -> Column:
    """Sentences that claim runs, certainty or forbidden terms."""
    a = F.col(answer) if isinstance(answer, str) else answer
    pattern = r"(?i)\b(?:i (?:ran|tested|measured|executed|verified)|guaranteed|proven in production|100% (?:safe|accurate)|studies show)\b" + ("|" + "|".join(forbidden) if forbidden else "")
    return F.filter(F.split(a, r"(?<=[.!?])\s+"), lambda s: s.rlike(pattern))


def overall(scores: dict[str, tuple[Column, float]], floor: float, critical: list[str]) -> tuple[Column, Column]:
    """(weighted mean of the scores that are there, passed): all must reach the floor; critical ones must not be null."""
    num = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in scores.values()), F.lit(0.0))
    den = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in scores.values()), F.lit(0.0))
    ok = F.lit(True)
    for k, (s, _) in scores.items():
        ok = ok & (s.isNotNull() & (s >= floor) if k in critical else F.coalesce(s >= floor, F.lit(True)))
    return F.round(F.try_divide(num, den), 6), ok
