"""Text predicates and projections as Column expressions. Lists and patterns marked as fixed values must stay as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.canon import _c, let, normalize_text, shingles, words

#: Scripts whose letters mark a text as not English (Greek is allowed).
BLOCKED_SCRIPTS = [
    (0x0400, 0x052F), (0x0530, 0x058F), (0x0590, 0x05FF), (0x0600, 0x06FF), (0x0700, 0x074F), (0x0750, 0x077F), (0x0780, 0x07BF), (0x07C0, 0x07FF), (0x0800, 0x085F), (0x08A0, 0x08FF),
    (0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0A80, 0x0AFF), (0x0B00, 0x0B7F), (0x0B80, 0x0BFF), (0x0C00, 0x0C7F), (0x0C80, 0x0CFF), (0x0D00, 0x0D7F), (0x0D80, 0x0DFF),
    (0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x10A0, 0x10FF), (0x1100, 0x11FF), (0x1200, 0x137F), (0x13A0, 0x167F), (0x1780, 0x18AF), (0x2C80, 0x2CFF),
    (0x2D00, 0x2D7F), (0x3040, 0x30FF), (0x3100, 0x312F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F),
]
BLOCKED_LETTER = "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in BLOCKED_SCRIPTS) + "&&\\p{L}]"
#: Credentials, private reasoning, and the marks of source code.
SECRETS = [r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", r"\bAKIA[0-9A-Z]{16}\b", r"\b(?:sk|rk)-[A-Za-z0-9_-]{20,}\b"]
BASE64_RUN = r"(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{40,}={0,2})(?![A-Za-z0-9+/])"
REASONING = [r"(?i)<\s*/?\s*\|?think\|?\s*>", r"(?i)\bhidden chain[- ]of[- ]thought\b", r"(?i)\binternal reasoning:\s"]
CODE_HINT = r"(?i)(?:^|\s)(?:def|class|function|return|import|from|const|let|var|public|private|if|else|for|while)\b|[{};]|```"
#: Openings of pages that hold no substance.
FRONT_MATTER = r"(?i)^(?:acknowledg(?:e)?ments?|table of contents|contents|copyright|colophon|about (?:the )?author|author biography|bibliography|references|index)\b"
THANKS = r"would(?:n['’]t| not) have been possible without|particularly supportive|thanks? (?:to|you)|grateful to"


def blocked_script(x) -> Column:
    return _c(x).rlike(BLOCKED_LETTER)


def language_sample(x, most: int = 12_000) -> Column:
    """Text without links and white-space runs; of long texts the first, middle and last third of the limit."""
    t = normalize_text(F.regexp_replace(_c(x), r"(?i)https?://\S+", " "))
    part = most // 3
    middle = F.greatest(F.lit(0), F.floor((F.length(t) - part) / 2)).cast("int")
    return F.when(F.length(t) <= most, t).otherwise(F.concat_ws(" ", F.substring(t, 1, part), F.substring(t, middle + 1, F.lit(part)), F.right(t, F.lit(part))))


def letters(x) -> Column:
    return F.length(F.regexp_replace(_c(x), r"[^\p{L}]", ""))


def looks_like_code(x) -> Column:
    """Hints of code, punctuation of 8 % or more, ASCII of 98 % or more."""
    n = F.greatest(F.lit(1), F.length(x))
    punct = F.length(F.regexp_replace(_c(x), r"[\p{L}\p{N}\s]", ""))
    ascii_ = F.length(F.regexp_replace(_c(x), r"[^\x00-\x7F]", ""))
    return _c(x).rlike(CODE_HINT) & (punct / n >= 0.08) & (ascii_ / n >= 0.98)


def has_secret(x) -> Column:
    """A key or token; long base64 runs count unless they are hex digests or hold fewer than 8 characters."""
    known = F.lit(False)
    for p in SECRETS:
        known = known | _c(x).rlike(p)
    runs = F.regexp_extract_all(_c(x), F.lit(BASE64_RUN), F.lit(1))

    def odd(t: Column) -> Column:
        core = F.rtrim(F.translate(t, "=", " "))
        hexa = core.rlike("^[0-9A-Fa-f]{40,128}$")
        kinds = F.size(F.array_distinct(F.split(core, "")))
        return ~hexa & (kinds >= 8) & t.rlike("[a-z]") & t.rlike("[A-Z]") & t.rlike("[0-9+/]")

    return known | F.exists(runs, odd)


def has_reasoning(x) -> Column:
    out = F.lit(False)
    for p in REASONING:
        out = out | _c(x).rlike(p)
    return out


def non_substantive(x) -> Column:
    """Why a page holds no substance (the first reason that holds), else null."""

    def reason(t: Column, low: Column) -> Column:
        head = F.trim(F.regexp_replace(F.substring(t, 1, 240), r"(?U)^[\w.-]+\s+", ""))
        a, b, c = F.substring(low, 1, 1200), F.substring(low, 1, 1600), F.substring(low, 1, 2000)
        return (
            F.when(t == "", "empty")
            .when(head.rlike(FRONT_MATTER), "front_matter_heading")
            .when(b.rlike(THANKS) & b.rlike(r"\b(?:support|help|encourag|feedback|thank)\w*\b"), "acknowledgments")
            .when((a.contains("all rights reserved") | a.contains("isbn")) & a.contains("copyright"), "copyright_or_colophon")
            .when((b.contains("document outline") | b.contains("table of contents")) & (F.regexp_count(c, F.lit(r"\bchapter\s+\d+\b")) >= 3), "table_of_contents")
            .when(a.contains("other books you may enjoy") & (c.contains("isbn") | (F.regexp_count(c, F.lit(r"\b(?:book|guide|handbook)\b")) >= 3)), "promotional_bibliography")
        )

    return let(normalize_text(F.coalesce(_c(x), F.lit(""))), lambda t: let(F.lower(F.left(t, F.lit(2000))), lambda low: reason(t, low)))


def repetition(x, n: int = 6, least: int = 24) -> Column:
    """1 - distinct / all n-word windows; 0 for fewer than ``least`` words."""
    share = lambda w: let(shingles(w, n), lambda g: 1.0 - F.size(F.array_distinct(g)) / F.size(g))
    return let(words(x), lambda w: F.when(F.size(w) < least, F.lit(0.0)).otherwise(share(w)))


def policy_defects(x) -> Column:
    """One name for every class of forbidden content in a text."""
    t = _c(x)
    return F.array_compact(
        F.array(
            F.when(has_secret(t), "secret"),
            F.when(has_reasoning(t), "private_reasoning"),
            F.when(F.lower(t).contains("lorem ipsum"), "placeholder_text"),
            F.when(t.rlike(r"(?i)curl[^\n|]{0,200}\|\s*(?:ba|z)?sh\b"), "pipe_to_shell"),
        )
    )


def numbers(x) -> Column:
    """All numbers of a text as doubles, thousands separators dropped."""
    found = F.regexp_extract_all(_c(x), F.lit(r"(-?\d[\d,]*\.?\d*)"), F.lit(1))
    return F.array_compact(F.transform(found, lambda n: F.regexp_replace(n, ",", "").try_cast("double")))


#: Integers beyond 0 to 12, and years, that need no source.
BENIGN_INTEGERS, BENIGN_YEARS = [15, 20, 24, 25, 30, 50, 60, 100], (1990, 2035)


def numbers_grounded(x, facts: Column) -> Column:
    """Whether every number of the text is near a fact as given, in thousands, millions, billions or percent; small and benign integers and years pass."""

    def near(n: Column, f: Column) -> Column:
        hit = F.lit(False)
        for scale in (1.0, 1e-3, 1e-6, 1e-9, 100.0):
            v = f * scale
            hit = hit | (F.abs(n - v) <= F.greatest(0.006 * F.greatest(F.abs(n), F.abs(v)), F.lit(0.51)))
        return hit

    free = lambda n: ((n == F.floor(n)) & (n.between(0, 12) | n.isin(BENIGN_INTEGERS))) | n.between(*BENIGN_YEARS)
    return F.forall(numbers(x), lambda n: free(n) | F.exists(facts, lambda f: near(n, f)))


def role_leak(x) -> Column:
    """A turn marker at the start of a line, as left over from a chat template."""
    return _c(x).rlike(r"(?im)^\s*(?:#{0,3}\s*)?(?:user|assistant|system|human)\s*:")


def json_object(x) -> Column:
    """The JSON object of a reply: its code fence removed, else from the first brace to the last."""
    t = F.trim(_c(x))
    fenced = F.regexp_extract(t, r"(?s)^```(?:json)?\s*(\{.*\})\s*```$", 1)
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(inner != "", inner)


def last_number(x) -> Column:
    return F.try_element_at(numbers(x), F.lit(-1))


def code_block(x) -> Column:
    """The body of the first fenced block, else the whole text, trimmed."""
    body = F.regexp_extract(_c(x), r"(?s)```[A-Za-z0-9_+-]*\n(.*?)```", 1)
    return F.regexp_replace(F.when(body != "", body).otherwise(_c(x)), r"^\s+|\s+$", "")


def normalized_sql(x) -> Column:
    t = F.regexp_replace(F.trim(code_block(x)), r";\s*$", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, r"--[^\n]*", " "), r"\s+", " ")))


def file_blocks(x, most_bytes: int = 120_000, strict: bool = False) -> Column:
    """map(path, body) of ``FILE: path`` blocks, the last of a path.

    Absolute, upward and back-slashed paths and bodies over the limit are left out; with ``strict`` they raise, as
    does a text without blocks.
    """
    pattern = r"(?s)FILE:\s*([^\n`]+?)\s*\n```[A-Za-z0-9_+-]*\n(.*?)```"
    t = F.regexp_replace(_c(x), r"(?s)<think>.*?</think>", "")
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("p"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("b"))
    unsafe = lambda s: s["p"].startswith("/") | F.array_contains(F.split(s["p"], "/"), "..") | s["p"].contains("\\")
    large = lambda s: F.octet_length(s["b"]) > most_bytes

    def blocks(z: Column) -> Column:
        fit = F.filter(z, lambda s: ~unsafe(s) & ~large(s))
        out = let(fit, lambda f: F.map_from_entries(F.transform(F.filter(f, lambda s, i: ~F.exists(F.slice(f, i + 2, F.size(f)), lambda o: o["p"] == s["p"])), lambda s: F.struct(s["p"], s["b"]))))
        if not strict:
            return out
        wrong = lambda test, says: F.raise_error(F.concat(F.lit(says), F.element_at(F.filter(z, test), 1)["p"])).cast("map<string,string>")
        return F.when(F.size(z) == 0, F.raise_error(F.lit("no FILE blocks")).cast("map<string,string>")).when(F.exists(z, unsafe), wrong(unsafe, "unsafe file path: ")).when(F.exists(z, large), wrong(large, "file too large: ")).otherwise(out)

    return let(pairs, blocks)


def support_spans(chunk_id, x, width: int = 60, overlap: int = 10, limit: int = 600, most: int | None = 24) -> Column:
    """array(struct(span_id, text)): windows of at most ``width`` whole words and ``limit`` characters, numbered as kept.

    The next window starts ``overlap`` words before the end of the last, one word on at least. A longer word makes a
    window of its own; windows under 20 characters are left out. Chunks give at most 24; None is for whole documents.
    """
    state = "struct<at:int,out:array<struct<s:int,e:int>>>"

    def fitting(w: Column, at: Column) -> Column:
        add = lambda a, t: F.when((a["chars"] >= 0) & (a["chars"] + F.length(t) <= limit), F.struct((a["n"] + 1).alias("n"), (a["chars"] + F.length(t) + 1).alias("chars"))).otherwise(F.struct(a["n"].alias("n"), F.lit(-1).alias("chars")))
        return F.greatest(F.aggregate(F.slice(w, at + 1, width), F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars")), add, lambda a: a["n"]), F.lit(1))

    def windows(w: Column) -> Column:
        def step(a: Column, _: Column) -> Column:
            following = lambda e: F.when(e >= F.size(w), F.size(w)).otherwise(F.greatest(a["at"] + 1, e - overlap))
            moved = let(a["at"] + fitting(w, a["at"]), lambda e: F.struct(following(e).alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("s"), e.alias("e"))).alias("out")).cast(state))
            return F.when(a["at"] < F.size(w), moved).otherwise(a)

        # Every window starts at a later word than the last, so there are no more windows than words.
        spans = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(state), step, lambda a: a["out"])
        return F.filter(F.transform(spans, lambda p: F.array_join(F.slice(w, p["s"] + 1, p["e"] - p["s"]), " ")), lambda t: F.length(t) >= 20)

    texts = let(F.filter(F.split(normalize_text(x), " "), lambda t: t != ""), windows)
    return F.transform(texts if most is None else F.slice(texts, 1, most), lambda t, i: F.struct(F.concat(chunk_id, F.lit("::span-"), F.format_string("%03d", i + 1)).alias("span_id"), t.alias("text")))


def marker_coverage(x, groups: dict[str, list[str]]) -> Column:
    """Names of the capabilities of which a text holds any marker, ignoring case."""
    low = F.lower(_c(x))
    hit = lambda markers: F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(low, m))
    return F.array_compact(F.array(*[F.when(hit(m), name) for name, m in groups.items()]))


def headings(x) -> Column:
    """Titles of Markdown headings, in order."""
    return F.regexp_extract_all(_c(x), F.lit(r"(?m)^#{1,6}\s+(.+?)\s*$"), F.lit(1))


def clipped(x, most: int, marker: str = " [clipped]") -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(_c(x), F.lit(most)), F.lit(marker))).otherwise(_c(x))
