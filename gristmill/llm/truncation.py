"""Problem 10: texts cut off by field limits, from lengths under alternative encodings and from endings."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.session import maybe_broadcast, spread, stored, table

_LINES = re.compile(r"\r\n|\r|\n")
#: The ways in which a store may have counted a text.
LENGTHS = {
    "characters": len,
    "utf8_bytes": lambda s: len(s.encode("utf-8", "surrogatepass")),
    "utf16_units": lambda s: len(s.encode("utf-16-le", "surrogatepass")) // 2,
    "latin1_or_entities": lambda s: len(s.encode("latin-1", "xmlcharrefreplace")),
    "html_escaped": lambda s: len(html.escape(s, quote=True)),
    "html_escaped_text": lambda s: len(html.escape(s, quote=False)),
    "json_escaped": lambda s: len(json.dumps(s)) - 2,
    "json_escaped_bytes": lambda s: len(json.dumps(s, ensure_ascii=False).encode("utf-8", "surrogatepass")) - 2,
    "crlf_lines": lambda s: len(s) + len(_LINES.findall(s)) - s.count("\r\n") * 2 + s.count("\r\n"),
    "lf_lines": lambda s: len(s) - s.count("\r\n"),
}

#: Marks of a cut that say so, and dots that mean one unless a sentence ended before them.
SAID = re.compile(r"(?:\[\s*(?:truncated|cut|snip|more|continued|text truncated|\.\.\.|…)\s*\]|\((?:truncated|cut off|continued|more)\)|<truncated>|\[\+\d+ chars\])$", re.I)
ESCAPE = re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,3})?|&(?:[A-Za-z]{1,7}|#x?[0-9A-Fa-f]{0,6})?|<[/!]?[A-Za-z]*|%[0-9A-Fa-f]?|[‌‍])$")
_CLOSERS = "\"'”’»)]*_`"
_CLOSED = re.compile(r"</\w+>$")
LIST = re.compile(r"^\s*(?:[-*•‣◦–+]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)])\s+\S")
HEADING = re.compile(r"^\s*(?:#{1,6}(?:\s|$)|={3,}|-{3,}|\*{3,}|_{3,})")
SIGNED = re.compile(r"^\s*(?:--|—|–)\s*\S")
LABELLED = re.compile(r"^\s*[^\W\d_][^.:=!?]{0,40}[:=≈]\s*[-+]?[\d.,]+\s*[^\W\d_%€$]*[%€$]?$")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Words that hold prose together, of the languages in use; titles and lists have few of them.
GLUE = frozenset(
    "the a an of and or to in on at by for from with that which than as if when while before after until because so not no is are was were be it its this these each every any under into without whether only both nor neither but then there their has have had "
    "der die das den dem des ein eine einen einem einer und oder nicht ist sind war wird werden muss mit ohne nach vor bei von zu zum zur im am auf für wenn weil dass als wie noch nur alles was sich "
    "le la les un une des du de et ou ne pas est sont que qui dans sur avec sans avant après pour par il elle se si ce cette tout plus au aux "
    "el los las una unos y o no es son se lo del al en con sin por para antes después que como si todo más ya hay".split()
)


#: Endings that show a cut.
CUT = ("mark", "character", "block", "record", "row", "escape", "sentence")


def done(t: str) -> bool:
    """Whether a text ends with a sentence, before closing quotes, brackets, marks and tags."""
    while True:
        t = t.rstrip(_CLOSERS)
        if not t.endswith(">"):
            return t.endswith((".", "!", "?", "。", "！", "？", "؟"))
        at = t.rfind("</")
        if at < 0 or not _CLOSED.match(t[at:]):
            return False
        t = t[:at]


def open_record(text: str) -> bool:
    """Whether a JSON text stops within a string or before its brackets are closed."""
    depth, quoted = 0, False
    for c in re.findall(r'\\.|["{}\[\]]', text, re.S):
        if quoted:
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return quoted or depth > 0


def ending(text: str) -> str:
    """How a text ends: complete, or by what it shows to be cut (mark, character, escape, block, record, row,
    sentence), or unsure: no sentence end, yet nothing that must go on, as in lists, headings and labels (later "word" if its last word is broken)."""
    t = text.rstrip()
    if not t:
        return "complete"
    tail = t[-64:]  # longer than any mark or escape
    if SAID.search(tail) or (t.endswith(("…", "...")) and not done(t[: -1 if t[-1] == "…" else -3].rstrip() or ".")):
        return "mark"
    if t[-1] == "�":
        return "character"
    if t.count("```") % 2:
        return "block"
    if t[0] in "{[" and '"' in t and open_record(t):
        return "record"
    if t.endswith("```"):
        return "complete"
    at = t.rfind("\n") + 1
    last, line = t[at:].strip(), t[t.rfind("\n", 0, max(0, at - 1)) + 1 : max(0, at - 1)]
    if last.startswith("|") or line.lstrip().startswith("|"):
        return "complete" if last.endswith("|") else "row"
    if done(t):
        return "complete"
    if t[0] in "{[" and t[-1] in "}]":
        return "complete"
    if ESCAPE.search(tail) and not last.endswith(("&", "%")):
        return "escape"
    if HEADING.match(last) or SIGNED.match(last) or LABELLED.match(last):
        return "unsure"
    if LIST.match(last):
        return "sentence" if re.search(r"[.!?]\s+\S", LIST.sub("", last)) and last[-1] in ",;" else "unsure"
    # prose: what follows the last sentence end of the line
    parts = re.split(r"(?<=[.!?。])[\"'”’»)\]]*\s+", last)
    if LABELLED.match(parts[-1]):
        return "unsure"
    words = [w.lower() for w in WORD.findall(parts[-1])]
    if len(parts) > 1 and WORD.search(parts[-2]):
        return "sentence"
    if last[-1] in ",;:(-–—/\"'“„«" or (words and words[-1] in GLUE):
        return "sentence"
    if re.search(r"[.!?。][\"'”’»)\]]*\s*\n", t):  # a bare beginning after finished paragraphs
        return "sentence"
    glue = sum(w in GLUE for w in words)
    if len(words) >= 5 and glue >= 2 or len(words) >= 9 and glue:
        return "sentence"
    return "unsure"


def last_word(t: str) -> str | None:
    """The word in lower case with which a text ends, None if it ends otherwise."""
    at = len(t)
    while at and (t[at - 1].isalpha() or (t[at - 1] in "'’" and at < len(t))):
        at -= 1
    return (WORD.findall(t[at:].lower()) or [None])[-1]


def measure(df: DataFrame, carry: list[str], text: str) -> DataFrame:
    """carry, ending, last_word (of unsure endings), lengths (one int for each of LENGTHS), content (a hash that copies share); null and blank texts are left out."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    names = [*carry, "ending", "last_word", "lengths", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            row, end, word, flat, content = [], [], [], [], []
            for i, t in enumerate(b.column(len(carry)).to_pylist()):
                if t and t.strip():
                    row.append(i), end.append(ending(t))
                    word.append(last_word(t.rstrip()) if end[-1] == "unsure" else None)
                    flat.extend(f(t) for f in LENGTHS.values())
                    content.append(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1)
            at = pa.array(row, pa.int32())
            lengths = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, len(LENGTHS)), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(len(carry))), pa.array(end, pa.string()), pa.array(word, pa.string()), lengths, pa.array(content, pa.int64())], names)

    return df.select(*carry, text).mapInArrow(run, f"{kinds}, ending string, last_word string, lengths array<int>, content long")


#: A limit is a length that this many different texts of a source have, all but a fiftieth of which are no longer,
#: and that is this many times as frequent as the average of the lengths within a tenth below it.
LEAST_AT, LONGER_SHARE, PEAK = 5, 0.02, 8.0


def field_limits(measured: DataFrame, source: str) -> DataFrame:
    """source, encoding, limit, n_at, n_longer: lengths at which a source's texts pile up, under each way of counting.

    Copies count once. Only the counts by (source, encoding, length) are looked at, so a source holding a third of
    all rows is aggregated before it moves.
    """
    once = measured.select(source, "content", "lengths").dropDuplicates([source, "content"])
    by = once.select(source, F.posexplode("lengths").alias("e", "length")).groupBy(source, "e", "length").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(source, "e").orderBy("length")
    below = F.sum("n").over(w.rangeBetween(-(1 << 30), 0))
    run = by.withColumn("_upto", below).withColumn("_all", F.sum("n").over(W.partitionBy(source, "e"))).withColumn("_less", F.struct("length", "_upto"))
    tenth = by.alias("a").select(F.col(source).alias("_s"), F.col("e").alias("_e"), F.col("length").alias("_l"), F.col("n").alias("_m"))
    peaks = run.where((F.col("n") >= LEAST_AT) & (F.col("_all") - F.col("_upto") <= LONGER_SHARE * F.col("_all")) & (F.col("length") >= 32))
    near = peaks.join(tenth, F.col(source).eqNullSafe(F.col("_s")) & (F.col("e") == F.col("_e")) & F.col("_l").between(F.col("length") * 0.9, F.col("length") - 1), "left")
    found = near.groupBy(source, "e", "length").agg(F.first("n").alias("n_at"), F.first(F.col("_all") - F.col("_upto")).alias("n_longer"), F.coalesce(F.sum("_m"), F.lit(0)).alias("_near"))
    found = found.where(F.col("n_at") >= PEAK * F.col("_near") / (F.col("length") * 0.1))
    return found.select(source, F.element_at(F.array(*map(F.lit, LENGTHS)), F.col("e") + 1).alias("encoding"), F.col("length").alias("limit"), "n_at", "n_longer", "e")


def inner_words(df: DataFrame, texts: list[str]) -> DataFrame:
    """(word): every word that stands somewhere but at a text's end, over all texts of the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            for column in b.columns:
                for t in column.to_pylist():
                    if t:
                        seen.update(WORD.findall(t.lower())[:-1])
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["word"])
                seen = set()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["word"])

    return df.select(*texts).mapInArrow(run, "word string").distinct()


def broken_words(measured: DataFrame, words: DataFrame) -> DataFrame:
    """(last_word): last words of unsure endings that are no words elsewhere, but beginnings of such."""
    last = measured.where("last_word is not null and length(last_word) > 1").select("last_word").distinct()
    odd = stored(last.join(words, F.col("last_word") == F.col("word"), "left_anti"))
    sizes = F.array(*[F.lit(r[0]) for r in odd.select(F.length("last_word")).distinct().collect()]).cast("array<int>")  # lengths of words
    long = words.select("word", F.filter(sizes, lambda n: n < F.length("word")).alias("_sizes"))
    starts = long.select(F.explode(F.transform("_sizes", lambda n: F.substring("word", F.lit(1), n))).alias("start"))
    return starts.join(maybe_broadcast(odd, odd.count()), F.col("last_word") == F.col("start")).select("last_word").distinct()


def judged(measured: DataFrame, source: str, words: DataFrame) -> DataFrame:
    """measured with ``at_limit`` and ``truncated``: cut by its ending, or unsure and exactly at a limit of its source or within a word."""
    limits = field_limits(measured, source)
    limits = stored(limits)
    broken = stored(broken_words(measured, words).select(F.col("last_word").alias("_broken")))
    rows = measured.join(maybe_broadcast(broken, broken.count()), F.col("last_word") == F.col("_broken"), "left").withColumn("_open", F.col("ending") == "unsure")
    rows = rows.withColumn("ending", F.when(F.col("_broken").isNotNull(), "word").otherwise(F.col("ending")))
    hit = limits.groupBy(source).agg(F.collect_set(F.struct("e", "limit")).alias("_limits")).withColumnRenamed(source, "_source")
    at = rows.join(maybe_broadcast(hit, limits.count()), F.col(source).eqNullSafe(F.col("_source")), "left")
    at_limit = F.coalesce(F.exists("_limits", lambda x: F.element_at("lengths", x["e"] + 1) == x["limit"]), F.lit(False))
    return at.withColumn("at_limit", at_limit).withColumn("truncated", F.when(F.col("_open"), F.col("at_limit") | F.col("_broken").isNotNull()).otherwise(F.col("ending") != "complete")).drop("_limits", "_source", "_open", "_broken")


def truncated_texts(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """key, source, ending, at_limit of every text cut off; null and blank texts are no case, null sources are one source."""
    return judged(stored(measure(df, [key, source], text)), source, stored(inner_words(df, [text]))).where("truncated").select(key, source, "ending", "at_limit")


def truncation_rates(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """source, documents, truncated, at_limit, rate: how often each source truncates; null and blank texts count in none."""
    rows = judged(stored(measure(df, [key, source], text)), source, stored(inner_words(df, [text])))
    n, cut_off = F.count(F.lit(1)), F.sum(F.col("truncated").cast("long"))
    return rows.groupBy(source).agg(n.alias("documents"), cut_off.alias("truncated"), F.sum((F.col("truncated") & F.col("at_limit")).cast("long")).alias("at_limit"), (cut_off / n).alias("rate"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated_texts(spread(table(spark, sf_dir, "documents")), "doc_id", "text", "source").select("doc_id").distinct()


def p10_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_limits(stored(measure(spread(table(spark, sf_dir, "documents")), ["doc_id", "source"], "text")), "source").drop("e")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_rates(spread(table(spark, sf_dir, "documents")), "doc_id", "text", "source")
