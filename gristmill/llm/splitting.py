"""Problem 4: splitting oversized texts at natural boundaries near content-defined landmarks."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gristmill.session import spread, table

#: Code points of a piece at most, of the new text in it at least, and shared with the piece before.
LIMIT, LEAST, OVERLAP = 4200, 1400, 400
BLANK_LINES = re.compile(r"\n[ \t\r]*\n")
#: Natural boundaries from the strongest to the weakest; a cut comes after the match.
BOUNDARIES = [
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？]")),
    ("word", re.compile(r"\s+")),
]


def landmarks(text: str) -> np.ndarray:
    """A rolling hash at every position, of the 32 code points up to it; equal contexts give equal hashes."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = c * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    for step in (1, 2, 4, 8, 16):  # after each step a hash covers twice as many code points
        h[step:] += h[:-step] << np.uint64(step)
    return h * np.uint64(0x94D049BB133111EB)


def cut_points(text: str, limit: int, least: int, overlap: int) -> list[tuple[int, str]]:
    """(end, kind of boundary) of each piece's new text; see cuts()."""
    return [c[:2] for c in cuts(text, limit, least, overlap)]


def word_start(text: str, at: int, most: int) -> int:
    """The start of the word that holds place ``at``, if it lies within ``most`` code points before, else ``at``."""
    low = at
    while low > 0 and at - low < most and not text[low - 1].isspace():
        low -= 1
    return low if low == 0 or text[low - 1].isspace() else at


def cuts(text: str, limit: int, least: int, overlap: int, whole_words: bool = False) -> list[tuple[int, str, int, int | None]]:
    """(end, kind of boundary, start, length of the paragraph cut through or None) of each piece.

    Between the least and the greatest allowed end lies a window. The landmark is the place of the window's least
    hash; the cut is the boundary nearest to it, of the strongest kind the window holds. Both depend on nearby
    text alone, so after an edit the cuts fall into step again within a few pieces.
    """
    n = len(text)
    if n <= limit:
        return [(n, "end", 0, None)]
    h = landmarks(text)
    ends = [(kind, np.fromiter((m.end() for m in p.finditer(text)), np.int64)) for kind, p in BOUNDARIES]
    gaps = [(m.start(), m.end()) for m in BLANK_LINES.finditer(text)]
    begins, stops = [0, *(b for _, b in gaps)], [*(a for a, _ in gaps), n]
    out, last = [], 0
    while True:
        start = max(0, last - overlap) if last else 0
        if whole_words and start:
            start = word_start(text, start, min(overlap, (limit - overlap - least)) // 2)
        most = start + limit
        if n <= most:
            out.append((n, "end", start, None))
            return out
        low = last + min(least, most - last)
        mark = low + int(np.argmin(h[low - 1 : most])) if low <= most else most
        for kind, at in ends:
            a, b = np.searchsorted(at, low, "left"), np.searchsorted(at, most, "right")
            if a < b:
                end = int(at[a:b][np.argmin(np.abs(at[a:b] - mark))])
                break
        else:  # nothing between least and limit: any boundary since the last cut, else a cut at the landmark
            for kind, at in ends:
                a, b = np.searchsorted(at, last, "right"), np.searchsorted(at, low, "left")
                if a < b:
                    end = int(at[b - 1])
                    break
            else:
                kind, end = "none", most
        k = bisect.bisect_right(begins, end - 1) - 1
        body = text[begins[k] : stops[k]]
        inside = begins[k] + len(body) - len(body.lstrip()) < end < begins[k] + len(body.rstrip())
        out.append((end, kind, start, len(body.strip()) if inside else None))
        last = end


def split_texts(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, with_text: bool = True, whole_words: bool = False) -> DataFrame:
    """keys, piece, char_start, char_end, boundary, cut_paragraph[, text]: the pieces of every text, in order.

    A piece has at most ``limit`` code points and starts ``overlap`` before the end of the piece before it; without
    the overlaps the pieces are the text. ``boundary`` is where it ends: paragraph, line, sentence, word, none (no
    boundary within the limit: cut at the limit) or end. ``cut_paragraph`` is the length of the paragraph that the
    piece's end lies in, null if it parts none. ``whole_words`` moves a start inside a word back to the word's start,
    by half of the overlap at most, so that pieces share the overlap or a little more. Null and empty texts give no rows, texts within the limit
    one; null keys and repeated rows are kept as they are; other columns are not read.
    """
    if not 0 <= overlap < limit or not 0 < least <= limit - overlap:
        raise ValueError("need 0 <= overlap < limit and 0 < least <= limit - overlap")
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "piece", "char_start", "char_end", "boundary", "cut_paragraph", *(["text"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 500):
                batch = whole.slice(part, 500)
                row, piece, start, end, kind, longest, body = [], [], [], [], [], [], []
                for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                    if not t:
                        continue
                    for j, (e, k, s, through) in enumerate(cuts(t, limit, least, overlap, whole_words)):
                        row.append(i), piece.append(j), start.append(s), end.append(e), kind.append(k), longest.append(through)
                        if with_text:
                            body.append(t[s:e])
                at = pa.array(row, pa.int32())
                cols = [batch.column(k).take(at) for k in range(len(keys))] + [pa.array(piece, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(kind, pa.string()), pa.array(longest, pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(body, pa.string())] if with_text else [])], names)

    return df.select(*keys, text).mapInArrow(run, f"{kinds}, piece int, char_start int, char_end int, boundary string, cut_paragraph int" + ", text string" * with_text)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a cut goes through a paragraph longer than a piece may be: each such paragraph has one."""
    pieces = split_texts(spread(table(spark, sf_dir, "source_document")), ["source_id", "part"], "text", with_text=False)
    return pieces.where(f"cut_paragraph > {LIMIT} and source_id is not null").select("source_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "source_document").select("source_id", "part", "text").distinct()
    return split_texts(docs, ["source_id", "part"], "text", whole_words=True)
