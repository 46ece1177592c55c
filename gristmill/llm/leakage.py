"""Problem 6: evaluation texts leaking into training text, by a stored positional inverted index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.grams import clean, mix, parts, word_places
from gristmill.session import maybe_broadcast, spread, stored, table

#: Words of a cleaned text, as word_places() finds them.
WORDS = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
#: Least share of a query's words, in its order, that a match holds.
SHARE = 0.5
#: Terms that a window has in common with a query: one for every LEAST_EACH of the query's, ANCHORS at most. Terms are
#: looked for by their rarity in the corpus, in each of so many parts of a query.
ANCHORS, LEAST_EACH, QUARTERS = 4, 8, 4


def cleaned(texts: pa.Array) -> pa.Array:
    """clean() of texts whose words divided at line ends are joined."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    divided = pc.match_substring_regex(texts, r"\p{L}\x{00AD}?-\r?\n")
    if pc.any(divided).as_py():
        texts = pc.replace_with_mask(texts, divided, pc.replace_substring_regex(texts.filter(divided), r"(\p{L})-\r?\n[ \t]*(\p{L})", r"\1\2"))
    return clean(texts)


def stem(word: str) -> str:
    """A crude common form of inflected words, the same for queries and corpus."""
    w = word.lower()
    for end in ("ies", "ied"):
        if w.endswith(end) and len(w) > 5:
            return w[:-3] + "y"
    for end in ("ing", "ed", "es", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 4:
            w = w[: -len(end)]
            break
    return w[:-1] if len(w) > 4 and w[-1] == w[-2] else w


class Stems:
    """Hashes of words to hashes of their stems, learned word by word."""

    def __init__(self):
        self.known: dict[int, int] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, stem hash) of every word."""
        row, h, start, end, b = word_places(texts)
        one, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > 1_000_000:
            self.known.clear()
        out = np.empty(len(one), np.uint64)
        new: list[int] = []
        for i, k in enumerate(one.tolist()):
            got = self.known.get(k)
            if got is None:
                new.append(i)
            else:
                out[i] = got
        if new:
            stems = pa.array([stem(b[start[first[i]] : end[first[i]]].tobytes().decode("utf-8", "replace")) for i in new], pa.string())
            out[new] = word_places(stems)[1]
            self.known.update(zip(one[new].tolist(), out[new].tolist()))
        return row, out[back]


def terms_of(row: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, term) of texts' terms: adjacent pairs of stems."""
    first = np.searchsorted(row, row, "left")
    pair = np.flatnonzero(row[1:] == row[:-1])
    return row[pair], pair - first[pair], mix(stems[pair] * np.uint64(0x9E3779B97F4A7C15) + stems[pair + 1])


def lone_terms(row: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, term) of single words, the terms of queries of one word."""
    return row, np.arange(len(row)) - np.searchsorted(row, row, "left"), mix(stems ^ np.uint64(0x5851F42D4C957F2D))


class Queries:
    """Distinct query texts with the items they stand for: words as stems, and the terms looked for."""

    def __init__(self, queries: list[tuple[int, str, str]]):
        texts = cleaned(pa.array([t for _, _, t in queries], pa.string()))
        words = [tuple(stem(w) for w in WORDS.findall(t)) for t in texts.to_pylist()]
        number: dict[tuple[str, ...], int] = {}
        self.names: list[list[tuple[int, str]]] = []
        for (item, field, _), w in zip(queries, words):
            if w:
                if w not in number:
                    number[w] = len(number)
                    self.names.append([])
                self.names[number[w]].append((item, field))
        self.words = [list(w) for w in number]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        row, stems = Stems()(pa.array([" ".join(w) for w in self.words], pa.string()))
        a, b = terms_of(row, stems), lone_terms(row, stems)
        lone = self.sizes[b[0]] == 1
        self.query, self.offset, self.term = (np.concatenate([x, y[lone]]) for x, y in zip(a, b))
        self.term = self.term.view(np.int64)

    def needed(self) -> np.ndarray:
        """Terms that a match of each query has at least."""
        return np.clip((self.sizes - 1) // LEAST_EACH, 1, ANCHORS)

    def rarest(self, count: dict[int, int]) -> np.ndarray:
        """Places of the terms looked for: the rarest third of each quarter of a query, so that common wording leads nowhere.

        Any half of a query holds one of its quarters whole, so a half that many texts hold is found like any other.
        """
        c = np.array([count.get(t, 0) for t in self.term.tolist()], np.int64)
        pairs = np.maximum(1, self.sizes - 1)[self.query]
        quarter = self.query * QUARTERS + np.minimum(QUARTERS - 1, self.offset * QUARTERS // pairs)
        order = np.lexsort((self.offset, c, quarter))
        size = np.bincount(quarter, minlength=len(self.sizes) * QUARTERS)
        inside = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        return order[inside < np.repeat(-(-size // 3), size)]


class Aligner:
    """Whole texts of queries against windows of a text, word by word."""

    def __init__(self, words: list[list[str]]):
        self.words, self.sizes = words, [len(w) for w in words]
        self.masks, self.near = {}, {}

    @staticmethod
    def _mask(q: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, w in enumerate(q):
            out[w] = out.get(w, 0) | 1 << i
        return out

    @staticmethod
    def _near(q: list[str]) -> dict[str, int]:
        """Places by every form of a word with one letter left out, for words one edit away."""
        out: dict[str, int] = {}
        for i, w in enumerate(q):
            if len(w) >= 4:
                for f in {w, *(w[:j] + w[j + 1 :] for j in range(len(w)))}:
                    out[f] = out.get(f, 0) | 1 << i
        return out

    def place(self, x: int, word: str) -> int:
        if x not in self.masks:
            self.masks[x], self.near[x] = self._mask(self.words[x]), self._near(self.words[x])
        w = stem(word)
        m = self.masks[x].get(w, 0)
        if m or len(w) < 4 or w.isdigit():
            return m
        near = self.near[x]
        for f in (w, *(w[:j] + w[j + 1 :] for j in range(len(w)))):
            m |= near.get(f, 0)
        return m

    def align(self, x: int, text: list[str]) -> tuple[int, int, int]:
        """(words of query x found in order, first, last place): a longest common subsequence.

        The row after each text word is kept, one bit a query word, so the matched places can be walked back; matches standing alone on
        both sides, as common words in unlike text do, are not counted.
        """
        n = self.sizes[x]
        full = (1 << n) - 1
        row, rows, masks = full, [full], []
        for w in text:
            m = self.place(x, w)
            u = row & m
            row = ((row + u) | (row - u)) & full
            masks.append(m)
            rows.append(row)
        pairs = []
        j, top = len(text), n
        while j and top:
            gained = ~rows[j] & ((1 << top) - 1)
            if not gained:
                break
            i = gained.bit_length() - 1  # the last query word that ends a longer match
            while j and not rows[j - 1] >> i & 1:
                j -= 1
            if not masks[j - 1] >> i & 1:
                top = i
                continue
            pairs.append((i, j - 1))
            j, top = j - 1, i
        pairs.reverse()
        kept = pairs if n == 1 else [p for k, p in enumerate(pairs) if (k and p[0] - pairs[k - 1][0] <= 2 and p[1] - pairs[k - 1][1] <= 2) or (k + 1 < len(pairs) and pairs[k + 1][0] - p[0] <= 2 and pairs[k + 1][1] - p[1] <= 2)]
        return (len(kept), kept[0][1], kept[-1][1]) if kept else (0, 0, 0)



#: Parts over which a term's postings are dealt, so that no task holds all of a common one.
SALT = 16


def postings(docs: DataFrame, doc: str, text: str, queries: Queries) -> DataFrame:
    """(term, doc, places): the positional index of the corpus, stored in order of terms: a term's places in one text together.

    It holds the postings of the terms that some query has; others are never asked for.
    """
    shared = docs.sparkSession.sparkContext.broadcast((np.unique(queries.term), bool((queries.sizes == 1).any())))
    names = ["term", "doc", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, lone = shared.value
        quick = np.zeros(1 << 20, bool)
        quick[wanted & 0xFFFFF] = True
        stems = Stems()

        def asked(t: np.ndarray) -> np.ndarray:
            maybe = np.flatnonzero(quick[t & 0xFFFFF])
            return maybe[wanted[np.minimum(np.searchsorted(wanted, t[maybe]), len(wanted) - 1)] == t[maybe]]

        for whole in batches:
            for a, b in parts(whole.column(1)):
                row, s = stems(cleaned(whole.column(1).slice(a, b - a)))
                found = [(r, p, t.view(np.int64)) for r, p, t in (terms_of(row, s), *([lone_terms(row, s)] if lone else []))]
                r, p, t = (np.concatenate(x) for x in zip(*((r[k], p[k], t[k]) for r, p, t in found for k in [asked(t)])))
                order = np.lexsort((p, r, t))
                t, r, p = t[order], r[order], p[order]
                new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (r[1:] != r[:-1]))) if len(t) else np.zeros(0, np.int64)
                doc = whole.column(0).slice(a, b - a).take(pa.array(r[new]))
                places = pa.ListArray.from_arrays(pa.array(np.append(new, len(p)).astype(np.int32)), pa.array(p.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(t[new]), doc, places], names)

    found = docs.select(doc, text).mapInArrow(run, "term long, doc long, places array<int>")
    return stored(found.repartition("term", F.pmod("doc", F.lit(SALT))).sortWithinPartitions("term", "doc"))


def find_passages(corpus: DataFrame, keys: list[str], text: str, queries: list[tuple[int, str, str]]) -> DataFrame:
    """keys, item_id, field, words_found, words_asked, first_word, last_word, kind: every passage of a query in a text.

    queries: (item_id, field, text). Postings of their terms, adjacent pairs of words, are stored; each query's lists
    are met from its rarest terms on, with offsets adjusted, and a window in which enough of them meet is compared
    word by word. A match holds at least half of the query's words in its order, among them some of its rarest
    terms as written (one of up to 16 words, 4 of more than 32); ``kind`` is "phrase" if all between its ends stand
    side by side, else "proximity". Of several matches of a query in one text the longest counts. Null and blank
    texts and queries match nothing; equal queries match alike; repeated rows give repeated matches; other columns
    are not read.
    """
    q = Queries([x for x in queries if x[2]])
    spark = corpus.sparkSession
    kinds = ", ".join(f"`{k}` {corpus.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "item_id", "field", "words_found", "words_asked", "first_word", "last_word", "kind"]
    schema = f"{kinds}, item_id long, field string, words_found int, words_asked int, first_word int, last_word int, kind string"
    if not q.words:
        return spark.createDataFrame([], schema)
    rows = corpus.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"), F.xxhash64(*keys, text).alias("_doc"))
    index = postings(rows, "_doc", "_text", q)
    counts = {r["term"]: r["n"] for r in index.groupBy("term").agg(F.sum(F.size("places")).alias("n")).collect()}  # terms of queries only
    at = q.rarest(counts)
    asked = spark.createDataFrame(pa.table({"term": q.term[at], "query": q.query[at].astype(np.int32), "offset": q.offset[at].astype(np.int32), "size": q.sizes[q.query[at]].astype(np.int32), "needed": q.needed()[q.query[at]].astype(np.int32)}))
    # places from which the query would start: a match's differ by what is inserted, so each lies in two wide bins
    stride = F.col("size") + 20
    bin_ = F.floor((F.col("pos") - F.col("offset")) / stride).cast("int")
    met = index.join(maybe_broadcast(asked, len(at)), "term").select("doc", "query", F.explode("places").alias("pos"), "offset", "size", "needed").select("doc", "query", "pos", "offset", "needed", F.explode(F.array(bin_, bin_ - 1)).alias("bin"))
    windows = met.groupBy("doc", "query", "bin").agg(F.countDistinct("offset").alias("n"), F.first("needed").alias("needed"), F.min(F.struct("pos", "offset")).alias("a"), F.max(F.struct("pos", "offset")).alias("b")).where("n >= needed")
    wanted = stored(windows.groupBy("doc").agg(F.collect_set(F.struct("query", F.col("a.pos").alias("low"), F.col("a.offset").alias("low_at"), F.col("b.pos").alias("high"), F.col("b.offset").alias("high_at"))).alias("_windows")).withColumnRenamed("doc", "_doc"))
    shared = spark.sparkContext.broadcast((q.words, q.names))
    near = rows.join(maybe_broadcast(wanted, wanted.count()), "_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, items = shared.value
        aligner = Aligner(words)
        for b in batches:
            texts = cleaned(b.column(len(keys)))
            out: list[tuple] = []
            for i, (t, windows) in enumerate(zip(texts.to_pylist(), b.column(len(keys) + 1).to_pylist())):
                spoken, best = WORDS.findall(t), {}
                for w in windows:
                    x = w["query"]
                    n = aligner.sizes[x]
                    low, high = max(0, w["low"] - w["low_at"] - 25), w["high"] + n - w["high_at"] + 25
                    for s in range(low, max(low + 1, high - 2 * n - 50 + n), n):
                        got = aligner.align(x, spoken[s : min(high, s + 2 * n + 50)])
                        if got[0] > best.get(x, (0,))[0]:
                            best[x] = (got[0], s + got[1], s + got[2])
                for x, (n, a, z) in sorted(best.items()):
                    if n >= SHARE * aligner.sizes[x]:
                        out += [(i, item, field, n, aligner.sizes[x], a, z, "phrase" if z - a + 1 == n else "proximity") for item, field in items[x]]
            cols = list(zip(*out)) or [()] * 8
            take = pa.array(cols[0], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(len(keys))), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *(pa.array(c, pa.int32()) for c in cols[3:7]), pa.array(cols[7], pa.string())], names)

    return near.select(*keys, "_text", "_windows").mapInArrow(run, schema)


def benchmark_queries(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, str]]:
    rows = table(spark, sf_dir, "benchmark_item").where("item_id is not null").select("item_id", "question", "reference_answer").collect()
    return [(r[0], f, t) for r in rows for f, t in (("question", r[1]), ("reference_answer", r[2])) if t]


def training_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "source_document").select(F.lit("source_document").alias("record_table"), F.col("source_id").alias("record_id"), "text")
    train = table(spark, sf_dir, "episode").where("split = 'train'")
    parts = [train.select(F.lit("episode").alias("record_table"), F.col("episode_id").alias("record_id"), F.col(c).alias("text")) for c in ("input.user_request", "integration.published_answer")]
    return spread(docs.union(parts[0]).union(parts[1])).where("record_id is not null")


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(training_texts(spark, sf_dir), ["record_table", "record_id"], "text", benchmark_queries(spark, sf_dir)).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_matches(spark, sf_dir).select("record_table", "record_id", "item_id").distinct()
