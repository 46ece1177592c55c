"""Problem 1: same or near-same records across splits, by counting shared rare words of all held-out records at once."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.canon import label
from gristmill.llm.grams import clean, mix, parts, word_hashes
from gristmill.session import cut, shared_dir, spread, stored, table

#: Two records overlap if they share NUM / DEN of the longer one's words.
NUM, DEN = 3, 4
#: Words which a pair must share among the first ones of its records, if it shares as many at all; counters hold up to this power of two.
HITS = 8
#: Words of a piece of the held-out side, which is broadcast; counters held at a time, in 64; words of a sketch.
HELD_WORDS, COUNTED, SKETCH_WORDS = 2_000_000, 16_384, 8
#: Words among the first ones of one in so many held-out records have their bits stored, rarer ones a list of records.
COMMON = 128

WORDS = re.compile(r"[^\W_]+")
MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&(?:[a-z]{2,8}|#\d{1,6});")


def words(text: str) -> list[str]:
    """Words without case, punctuation, white space, markup, invisible characters and character width."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if c.isascii() or unicodedata.category(c) not in ("Cf", "Mn", "Cc") or c.isspace())
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    return WORDS.findall(text.casefold())


def _order(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places in order of (row, value), ties as they come; values from -1 below 2^39 or unsigned below 2^40, rows below 2^24."""
    value = value.astype(np.int64) + (value.dtype.kind == "i")
    return np.argsort(row.astype(np.int64) << 40 | value, kind="stable")


def least_shared(n: np.ndarray) -> np.ndarray:
    """Words which a record of n words must share with any longer or equal one."""
    return -(-NUM * n // DEN)


def prepare(df: DataFrame, carry: list[str], text: str) -> DataFrame:
    """carry, n, key, toks: number of words, multiset hash and hashes of (word, occurrence) in order of each text; texts without words are left out."""
    names = [*carry, "n", "key", "toks"]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in parts(whole.column(len(carry))):
                batch = whole.slice(a, b - a)
                row, h = word_hashes(clean(batch.column(len(carry))))
                order = _order(row, h >> np.uint64(24))
                row, h = row[order], h[order]
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                nth = np.arange(len(h)) - np.repeat(new, np.diff(np.append(new, len(h))))
                tok = mix(h + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
                order = _order(row, tok >> np.uint64(24))
                row, tok = row[order], tok[order]
                at, n = np.unique(row, return_counts=True)
                starts = np.concatenate([[0], np.cumsum(n)])
                key = mix(np.add.reduceat(mix(tok), starts[:-1])) if len(at) else np.zeros(0, np.uint64)
                take = pa.array(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(carry))), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(tok.view(np.int64)))], names)

    return df.select(*carry, text).mapInArrow(run, f"{kinds}, n int, key long, toks array<long>")


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists and where each list starts, with the end."""
    size = col.value_lengths().to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def first_words(rank: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, place) of the words that may be the first HITS which a record shares with one that overlaps it, in order of rank."""
    n = np.diff(starts)
    row = np.repeat(np.arange(len(n)), n)
    order = _order(row, rank)
    inside = np.arange(len(order)) - np.repeat(starts[:-1], n)
    order = order[inside < np.repeat(n - least_shared(n) + HITS, n)]
    return row[order], order


def _add(counters: list[np.ndarray], waiting: list[np.ndarray | None], enough: np.ndarray, x: np.ndarray, k: int) -> None:
    """Adds the bits of x, which it uses up, to bit k of counters, two such arrays at a time; what runs over goes to ``enough``."""
    while k < len(counters):
        y, waiting[k] = waiting[k], None
        if y is None:
            waiting[k] = x
            return
        c = counters[k]
        over = c & y
        c ^= y
        np.bitwise_and(c, x, out=y)
        c ^= x
        over |= y
        x, k = over, k + 1
    enough |= x


def sketches(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits of each record's words: a word that another record lacks clears at most one bit of the common ones."""
    bit = (flat.view(np.uint64) % np.uint64(SKETCH_WORDS * 64)).astype(np.int64)
    bits = np.zeros((len(starts) - 1) * SKETCH_WORDS, np.uint64)
    np.bitwise_or.at(bits, np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * SKETCH_WORDS + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return bits.reshape(-1, SKETCH_WORDS)


class HeldIndex:
    """Held-out classes in order of length, as bits (or, of rare words, lists) of those that have a word among their first ones.

    Words are ordered from the rarest, in any order of the text. Records that share k words share at least min(HITS, k)
    among the first n - k + HITS of each, in any order common to both sides.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, flat: np.ndarray):
        self.key, self.n = key, n.astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(self.n)])
        self.vocabulary, word, count = np.unique(flat, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(count), np.int64)
        self.rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        self.bits = sketches(flat, starts)
        owner = np.repeat(np.arange(len(self.n)), self.n)
        self.pairs = np.sort(owner * len(count) + word)  # (class, word), for the exact count
        row, at = first_words(self.rank[word], starts)
        row, at = row[order := np.argsort(word[at], kind="stable")], word[at][order]
        self.lists, self.first = row, np.searchsorted(at, np.arange(len(count) + 1))
        many = np.diff(self.first)
        self.slot = np.where(many * COMMON > len(self.n), np.cumsum(many * COMMON > len(self.n)), 0)  # 0: a list
        self.sets = np.zeros((int(self.slot.max(initial=0)) + 1, len(self.n) + 63 >> 6), np.uint64)
        stored = self.slot[at] > 0
        row, at = row[stored], self.slot[at[stored]]
        np.bitwise_or.at(self.sets.reshape(-1), at * self.sets.shape[1] + (row >> 6), np.uint64(1) << (row & 63).astype(np.uint64))

    def candidates(self, n: np.ndarray, word: np.ndarray, known: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(record, class) of the pairs that share enough of their first words, of lengths near each other."""
        row, at = first_words(np.where(known, self.rank[word], -1), starts)
        kept = known[at]  # other words take their place, but are in no class
        row, at = row[kept], word[at[kept]]
        many = np.bincount(row, minlength=len(n))
        first = np.cumsum(many) - many
        records = np.argsort(n, kind="stable")
        records = records[many[records] >= np.minimum(HITS, least_shared(n[records]))]
        lo = 0
        while lo < len(records):
            # classes that match any of the records, by words of 64
            a = int(np.searchsorted(self.n, least_shared(n[records[lo]]))) >> 6
            size = max(1, COUNTED // max(1, self.sets.shape[1] - a))
            own = records[lo : lo + size]
            own = own[n[own] <= max(2 * n[own[0]], 16)]
            own = own[: max(1, COUNTED * 64 // int(many[own].max()))]
            lo += len(own)
            b = int(np.searchsorted(self.n, n[own[-1]] * DEN // NUM, "right")) + 63 >> 6
            if b <= a:
                continue
            steps = int(many[own].max())
            place = np.arange(steps)
            inside = place < many[own][:, None]
            words = np.where(inside, at[np.minimum(first[own][:, None] + place, len(at) - 1)], -1)
            slots = np.where(inside, self.slot[words], 0)
            i, j = np.nonzero(inside & (slots == 0))
            i, j, w = i[order := np.argsort(j, kind="stable")], j[order], words[i, j][order]
            size = self.first[w + 1] - self.first[w]
            c = self.lists[np.repeat(self.first[w] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            i, j = np.repeat(i, size), np.repeat(j, size)
            near = (c >> 6 >= a) & (c >> 6 < b)
            i, j, c = i[near], j[near], c[near]
            cell, bit = i * (b - a) + (c >> 6) - a, np.uint64(1) << (c & 63).astype(np.uint64)
            part = np.searchsorted(j, np.arange(steps + 1))
            # three bits of a counter for each class, 64 classes at once, from what is not needed of HITS; enough once they run over
            given = HITS - np.minimum(HITS, least_shared(n[own]))
            counters = [np.repeat(np.where(given >> k & 1, ~np.uint64(0), np.uint64(0))[:, None], b - a, 1) for k in range(HITS.bit_length() - 1)]
            enough, waiting = np.zeros((len(own), b - a), np.uint64), [None] * len(counters)
            for k in range(steps):
                x = self.sets[slots[:, k], a:b]
                if part[k] < part[k + 1]:
                    np.bitwise_or.at(x.reshape(-1), cell[part[k] : part[k + 1]], bit[part[k] : part[k + 1]])
                _add(counters, waiting, enough, x, 0)
            for k in range(len(counters)):
                if waiting[k] is not None:
                    _add(counters, waiting, enough, np.zeros_like(enough), k)
            i, j = np.nonzero(enough)
            k, bit = np.nonzero(np.unpackbits(enough[i, j].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield own[i[k]], (j[k] + a << 6) + bit

    def search(self, n: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(record, class, words shared) of every overlapping pair."""
        none = np.zeros(0, np.int64)
        if not len(self.n) or not len(n):
            return none, none, none
        word = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        known = self.vocabulary[word] == flat
        out, bits = [], sketches(flat, starts)
        for r, c in self.candidates(n, word, known, starts):
            for lo in range(0, len(r), 500_000):
                a, b = r[lo : lo + 500_000], c[lo : lo + 500_000]
                least = least_shared(np.maximum(n[a], self.n[b]))
                likely = np.minimum(n[a], self.n[b]) >= least
                likely &= n[a] - np.bitwise_count(bits[a] & ~self.bits[b]).sum(1, dtype=np.int64) >= least
                likely &= self.n[b] - np.bitwise_count(self.bits[b] & ~bits[a]).sum(1, dtype=np.int64) >= least
                out.append((a[likely], b[likely], least[likely]))
        if not out:
            return none, none, none
        r, c, least = (np.concatenate(x) for x in zip(*out))
        shared = np.zeros(len(r), np.int64)
        for lo in range(0, len(r), 50_000):  # the exact check: whole multisets of words
            s = slice(lo, lo + 50_000)
            size = n[r[s]]
            t = np.repeat(starts[r[s]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wanted = np.repeat(c[s], size) * len(self.vocabulary) + word[t]
            hit = (self.pairs[np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)] == wanted) & known[t]
            shared[s] = np.bincount(np.repeat(np.arange(len(size)), size)[hit], minlength=len(size))
        good = shared >= least
        return r[good], c[good], shared[good]


_FOUND = ["key_eval", "key_train", "shared", "n_eval", "n_train"]
_KINDS = "key_eval long, key_train long, shared int, n_eval int, n_train int"


#: The index that this Python worker built last, by the id of its piece.
_built: dict[str, HeldIndex] = {}


def _pieces(held: DataFrame) -> list[tuple[int, int, int, int]]:
    """(shortest, longest, part, parts): lengths of held-out classes of HELD_WORDS words at most together, or parts of one length."""
    out: list[tuple[int, int, int, int]] = []
    lo = hi = words = 0
    for n, many in held.groupBy("n").count().orderBy("n").collect():
        if words and words + n * many > HELD_WORDS:
            out.append((lo, hi, 0, 1))
            words = 0
        if (parts := min(many, -(-n * many // HELD_WORDS))) > 1:
            out += [(n, n, k, parts) for k in range(parts)]
        else:
            lo, hi, words = lo if words else n, n, words + n * many
    return [*out, (lo, hi, 0, 1)] if words else out


def _write_pairs(train: DataFrame, held: DataFrame, path: str, lo: int, hi: int, part: int, parts: int) -> None:
    """Appends the overlapping classes of one piece, by a scan of the training records of lengths near its own."""
    own = held.where((F.col("n") >= lo) & (F.col("n") <= hi) & (F.pmod(F.col("key"), F.lit(parts)) == part)).select("key", "n", "toks").toArrow().sort_by("n").combine_chunks()
    if not own.num_rows:
        return
    toks = own.column("toks").combine_chunks()
    flat = _flat(toks.combine_chunks() if isinstance(toks, pa.ChunkedArray) else toks)[0]
    shared = train.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, own.column("key").to_numpy(), own.column("n").to_numpy(), flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, *held = shared.value
        for b in batches:
            if name not in _built:
                _built.clear()
                _built[name] = HeldIndex(*held)
            h = _built[name]
            _, one = np.unique(b.column(0).to_numpy(), return_index=True)  # copies are one class
            b = b.take(pa.array(one))
            n = b.column(1).to_numpy().astype(np.int64)
            r, c, shared_ = h.search(n, *_flat(b.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(h.key[c]), pa.array(b.column(0).to_numpy()[r]), pa.array(shared_.astype(np.int32)), pa.array(h.n[c].astype(np.int32)), pa.array(n[r].astype(np.int32))], _FOUND)

    near = train.where((F.col("n") * DEN >= NUM * lo) & (F.col("n") * NUM <= DEN * hi)).select("key", "n", "toks")
    near.mapInArrow(run, _KINDS).write.mode("append").parquet(path)
    shared.destroy()


def class_pairs(prepared: DataFrame, is_eval: str) -> DataFrame:
    """(key_eval, key_train, shared, n_eval, n_train): overlapping classes of equal multisets, one evaluation, one training.

    The evaluation side is broadcast in pieces of like lengths, one after another, and training records of lengths that
    can match are scanned for each; nothing that grows with the pairs of words is shuffled. Exact for any size.
    Copies of a text are one class, so they add no pairs here.
    """
    spark, path = prepared.sparkSession, f"{shared_dir(prepared.sparkSession)}/table-{uuid.uuid4().hex}"
    train = prepared.where(f"not {is_eval}")
    held = stored(prepared.where(is_eval).groupBy("key").agg(F.first("n").alias("n"), F.first("toks").alias("toks")))
    spark.createDataFrame([], _KINDS).write.parquet(path)
    for piece in _pieces(held):
        _write_pairs(train, held, path, *piece)
    return spark.read.schema(_KINDS).parquet(path).distinct()


def split_overlaps(rows: DataFrame, record: str, split: str, text: str, carry: list[str], train: str = "train") -> DataFrame:
    """Pairs of a training and a held-out record: record_train, record_eval, shared, containment, same_id, carried columns of the held-out one.

    containment is the share of the evaluation record's words found in the training record; for pairs of one id
    with unlike texts it and shared are null. Null and blank texts are no case, null ids and splits neither; a
    record with rows on both sides pairs with itself; repeated rows give one pair. Tables without one of the sides
    give no rows.
    """
    known = rows.where(F.col(record).isNotNull() & F.col(split).isNotNull()).select(F.col(record).alias("record"), F.col(split).alias("split"), (F.col(split) != train).alias("is_eval"), *carry, F.col(text).alias("_text"))
    prepared = stored(prepare(known, ["record", "split", "is_eval", *carry], "_text"))
    classes = cut(class_pairs(prepared, "is_eval"))
    ids = prepared.select("record", "split", "is_eval", "key", *carry).distinct()
    held = ids.where("is_eval").select(F.col("record").alias("record_eval"), F.col("key").alias("key_eval"), "split", *carry)
    kept = ids.where("not is_eval").select(F.col("record").alias("record_train"), F.col("key").alias("key_train")).distinct()
    near = classes.join(held, "key_eval").join(kept, "key_train").select("record_train", "record_eval", "shared", (F.col("shared") / F.col("n_eval")).alias("containment"), "split", *carry)
    same = held.join(kept.select(F.col("record_train")).distinct(), F.col("record_train") == F.col("record_eval")).select("record_train", "record_eval", F.lit(None).cast("int").alias("shared"), F.lit(None).cast("double").alias("containment"), "split", *carry)
    out = near.union(same).groupBy("record_train", "record_eval", "split", *carry).agg(F.max("shared").alias("shared"), F.max("containment").alias("containment"))
    return out.withColumn("same_id", F.col("record_train") == F.col("record_eval"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "episode")).select("episode_id", "split", label("source_group", "-").alias("source_group"), F.col("input.user_request").alias("user_request"))
    return split_overlaps(rows, "episode_id", "split", "user_request", ["source_group"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.least("record_train", "record_eval").alias("episode_id_a"), F.greatest("record_train", "record_eval").alias("episode_id_b")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping held-out episodes and pairs by split and source group."""
    return _pairs(spark, sf_dir).groupBy("split", "source_group").agg(F.countDistinct("record_eval").alias("episodes"), F.countDistinct("record_train", "record_eval").alias("pairs"), F.sum(F.col("same_id").cast("long")).alias("same_id"))
