"""Each operator against brute force or exact round trips, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import random
import re
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.llm import bpe, capping, components, grams, leakage, overlap, packing, pairs, queries, quota, selection, splits, splitting, sql, truncation

#: Columns whose names the operators use inside, as extra input columns.
CLASH = "key long, n int, words string, sig string, rank int, container long, ending string, _h long, _bin int, component long, split_ string, bin int, quota long"


def clash(df):
    have = {c.lower() for c in df.columns}
    for c in CLASH.split(", "):
        name, kind = c.split(" ")
        if name.lower() not in have:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


# --- selection and 3 ---


def test_take_quota_and_rank_match_sorting(spark):
    rng = random.Random(1)
    rows = [("abc"[min(2, int(rng.random() * 4))], i, rng.choice([0, 0, 1, 5]), rng.randrange(1000)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i long, q int, h int")
    q = spark.createDataFrame([("a", 50), ("b", 100000), ("c", 0)], "g string, quota long")
    got = {(r.g, r.i) for r in selection.take_quota(df, ["g"], ["q", "h"], ["i"], q).collect()}
    want = set()
    for g, n in (("a", 50), ("b", 100000)):
        want |= {(g, r[1]) for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[3], r[1]))[:n]}
    assert got == want
    ranks = selection.exact_rank(df.withColumn("b", F.floor(F.col("h") / 50)), ["g"], "b", ["h", "i"]).collect()
    for g in "abc":
        mine = sorted((r.rank, r.i) for r in ranks if r.g == g)
        assert [i for _, i in mine] == [r[1] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[1]))] and [k for k, _ in mine] == list(range(1, len(mine) + 1))


def test_capping(spark):
    rows = [("a", f"x{i:03}", s) for i, s in enumerate([0.9] * 30 + [0.5] * 30 + [None, float("nan"), 7.0, -1.0])] + [("b", "y", None), (None, "z", 0.1)]
    df = clash(spark.createDataFrame(rows, "c string, i string, s double"))
    kept = capping.cap_contributors(df, "c", "i", "s", 40).collect()
    a = [r for r in kept if r.c == "a"]
    assert len(a) == 40 and sum(r.s == 0.9 for r in a) == 30 and sum(r.s == 0.5 for r in a) == 10
    assert {r.i for r in kept if r.c != "a"} == {"y", "z"} and kept[0].__fields__ == df.columns
    most = [r for r in capping.cap_contributors(df, "c", "i", "s", 62).collect() if r.c == "a"]
    assert len(most) == 62 and sum(r.s in (0.9, 0.5) for r in most) == 60
    assert capping.cap_contributors(df.limit(0), "c", "i", "s", 5).count() == 0


# --- 7 ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 997), min_size=3, max_size=3), min_size=1, max_size=5), st.integers(1, 997))
def test_controlled_rounding_keeps_margins(table, den):
    cells = {(f"r{i}", f"c{j}"): Fraction(v, den) for i, row in enumerate(table) for j, v in enumerate(row)}
    got = quota.controlled_rounding(cells)
    near = lambda x, n: x.numerator // x.denominator <= n <= -(-x.numerator // x.denominator)
    assert all(near(v, got[k]) for k, v in cells.items()) and near(sum(cells.values()), sum(got.values()))
    for axis in (0, 1):
        for name in {k[axis] for k in cells}:
            assert near(sum(v for k, v in cells.items() if k[axis] == name), sum(v for k, v in got.items() if k[axis] == name))


def test_sample_has_exact_quotas(spark):
    rows = [(f"i{i}", "x" if i % 3 else "y", "s" if i % 2 else "t") for i in range(400)] + [("n1", None, "s"), ("n2", "x", None)]
    items = clash(spark.createDataFrame(rows, "i string, a string, b string"))
    mix = spark.createDataFrame([("x", "s", 500, 1), ("x", "t", 300, 1), ("y", "s", 100, 1), ("z", "s", 100, 2), (None, "s", 9, 9)], "a string, b string, target_per_mille int, min_rows int")
    counts, n = quota.cell_counts(items, "i", "a", "b")
    q = quota.quota_table(spark, counts, mix, n, 10, "a", "b")
    got = {(r.a, r.b): (r.quota, r.unmet) for r in q.collect()}
    assert n == 402 and got["z", "s"] == (0, True) and got["x", "s"][0] in (20, 21)
    s = quota.proportional_sample(items, "i", "a", "b", q)
    assert Counter((r.a, r.b) for r in s.collect()) == {k: v for k, (v, _) in got.items() if v}
    e = items.limit(0)
    assert quota.proportional_sample(e, "i", "a", "b", q).count() == 0


# --- 5 ---


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 40)]
    df = spark.createDataFrame([*edges, (None, 1), (5, None)], "a long, b long")
    got = {}
    for r in components.connected_components(df, "a", "b").collect():
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(g) for g in got.values()} == {g for g in union_find(edges) if len(g) > 1}
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def test_allocation_is_whole_and_near_its_shares():
    rng = random.Random(2)
    bundles = {(s, p): rng.randrange(1, 40) for s in (1, 2, 3, 7, 20) for p in "ab"} | {(300, "a"): 1}
    got = splits.allocate(bundles, [80, 10, 10])
    assert all(sum(got[k]) == n for k, n in bundles.items())
    total = sum(s * n for (s, _), n in bundles.items())
    held = [sum(k[0] * x[j] for k, x in got.items()) for j in range(3)]
    assert all(abs(h - total * q / 100) <= 25 for h, q in zip(held, (80, 10, 10)))


def test_every_label_comes_near_its_shares():
    rng = np.random.default_rng(8)
    bundles = {}
    for size, n in ((1, 400), (3, 120), (12, 60), (60, 12), (300, 2)):
        for _ in range(n):
            v = tuple(rng.multinomial(size, rng.dirichlet([0.4] * 5)).tolist())
            bundles[v] = bundles.get(v, 0) + 1
    got = splits.allocate_profiles(bundles, [80, 10, 10])
    assert all(sum(got[k]) == n and min(got[k]) >= 0 for k, n in bundles.items())
    held = sum(np.outer(got[k], k) for k in bundles)
    assert np.abs(held / held.sum(0) - np.array([[0.8], [0.1], [0.1]])).max() < 0.01 and splits.allocate_profiles({}, [80, 10, 10]) == {}


@pytest.mark.parametrize("profiles", [20_000, 3])
def test_grouped_splits(spark, profiles):
    rng = random.Random(3)
    rows = [(f"e{i}", rng.choice([None, *(f"g{j}" for j in range(40))]), rng.choice([None, "n/a", " Unknown", *(f"c{j}" for j in range(60))]), rng.choice("xyz")) for i in range(500)]
    rows += rows[:50] + [("e1", "g0", "c0", None), (None, "g1", "c1", "x")]
    df = spark.createDataFrame(rows, "e string, g string, c string, d string").select("e", splits.known("g").alias("g"), splits.known("c").alias("c"), "d")
    got = {r.e: r for r in splits.grouped_splits(clash(df), "e", ["g", "c"], "d", profiles=profiles).collect()}
    assert set(got) == {r[0] for r in rows if r[0]}
    edges = [(("e", e), x) for e, g, c, _ in rows if e for x in [("g", g) if g else None, ("c", c) if c and c not in ("n/a", " Unknown") else None] if x]
    for group in union_find(edges):
        assert len({got[x[1]].split for x in group if x[0] == "e"}) == 1
    assert splits.grouped_splits(df.limit(0), "e", ["g", "c"], "d").count() == 0


# --- 8 and 9 ---


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_public_encoder(text):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary()) if not hasattr(test_bpe_equals_the_public_encoder, "t") else test_bpe_equals_the_public_encoder.t
    t.encode_special_tokens = True
    test_bpe_equals_the_public_encoder.t = t
    assert bpe.encoder(bpe.default_vocabulary()).encode(text) == t.encode(text, add_special_tokens=False).ids


def test_bpe_long_runs_are_linear(tokenizer):
    e = bpe.encoder(bpe.default_vocabulary())
    for unit in ("a", "ab", " ", "\n", "é", "<|endoftext|>"):
        text = unit * (60_000 // len(unit))
        began = time.time()
        assert e.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
        assert time.time() - began < 20


def test_encode_table(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Hi <|endoftext|> ﻿漢字 " * 500), (4, "x"), (None, "y")]
    df = clash(spark.createDataFrame(rows, "d long, t string"))
    got = [(r.d, r.ids) for r in bpe.encode_table(df, "d", "t").collect()]
    assert got == [(d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in rows]
    assert bpe.encode_table(df.limit(0), "d", "t").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_pack_is_sound(sizes):
    c, at = packing.pack(np.array(sizes, np.int64), 50)
    used = {}
    for s, b, a in sorted(zip(sizes, c, at), key=lambda x: (x[1], x[2])):
        assert used.get(b, 0) == a
        used[b] = a + s
    assert all(v <= 50 for v in used.values()) and len(used) <= max(1, 2 * -(-sum(sizes) // 50)) + 1


def test_pack_items(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 5, 300, 700, 2048, 2049, 9000, rng.randrange(1, 2000)])) for i in range(3000)] + [(9999, None)]
    df = clash(spark.createDataFrame(rows, "d long, s int"))
    got = packing.pack_items(df, "d", "s", 2048, 1000).collect()
    size = Counter()
    for r in got:
        size[r.d] += r.n_tokens
        assert r.n_tokens <= 2048 and (r.container is None) == (r.n_tokens == 0)
    assert size == Counter({d: s or 0 for d, s in rows})
    fill = Counter()
    for r in got:
        if r.container is not None:
            fill[r.container] += r.n_tokens
    assert max(fill.values()) <= 2048 and len(fill) <= 1.03 * sum(fill.values()) / 2048 + 4
    assert packing.pack_items(df.limit(0), "d", "s").count() == 0


def test_quotas_keep_margins_within_bounds():
    rng = random.Random(6)
    for _ in range(60):
        cells = {(r, c): (Fraction(rng.randrange(0, 4000), 37), rng.choice([0, 0, 0, 3]), rng.choice([0, 20, 500, 500, 500])) for r in "abcd" for c in "wxyz" if rng.random() < 0.9}
        got = quota.bounded_quotas(cells)
        assert all(min(least, have) <= got[k][1] <= have for k, (_, least, have) in cells.items())
        for axis in (0, 1):
            for x in {k[axis] for k in cells}:
                mine = [k for k in cells if k[axis] == x]
                assert sum(got[k][1] for k in mine) <= sum(got[k][0] for k in mine) + sum(min(cells[k][1], cells[k][2]) for k in mine)
        assert all(got[k][2] == (have < x or have < least) for k, (x, least, have) in cells.items())
        if all(have >= max(least, w) and least <= w for (_, least, have), (w, _, _) in zip(cells.values(), got.values())):
            assert all(w == q for w, q, _ in got.values())
    # what one cell lacks, others of its row and column make up: all margins hold
    cells = {(r, c): (Fraction(10), 0, 4 if (r, c) == ("a", "x") else 99) for r in "abc" for c in "xyz"}
    got = quota.bounded_quotas(cells)
    assert all(sum(q for (r, _), (_, q, _) in got.items() if r == x) == 30 for x in "abc") and all(sum(q for (_, c), (_, q, _) in got.items() if c == x) == 30 for x in "xyz") and got["a", "x"][1] == 4


def test_capped_jobs_keep_the_share(spark):
    sizes = {"a": 900, "b": 300, "c": 40, **{f"s{i}": 20 for i in range(30)}}
    df = spark.createDataFrame([(g, f"{g}-{i}", 0.5) for g, n in sizes.items() for i in range(n)] + [(None, f"n{i}", None) for i in range(50)], "g string, i string, s double")
    cap = capping.output_cap(df, "g", 40_000)
    kept = Counter(r.g for r in capping.cap_contributors(df, "g", "i", "s", cap).collect())
    assert max(n for g, n in kept.items() if g) <= 0.04 * sum(kept.values()) and kept[None] == 50
    more = cap + 1
    assert more > 0.04 * (50 + sum(min(n, more) for n in sizes.values()))
    assert capping.output_cap(df.where("g in ('a', 'b')"), "g", 40_000) == 0 and capping.output_cap(df.limit(0), "g", 40_000) == 0


# --- 4 ---


@pytest.mark.parametrize("text", ["word " * 3000, "\n\n".join("para " * k for k in (100, 900, 30, 1200, 800, 820)), "x" * 9000 + "\n \t\n" + "y" * 4200, "", "short", " \n\n ".join("z" * k for k in (4200, 4201, 10))])
def test_cuts_show_paragraphs_too_long(text):
    got = splitting.cuts(text, 4200, 1400, 400, whole_words=True)
    longest = max(len(p.strip()) for p in re.split(r"\n[ \t\r]*\n", text))
    assert any((c[3] or 0) > 4200 for c in got) == (longest > 4200)
    last = 0
    for end, _, start, _ in got:
        assert end - start <= 4200 and (not last or 400 <= last - start <= 600 or start == 0)
        assert start == 0 or text[start - 1].isspace() or start == last - 400
        last = end
    assert last == len(text)




def test_pieces_cover_and_overlap(spark):
    rng = random.Random(7)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(4, 15))).capitalize() + "."
    texts = ["\n\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 12))) for _ in range(40)) for _ in range(5)] + ["x" * 10_000, " \t\r\n" * 3000, "short", "", None, "a\r\n\r\nb" * 2000, "漢" * 5000 + "。" + "字" * 5000]
    df = clash(spark.createDataFrame([(f"s{i}", None if i % 2 else "p", t) for i, t in enumerate(texts)], "s string, part string, text string"))
    got = {}
    for r in splitting.split_texts(df, ["s", "part"], "text", 1000, 300, 100).collect():
        got.setdefault(r.s, []).append(r)
    for i, t in enumerate(texts):
        rows = sorted(got.get(f"s{i}", []), key=lambda r: r.piece)
        assert bool(rows) == bool(t)
        last = 0
        for r in rows:
            assert r.text == t[r.char_start : r.char_end] and len(r.text) <= 1000 and r.char_start == max(0, last - 100) and r.char_end > last
            last = r.char_end
        if t:
            assert last == len(t)
    assert {r.boundary for r in got["s5"]} == {"none", "end"} and {r.boundary for r in got["s0"]} <= {"paragraph", "line", "sentence", "word", "end"}
    assert splitting.split_texts(df.limit(0), ["s"], "text").count() == 0


def test_edits_alter_only_neighbouring_pieces():
    rng = random.Random(9)
    text = "\n\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(999)) for _ in range(60)) + "." for _ in range(400))
    ends = lambda t: [e for e, _ in splitting.cut_points(t, 4200, 1400, 400)]
    a = ends(text)
    at = len(text) // 3
    b = ends(text[:at] + "inserted words here " + text[at:])
    same = {e + 20 for e in a if e > at} & set(b)
    assert [e for e in a if e < at - 4200] == [e for e in b if e < at - 4200] and len(same) >= 0.8 * sum(e > at for e in a)


# --- 1 ---


def test_overlaps_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 70))] for _ in range(250)]
    rows = [(f"t{i}", "train", " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:120]):
        edited = [x if rng.random() > rng.choice([0.0, 0.1, 0.2, 0.3]) else rng.choice(vocabulary) for x in w]
        if i % 3 == 0:
            rng.shuffle(edited)
        rows.append((f"v{i}", rng.choice(["validation", "test"]), "<p>" + ("  ".join(edited)).upper() + "!</p>​"))
    rows += [("both", "train", "one thing"), ("both", "test", "quite another matter"), ("n", "train", None), ("m", "test", "  "), (None, "test", rows[0][2]), ("u", None, rows[0][2]), rows[0], rows[-1]]
    df = clash(spark.createDataFrame([(*r, "g") for r in rows], "id string, sp string, txt string, source_group string"))
    got = {(r.record_train, r.record_eval) for r in overlap.split_overlaps(df, "id", "sp", "txt", ["source_group"]).collect()}
    want = {("both", "both")}
    known = [(i, s, Counter(overlap.words(t))) for i, s, t in rows if i and s and t and overlap.words(t)]
    for i, s, a in known:
        for j, z, b in known:
            if s == "train" and z != "train":
                n = max(sum(a.values()), sum(b.values()))
                if 4 * sum((a & b).values()) >= 3 * n:
                    want.add((i, j))
    assert not got - want and len(want & got) >= 0.99 * len(want)
    assert overlap.split_overlaps(df.limit(0), "id", "sp", "txt", ["source_group"]).count() == 0


def _brute(rows):
    known = [(i, s, Counter(t.split())) for i, s, t in rows]
    return {(i, j) for i, s, a in known for j, z, b in known if s == "train" and z != "train" and 4 * (a & b).total() >= 3 * max(a.total(), b.total())}


def _overlaps(spark, rows):
    df = spark.createDataFrame([(*r, "g") for r in rows], "id string, sp string, txt string, source_group string")
    return {(r.record_train, r.record_eval) for r in overlap.split_overlaps(df, "id", "sp", "txt", ["source_group"]).collect()}


def test_overlaps_of_a_large_family(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(2000)]
    mould = [rng.choice(vocabulary) for _ in range(80)]
    edited = lambda p: " ".join(w if rng.random() > p else rng.choice(vocabulary) for w in mould)
    rows = [(f"t{i}", "train", edited(0.12)) for i in range(1200)] + [(f"v{i}", "test", edited(p)) for i, p in enumerate((0.0, 0.05, 0.1, 0.15))]
    assert _overlaps(spark, rows) == _brute(rows)


@pytest.mark.parametrize("held_words", [None, 10])
def test_overlaps_in_common_wording(spark, monkeypatch, held_words):
    """Records that share just the wording which everyone uses, and none of their rare words."""
    if held_words:
        monkeypatch.setattr(overlap, "HELD_WORDS", held_words)
        monkeypatch.setattr(overlap, "COMMON", 20)
    rng = random.Random(7)
    usual, fresh = [f"common{i}" for i in range(31)], iter(range(10**6))
    rows = [("v", "test", " ".join(usual + [f"r{next(fresh)}" for _ in range(9)]))]
    for i in range(2000):
        w = usual + [f"r{next(fresh)}" for _ in range(9)]
        rng.shuffle(w)
        rows.append((f"t{i}", "train", " ".join(w)))
    rows += [(f"x{i}", "train", " ".join(usual[:29] + [f"r{next(fresh)}" for _ in range(11)])) for i in range(200)]
    assert _overlaps(spark, rows) == {(f"t{i}", "v") for i in range(2000)}


@pytest.mark.parametrize("held_words", [None, 500])
def test_overlaps_near_the_threshold_by_length(spark, monkeypatch, held_words):
    if held_words:
        monkeypatch.setattr(overlap, "HELD_WORDS", held_words)
    rng = random.Random(3)
    rows, fresh = [], iter(range(10**6))
    for n in (1, 2, 4, 5, 8, 11, 12, 14, 15, 16, 20, 28, 40, 80, 700):
        for k in range(4 if n < 100 else 1):
            a = [f"w{next(fresh)}" for _ in range(n)]
            for name, kept in (("least", -(-3 * n // 4)), ("more", -(-4 * n // 5)), ("under", -(-3 * n // 4) - 1)):
                b = a[:kept] + [f"w{next(fresh)}" for _ in range(n - kept)]
                rng.shuffle(b)
                rows.append((f"{name}-{n}-{k}", "test", " ".join(b)))
            rows += [(f"t-{n}-{k}", "train", " ".join(a)), (f"shorter-{n}-{k}", "validation", " ".join(rng.sample(a, -(-3 * n // 4))))]
    want = _brute(rows)
    assert _overlaps(spark, rows) == want and {(f"t-{n}-0", f"least-{n}-0") for n in (15, 16, 20, 28, 40, 80, 700)} <= want


def test_overlaps_write_little_to_disk(spark, monkeypatch):
    """A held-out side in many pieces: every pair, and no more on disk than a few times the text."""
    monkeypatch.setattr(overlap, "HELD_WORDS", 2500)
    files = lambda: (lambda f: sum(f.apply(i).length() for i in range(f.size())))(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
    rng = random.Random(13)
    vocabulary = [f"word{i}" for i in range(900)]
    rows = [(f"t{i}", "train", " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(900)]
    for i in range(120):
        w = rows[i][2].split()
        rows.append((f"v{i}", "test", " ".join(x if rng.random() > 0.02 * (i % 20) else rng.choice(vocabulary) for x in rng.sample(w, 60 - i % 3))))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as sides too large for a broadcast are joined
    try:
        before, got = files(), _overlaps(spark, rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert files() - before < 2 * sum(len(t) for _, _, t in rows)
    assert got == _brute(rows) and 50 < len(got) < 120


def test_words_ignore_looks():
    assert overlap.words("<b>Ｆｏｏ</b> ba​r, &nbsp;“7”!") == ["foo", "bar", "7"]


# --- 2 and 10 ---


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("All is done.", "complete"), ("It was cut in the mid", "sentence"), ("It was lo…", "mark"), ("It was done... [truncated]", "mark"), ("one\n\n```python\nx = 1", "block"), ("```\nx\n```", "complete"),
        ('{"a": ["b", "c', "record"), ('{"a": ["b"]}', "complete"), ("| a | b |\n|---|---|\n| c | d", "row"), ("| a |\n|---|\n| c |", "complete"), ("text.\n\n* one\n* two", "unsure"), ("# A heading", "unsure"),
        ("Fine.\n\nTotal: 5 rows", "unsure"), ("Fine.\n\n-- filed by X", "unsure"), ("caf�", "character"), ("It was repla\\u00", "escape"), ("He said (so.)", "complete"), ("", "complete"),
    ],
)
def test_endings(text, kind):
    assert truncation.ending(text) == kind


def test_truncation(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["storage", "keeps", "every", "window", "of", "the", "index", "and", "then"]) for _ in range(n)).capitalize() + "."
    rows = [(i, (" ".join(prose(9) for _ in range(12)))[:256], "limited") for i in range(60)]
    rows += [(100 + i, prose(12) + "\n\n* keeps index\n* window", "free") for i in range(40)] + [(200, None, "free"), (201, " ", None), (202, "the index keeps win", None), (203, "Long " * 100_000 + "end.", "free"), (204, "* every\n* win", "free")]
    df = clash(spark.createDataFrame(rows, "d long, t string, s string"))
    got = {r.d: r for r in truncation.truncated_texts(df, "d", "t", "s").collect()}
    cut = {d for d, t, s in rows if s == "limited" and not t.rstrip().endswith(".")}
    assert cut <= set(got) and all(got[d].at_limit for d in cut) and not {d for d in got if 100 <= d < 200 or d in (200, 201, 203)}
    assert got[204].ending == "word" and 202 in got
    rates = {r.s: r for r in truncation.truncation_rates(df, "d", "t", "s").collect()}
    assert rates["limited"].documents == 60 and rates["limited"].truncated == len(cut)
    assert truncation.truncated_texts(df.limit(0), "d", "t", "s").count() == 0


@pytest.fixture(scope="module")
def judge(spark):
    """The classifier as trained on sf0.01."""
    return pairs.train(pairs.answered_prompts(spark, "/root/testdata/sf0.01").where("prompt is not null and record_id is not null"), "prompt", "text", "record_id")


PROMPT = "Explain why the shard of the archive falls behind the index and what the board should do before the next release. Compare two ways to restart it."
SOUND = "The shard falls behind because the index keeps every window of the archive. Move it to the next node before the release, then restart it and check the log."


@pytest.mark.parametrize(
    ("text", "defect"),
    [
        ("I'm sorry, but I can't help with that.", "refusal"), ("**My instructions do not allow this topic.**", "refusal"), ("Leider kann ich dabei nicht helfen.", "refusal"), ("No puedo ayudar con eso.", "refusal"), ("Je ne peux pas répondre.", "refusal"),
        ("I'm sorry, but I cannot help with this request. I apologise that I am unable to discuss the topic. " * 8, "refusal"),
        ("I can't see the file from here, but the fix is clear. Move the shard to the next node and restart it.", None), ("The model replied “I cannot help with that” because the flag was off.", None), ("The index cannot grow the tree alone.", None), ("Restart the node.", None),
        ("Since the test never reached the exporter, the milestone indexer cannot mirror the batch lane alone. " * 8, None),
        *[(x, "empty") for x in ("", " ", "N/A", "<p> </p>", "None", "{}", "...", "[no answer]", "Answer:", "\ufeff", None)], *[(x, None) for x in ("0", "No", "Yes", "None of them.", "Both", SOUND)],
        ("Das Archiv ist nicht so schnell wie der Index, weil die Fenster nach dem Umbau zu klein sind und die Leitung das nicht sieht.", "other_language"), ("Это не так, и мы это видим: индекс после проверки не меняется ночью.", "other_language"),
        (PROMPT.upper(), "copies_question"), ("Task: " + PROMPT.replace("board", "baord"), "copies_question"), (PROMPT + " " + SOUND, None), (SOUND[:-20], "truncated"), (SOUND + " Then the arch", "truncated"), (SOUND + "\n\n```python\nx = restart(", "truncated"), (SOUND + "\n\nTotal: 5 rows", None),
    ],
)
def test_judged_values(judge, text, defect):
    assert judge.defects(pa.array([text], pa.string()), pa.array([PROMPT])) == [defect]


def test_the_classifier_decides(judge):
    """Without its weights nothing is a defect, and with no thresholds everything is one."""
    t, p = pa.array([SOUND, "", PROMPT]), pa.array([PROMPT] * 3)
    assert pairs.LinearModel(np.zeros_like(judge.weights), judge.thresholds * 0 + 1).defects(t, p) == [None] * 3
    assert None not in pairs.LinearModel(judge.weights, judge.thresholds * 0 - 1000).defects(t, p)


def test_word_hashes_are_those_of_words():
    rng = random.Random(4)
    texts = ["", None, " ", "a", "Ünï-cödé wörds; “quoted”\u200b x", "<b>Bold</b> &nbsp; 7", *(" ".join("".join(rng.choice("abcdefgh7") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(60))) for _ in range(40)), "x" * 9000]
    row, h = grams.word_hashes(grams.clean(pa.array(texts, pa.string())))
    seen = {}
    for r, w, k in zip(row.tolist(), (w for t in texts for w in overlap.words(t or "")), h.tolist()):
        assert seen.setdefault(w, k) == k
    assert len(row) == sum(len(overlap.words(t or "")) for t in texts) and np.bincount(row, minlength=len(texts)).tolist() == [len(overlap.words(t or "")) for t in texts] and len(set(seen.values())) == len(seen)


def test_broken_pairs_on_held_out_defects(spark, sf):
    """Defects made from sound pairs in other ways than the training's are found; sound ones pass."""
    src = pairs.answered_prompts(spark, "/root/testdata/sf0.01").where("field = 'answer' and prompt is not null").orderBy("record_id")
    alike = lambda a, b: len(set(overlap.words(a)) & set(overlap.words(b))) / len(set(overlap.words(b)))
    sound = [(r.prompt, r.text) for r in src.collect() if r.text and len(r.text) > 80 and r.text.rstrip().endswith(".") and "the" in overlap.words(r.text) and "the" in overlap.words(r.prompt) and alike(r.text, r.prompt) < 0.5 and not re.search(r"\b(?:I|my|this question)\b", r.text)]
    rng = random.Random(8)
    rows, want = [], {}
    for i, (p, t) in enumerate(sound):
        kind = {3: "empty", 9: "truncated", 15: "refusal", 21: "copies_question"}.get(i % 30)
        value = {None: t, "empty": rng.choice(["", None, "n/a", "-"]), "truncated": t[: len(t) * 2 // 3].rstrip(" .") + rng.choice([" of the", " and", " ga", "...", " (see"]), "refusal": "Sorry, I am not able to answer this question.", "copies_question": p.upper()}[kind]
        rows.append((f"r{i}", "answer", p, value))
        if kind:
            want[f"r{i}"] = kind
    rows += [rows[0], (None, "answer", "x", "y"), ("lone", "answer", None, None)]
    want["lone"] = "empty"
    df = clash(spark.createDataFrame(rows, "id string, f string, p string, v string"))
    got = {r.id: r.defect for r in pairs.broken_pairs(df, "id", "f", "p", "v").collect()}
    right = sum(got.get(k) == v for k, v in want.items())
    assert len(want) > 40 and right >= 0.95 * len(want) and sum(k not in want for k in got) <= 2
    assert pairs.broken_pairs(df.limit(0), "id", "f", "p", "v").count() == 0


# --- 6 ---


def test_passages(spark):
    q = "Derive a bound on the archive histogram given that Lorranar penalizes sixty explicit backlogs per scalar bias and keep the replica below the limit of the anchor"
    w = q.split()
    half = " ".join(w[3:20])
    filler = "Nothing to see in this part of the text, which goes on for a while. " * 40
    rows = [("whole", filler + q + " " + filler), ("half", filler + half + " " + filler), ("inserted", " ".join(w[:9]) + " a sentence was put in here by someone " + " ".join(w[9:])), ("edited", q.replace("penalizes", "penalized").replace("explicit", "explicitt").upper()), ("short", " ".join(w[3:9]) + " " + filler), ("none", filler), ("null", None), ("blank", " "), ("divided", q.replace("histogram", "histo-\ngram").replace("archive", "arc­hive"))]
    df = clash(spark.createDataFrame(rows + [rows[0]], "r string, t string"))
    got = {r.r: r for r in leakage.find_passages(df, ["r"], "t", [(1, "question", q), (2, "question", ""), (3, "question", None)]).collect()}
    assert set(got) == {"whole", "half", "inserted", "edited", "divided"} and got["whole"].kind == "phrase" and got["inserted"].kind == "proximity"
    assert got["whole"].words_found == len(w) and leakage.find_passages(df.limit(0), ["r"], "t", [(1, "q", q)]).count() == 0


def test_passages_of_short_repeated_and_similar_queries(spark):
    q = "Derive a bound on the archive histogram given that Lorranar penalizes sixty explicit backlogs per scalar bias and keep the replica below the limit"
    filler = "Nothing to see in this part of the text, which goes on for a while. " * 40
    rows = [("long", filler + q + filler), ("four", filler + "the violet gradient merges" + filler), ("word", filler + "Xylophones! " + filler), ("none", filler)]
    asked = [(i, "question", q) for i in range(5)] + [(9, "question", "violet gradient merges twice"), (10, "answer", "The violet gradient merges."), (11, "answer", "xylophone"), (12, "answer", "nothing resembles these words")]
    got = {(r.r, r.item_id) for r in leakage.find_passages(spark.createDataFrame(rows, "r string, t string"), ["r"], "t", asked).collect()}
    assert got == {("long", i) for i in range(5)} | {("four", 9), ("four", 10), ("word", 11)}
    assert leakage.find_passages(spark.createDataFrame(rows, "r string, t string"), ["r"], "t", []).count() == 0


def test_postings_are_places_of_terms(spark):
    q = leakage.Queries([(1, "q", "red green blue"), (2, "q", "blue"), (3, "q", "")])
    docs = spark.createDataFrame([(1, "Blue red-green blues, red"), (2, ""), (3, None), (4, "green red")], "d long, t string")
    got = sorted((r.doc, p) for r in leakage.postings(docs, "d", "t", q).collect() for p in r.places)
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3)] and len(q.words) == 2


def test_queries_are_complete(spark, sf):
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"p{i}" for i in range(1, 11)} and not set(sql.SQL) - set(queries.QUERIES)
    assert queries.QUERIES["p5_found"](spark, sf).columns == ["source_group_a", "source_group_b"]
    assert queries.QUERIES["p1_found"](spark, sf).columns == ["episode_id_a", "episode_id_b"]
