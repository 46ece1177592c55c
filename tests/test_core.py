import io
import json
import math
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.functions import nested as N
from gristmill.functions import text as T
from gristmill.operators import analytics, contamination, corpus, grading, records, sampling, splits, statistics
from gristmill.plans import catalog
from gristmill.provider import Echo, replay, run_provider
from gristmill.sources import readers, writers
from gristmill.streaming import streams


def test_scripts_and_secrets(spark):
    rows = [("plain English text",), ("П in here",), ("Greek λ is fine",), ("AKIA" + "A1B2" * 4,), ("a" * 64,), ("Zx9" * 15 + "+/Ab",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(T.blocked_script("t").alias("b"), T.has_secret(F.coalesce("t", F.lit(""))).alias("s"))
    got = [(r.b, r.s) for r in df.collect()]
    assert [g[0] for g in got[:3]] == [False, True, False]
    assert [g[1] for g in got] == [False, False, False, True, False, False, False]


def test_non_substantive_first_reason_wins(spark):
    t = ["", "1 Contents Chapter 1", "thanks to all who gave support", "ISBN 1 copyright", "table of contents chapter 1 chapter 2 chapter 3", "the mechanism works"]
    got = spark.createDataFrame([(x,) for x in t], "t string").select(T.non_substantive("t").alias("r")).collect()
    assert [r.r for r in got] == ["empty", "front_matter_heading", "acknowledgments", "copyright_or_colophon", "table_of_contents", None]


def test_repetition_and_numbers(spark):
    df = spark.createDataFrame([("a b c d e f " * 10, [1000.0, 52.5]), ("about 1,000 and 52.5%", [1000.0, 52.5]), ("about 777", [1000.0])], "t string, f array<double>")
    r = df.select(T.repetition("t").alias("r"), T.numbers_grounded(F.col("t"), F.col("f")).alias("g")).collect()
    assert r[0].r > 0.8 and r[1].r == 0.0 and r[1].g and not r[2].g


def test_json_and_file_blocks(spark):
    t = 'x ```json\n{"a": 1}\n``` y'
    f = "FILE: a/b.py\n```python\nprint(1)\n```\nFILE: ../x\n```\nno\n```"
    r = spark.createDataFrame([(t, f)], "t string, f string").select(T.json_object("t").alias("j"), T.file_blocks("f").alias("m")).first()
    assert json.loads(r.j) == {"a": 1} and r.m == {"a/b.py": "print(1)\n"}


def test_pack_paragraphs():
    text = "\n\n".join(c * 40 for c in "abcdef")
    got = corpus.pack_paragraphs(text, 100, 10)
    assert [len(x[2]) <= 100 for x in got] == [True] * len(got)
    assert got[1][2].startswith("b" * 10) and got[0] == (0, 82, "a" * 40 + "\n\n" + "b" * 40)
    assert corpus.pack_paragraphs("x" * 500, 100, 10) == [(0, 500, "x" * 500)]
    assert corpus.pack_paragraphs(" \n\n ", 100, 10) == []


def brute_near(rows):
    kept, prints, removed, seen = [], [], {}, {}
    for k, t in sorted(rows, key=lambda r: str(r[0])):
        flat = " ".join(t.split()).lower()
        if flat in seen:
            removed[str(k)] = seen[flat]
            continue
        p = corpus.simhash64(t) & (2**64 - 1)
        hit = next((n for n, q in zip(kept, prints) if p >> 48 == q >> 48 and bin(p ^ q).count("1") <= 3), None)
        if hit is not None:
            removed[str(k)] = hit
        else:
            kept.append(str(k))
            prints.append(p)
            seen[flat] = str(k)
    return removed


def test_near_duplicates_against_brute_force(spark):
    words = [f"w{i}" for i in range(300)]
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(words, 120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[i] + " extra") for i in range(20)] + [(200 + i, base[i].upper()) for i in range(5)] + [(300, ""), (301, "")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {r.k for r in corpus.near_duplicates(df, "k", "t").collect()}
    assert got == set(brute_near(rows))


def test_first_on_both_of_a_long_chain(spark):
    rows = [(i, i, i + 1) for i in range(60)] + [(None, 1, 1), (99, None, None)]
    df = spark.createDataFrame([(i, a // 2 if a is not None else None, b // 2 if b is not None else None) for i, a, b in rows], "i long, a long, b long")
    got = {r.i for r in records.first_on_both(df, "i", "a", "b").collect()}
    kept, seen_a, seen_b = set(), set(), set()
    for i, a, b in sorted((r for r in rows if r[0] is not None)):
        a, b = a // 2 if a is not None else None, b // 2 if b is not None else None
        if (a is None or a not in seen_a) and (b is None or b not in seen_b):
            kept.add(i), seen_a.add(a), seen_b.add(b)
    assert got == kept


def test_copies_of_removed_rows_are_near_copies(spark):
    words = [f"w{i}" for i in range(300)]
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(words, 400)) for _ in range(8)]
    rows = [(100 + i, t) for i, t in enumerate(base)] + [(200 + i, t + " extra") for i, t in enumerate(base)] + [(300 + i, t.upper() + "  EXTRA") for i, t in enumerate(base)] + [(400 + i, t.title()) for i, t in enumerate(base)]
    got = {r.k: (r.duplicate_of, r.type) for r in corpus.near_duplicates(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    want, kept, seen = {}, [], {}
    for k, t in sorted((str(k), t) for k, t in rows):
        flat, f = " ".join(t.lower().split()), corpus.simhash64(t)
        near = next((o for o, g in kept if ((f ^ g) & (2**64 - 1)) >> 48 == 0 and ((f ^ g) & (2**64 - 1)).bit_count() <= 3), None)
        if flat in seen:
            want[k] = (seen[flat], "exact")
        elif near:
            want[k] = (near, "near")
        else:
            seen[flat] = k
            kept.append((k, f))
    assert got == want and {t for _, t in want.values()} == {"exact", "near"} and any(k.startswith("3") and t == "near" for k, (_, t) in want.items())


def test_even_cap_and_largest_remainder(spark):
    df = spark.range(10).select(F.lit("g").alias("g"), "id")
    assert [r.id for r in sampling.even_cap(df, "g", ["id"], 1).collect()] == [5]
    assert sorted(r.id for r in sampling.even_cap(df, "g", ["id"], 4).collect()) == [0, 3, 6, 9]
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "name string, w double")
    assert {r.name: r.quota for r in sampling.largest_remainder(w, "name", "w", 10).collect()} == {"a": 3, "b": 3, "c": 4}


def test_schedule_is_stable_in_batches(spark):
    g = spark.createDataFrame([("d", x) for x in "abc"], "domain string, grp string")
    q = lambda n: spark.createDataFrame([("d", n)], "domain string, quota int")
    job = lambda n: {(r.slot, r.grp, r.job_id) for r in sampling.schedule(g, "grp", "domain", q(n)).collect()}
    assert job(4) < job(10) and len(job(10)) == 10


def test_splits_partition_and_report(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    share = {r.s: r.n for r in df.groupBy(splits.split_by("k").alias("s")).agg(F.count("*").alias("n")).collect()}
    assert abs(share["train"] / 2000 - 0.8) < 0.04 and set(share) == {"train", "validation", "test"}
    bad = spark.createDataFrame([("s", "e", "l", "train"), ("s", "e", "l", "test")], "sample string, e string, l string, split string")
    got = {r.check: r.n for r in splits.leakage_report(bad, "sample", "e", "l", "split").collect()}
    assert got == {"lineage_in_several_splits": 1, "episode_in_several_splits": 1, "repeated_sample": 1, "empty_split": 1}


def test_contamination_flags_verbatim_prompts(spark):
    prompt = "how many ways are there to order nine green bottles on the wall"
    r = spark.createDataFrame([("a", "x " + prompt.upper() + " y"), ("b", "nothing of the kind"), ("c", None)], "k string, t string")
    i = spark.createDataFrame([(1, prompt), (2, "too short")], "i long, p string")
    assert [(x.k, x.i, x.exact) for x in contamination.contamination(r, "k", "t", i, "i", "p").collect()] == [("a", 1, True)]


def test_first_on_both_matches_sequence(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(12)), int(rng.integers(12))) for i in range(40)]
    seen_a, seen_b, want = set(), set(), []
    for i, a, b in rows:
        if a not in seen_a and b not in seen_b:
            want.append(i)
            seen_a.add(a)
            seen_b.add(b)
    got = records.first_on_both(spark.createDataFrame(rows, "i long, a long, b long"), "i", "a", "b")
    assert sorted(r.i for r in got.collect()) == want


def test_native_rows_fan_out(spark):
    e = {
        "episode_id": "e", "split": "train", "lineage_component_id": "l", "domain": "d", "frame": {"o": "x"}, "routing": {"o": "x"}, "lanes": [{"i": "1"}, {"i": "2"}], "barrier": {"o": "x"}, "verification": [{"c": "1"}],
        "continuation_pairs": [{"pair": "p", "eligible": False}], "integration": {"o": "x"}, "commitment": {"o": "x"}, "counterfactuals": [{"v": "1"}, {"v": "2"}], "root_anchor_evaluations": [{"a": "1"}],
    }
    schema = "episode_id string, split string, lineage_component_id string, domain string, frame struct<o:string>, routing struct<o:string>, lanes array<struct<i:string>>, barrier struct<o:string>, verification array<struct<c:string>>, continuation_pairs array<struct<pair:string,eligible:boolean>>, integration struct<o:string>, commitment struct<o:string>, counterfactuals array<struct<v:string>>, root_anchor_evaluations array<struct<a:string>>"
    n = records.native_rows(spark.createDataFrame([e], schema))
    assert n.count() == 12
    v = records.instruction_view(n, F.lit("u"))
    assert v.count() == 11 and not v.where(records.role_errors("messages")).count()


def test_arithmetic_and_word_counts(spark):
    df = spark.createDataFrame([("2 + 2 = 5 and 3 * 4 = 12 and 10 / 4 = 2.5 and 1/3 = 0.33",), ("one two three (3 words)",)], "t string")
    r = df.select(records.arithmetic_errors(F.col("t")).alias("a"), records.declared_word_count(F.col("t")).alias("w")).collect()
    assert r[0].a == ["2 + 2 = 5"] and (r[1].w.declared, r[1].w.counted) == (3, 3)


def test_graders(spark):
    df = spark.createDataFrame([("so it is 1,200 kg", "numeric", "1200", ""), ("about 3 days", "unit", "3", "days"), ("red then blue", "ordering", "red > blue", ""), ("blue, red", "ordering", "red > blue", ""), ("SELECT 1 ;", "sql_exact", "select  1", ""), ("I cannot determine the answer.", "abstention", "", "")], "a string, k string, e string, u string")
    got = [r[0] for r in df.select(grading.grade(F.col("k"), F.col("a"), F.col("e"), F.col("u"))).collect()]
    assert got == [True, True, True, False, True, True]
    groups = F.array(F.struct(F.lit("x").alias("label"), F.array(F.lit("red car")).alias("any")), F.struct(F.lit("y").alias("label"), F.array(F.lit("ed")).alias("any")))
    assert spark.range(1).select(grading.rubric_coverage(F.lit("A red car."), groups)).first()[0] == 0.5


def test_graders_follow_their_specifications(spark):
    rows = [
        ("so 3, 1, 2", "ordering", "3 > 1 > 2", "", True), ("so 3, 2, 1", "ordering", "3 > 1 > 2", "", False), ("1, 2", "ordering", "3 > 1 > 2", "", False), ("it runs at 5 m/s", "unit", "5", "m/s", True), ("5 km", "unit", "5", "m", False), ("5", "unit", "5", "", True),
        ("anything", "none", "", "", True), ("anything", "other", "", "", None), ("1.000001", "numeric", "1", "", False), ("−4 (not 3x4)", "numeric", "-4", "", False), ("at −4", "numeric", "-4", "", True), ("```sql\nSELECT a\n FROM t;\n```", "sql_exact", "select a from t", "", True), ("", "sql_exact", "", "", False),
        ("There is not enough evidence.", "abstention", "", "", True), ("Not enough evidence, but 7.", "abstention", "", "", False), ("I will not say.", "abstention", "", "", False),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "a string, k string, e string, u string")
    assert [r[0] for r in df.select(grading.grade(F.col("k"), F.col("a"), F.col("e"), F.col("u"))).collect()] == [r[4] for r in rows]
    ends = spark.createDataFrame([("We did it because.",), ("We did it.",), ("We did it\n```\n",), ("We did it",)], "a string")
    assert [r[0] for r in ends.select(grading.completion("a", 1, [])).collect()] == [0.9, 1.0, 1.0, 0.9]
    assert spark.range(1).select(grading.completion(F.lit("The plan and the riskiest part."), 1, ["plan", "risk"])).first()[0] == 0.775
    typed = spark.createDataFrame([("1, 2.50, 3", "ordering", 2), ("is 7 m", "unit", 0), ("no", "numeric", 0), ("A  b−1", "sql_exact", 0), (None, None, 0)], "a string, k string, n int")
    assert [r[0] for r in typed.select(N.answer_signature("a", "k", "n")).collect()] == ["ordering:2.5,3", "unit:7", "numeric:none", "sql_exact:a b-1", "none:"]


def test_unsafe_file_blocks_raise_if_strict(spark):
    one = lambda t, **k: spark.createDataFrame([(t,)], "f string").select(T.file_blocks("f", **k).alias("m")).first().m
    block = lambda path, body: f"FILE: {path}\n```\n{body}```\n"
    assert one(block("a", "1\n") + block("a..b", "2\n") + block("a", "3\n"), strict=True) == {"a..b": "2\n", "a": "3\n"}
    for bad in ("", block("/etc/x", "1\n"), block("a/../b", "1\n"), block("a\\b", "1\n"), block("big", "é" * 61_000 + "\n")):
        assert one(bad) == {}
        with pytest.raises(Exception, match="FILE blocks|unsafe|too large"):
            one(bad, strict=True)


def test_grounded_numbers_let_benign_ones_pass(spark):
    df = spark.createDataFrame([(t,) for t in ("12 of 100", "in 1995", "in 1985", "at 70", "15.5")], "t string")
    assert [r[0] for r in df.select(T.numbers_grounded(F.col("t"), F.array(F.lit(1000.0)))).collect()] == [True, True, False, False, False]


@pytest.mark.parametrize("cut_at", [0, 1, 40, 79, 80])
def test_bets_on_two_scorers_in_parts_and_whole(spark, cut_at):
    rng = np.random.default_rng(5)
    rows = [("xy"[i % 2], i, float(rng.integers(0, 9)), float(rng.integers(0, 9)), bool(rng.random() < 0.5)) for i in range(80)]
    df = spark.createDataFrame([*rows, ("x", 90, None, 1.0, True)], "g string, i long, a double, b double, ok boolean")
    first = statistics.e_process(df.where(F.col("i") < cut_at), "g", "i", "a", "b", "ok")
    got = {r.g: r for r in statistics.e_process(df.where(F.col("i") >= cut_at), "g", "i", "a", "b", "ok", before=first).collect()}
    for g in "xy":
        line, wealth, top, pairs, odd = [], 1.0, 1.0, 0, 0
        for _, _, a, b, ok in (r for r in rows if r[0] == g):
            if not ok:
                line.append((a, b))
            elif line:
                wa, wb = line.pop(0)
                pairs += 1
                if (a > wa) != (b > wb):
                    odd, wealth = odd + 1, wealth * (1.5 if a > wa else 0.5)
                    top = max(top, wealth)
        r = got[g]
        assert (r.pairs, r.discordant, r.wealth, r.max_wealth, [(w.a, w.b) for w in r.waiting]) == (pairs, odd, pytest.approx(wealth), pytest.approx(top), line)


def test_one_sided_tests(spark):
    assert statistics.mcnemar_mid_p(8, 2) == pytest.approx(sum(math.comb(10, k) for k in (9, 10)) / 1024 + math.comb(10, 8) / 2048) and statistics.mcnemar_mid_p(0, 0) == 1.0
    assert statistics.mcnemar_mid_p(2, 8) > 0.9
    r = statistics.stouffer(spark.createDataFrame([(1.0,), (2.0,), (None,)], "z double"), "z").first()
    assert r.n == 2 and r.z == pytest.approx(3 / math.sqrt(2)) and r.p == pytest.approx(0.0169, abs=1e-4)


def test_parquet_rows_are_parts(spark, tmp_path):
    spark.createDataFrame([(1, "one"), (2, None)], "n int, t string").coalesce(1).write.parquet(str(tmp_path / "p"))
    data = next((tmp_path / "p").glob("*.parquet")).read_bytes()
    assert [(p, json.loads(t)) for p, t in readers.extract("x.PARQUET", data)] == [("row-1", {"n": 1, "t": "one"}), ("row-2", {"n": 2, "t": None})]
    assert readers.extract("a.tf", b"x")[0] == ("document", "x")


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 60), st.integers(0, 60))
def test_mid_p_is_a_probability(a, b):
    assert 0 <= statistics.mcnemar_mid_p(a, b) <= 1


def test_bounds():
    assert statistics.clopper_pearson_upper(0, 59) == pytest.approx(1 - 0.05 ** (1 / 59), abs=1e-6)
    assert statistics.clopper_pearson_upper(5, 5) == 1.0


def test_areas_agree_with_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(float(round(rng.random(), 1)), bool(rng.random() < 0.4)) for _ in range(200)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    df = spark.createDataFrame([(s, y, i) for i, (s, y) in enumerate(rows)], "s double, y boolean, i int")
    assert statistics.auroc(df, "s", "y").first().auroc == pytest.approx(want)
    order = sorted(rows_i := [(-s, i, not y) for i, (s, y) in enumerate(rows)])
    errors = np.cumsum([w for *_, w in order])
    assert statistics.risk_coverage(df.withColumn("w", ~F.col("y")), "s", "w", "i").first().augrc == pytest.approx(errors.sum() / len(rows_i) ** 2)
    d = statistics.delong_pair(df.withColumn("b", -F.col("s")), "s", "b", "y").first()
    assert d.auc_a == pytest.approx(want) and d.auc_b == pytest.approx(1 - want)


def test_token_f1(spark):
    df = spark.createDataFrame([(1, "a b b", "b b c"), (2, "", None)], "k int, p string, g string")
    assert {r.k: r.f1 for r in analytics.token_f1(df, "k", "p", "g").collect()} == {1: pytest.approx(2 / 3, abs=1e-6), 2: 1.0}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.html").write_text("<p>one<script>x</script></p><p>two &amp; three</p>")
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\n{"b": 2}\n')
    (tmp_path / "d.json").write_text('{"a": ["x", {"b": "y"}]}')
    (tmp_path / "e.csv").write_text("a;b\n1;2\n")
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "x.bin").write_text("zzz")
    (tmp_path / "a2.txt").write_text("hello")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("p2.xhtml", "<p>second</p>")
        f.writestr("p1.xhtml", "<p>first</p>")
    (tmp_path / "f.epub").write_bytes(z.getvalue())
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:t>one </w:t><w:t>line</w:t></w:p><w:p/></w:document>')
    (tmp_path / "g.docx").write_bytes(z.getvalue())
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": ["x = 1"]}, {"cell_type": "markdown", "source": " "}]}))
    files = readers.list_files(spark, str(tmp_path))
    got = {(r.path.rpartition("/")[2], r.part): r for r in readers.read_documents(files).collect()}
    assert got["b.html", "document"].text == "one\n\ntwo & three"
    assert {p for f, p in got if f == "c.jsonl"} == {"row-1", "row-3"}
    assert {p for f, p in got if f == "d.json"} == {"a[0]", "a[1].b"}
    assert got["bad.json", None].error.startswith("JSONDecodeError")
    assert [p for f, p in got if f == "f.epub"] == ["p1.xhtml", "p2.xhtml"] and got["g.docx", "document"].text == "one line"
    assert ("n.ipynb", "code-0") in got and not any(f == "x.bin" for f, _ in got)
    inv = {r.path.rpartition("/")[2]: r for r in readers.inventory(files, [(r"\.txt$", "notes")]).collect()}
    assert inv["a2.txt"].duplicate_of is None or inv["a.txt"].duplicate_of is None
    assert inv["a.txt"].domain == "notes" and inv["b.html"].domain is None


def test_manifest(spark):
    ok = dict(path="p", title="t", domain="d", source_group="g", version="1", license="l", allowed_for_training=True)
    assert readers.manifest(spark, [ok, {"path": "no"}]).count() == 1
    with pytest.raises(ValueError):
        readers.manifest(spark, [ok | {"license": ""}])


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "i int, x array<string>")
    assert writers.write_jsonl(df, str(tmp_path / "o")) == 2
    assert writers.write_jsonl(df, str(tmp_path / "o")) == 2 and spark.read.json(str(tmp_path / "o")).count() == 2
    writers.write_csv(df, str(tmp_path / "c"))
    assert {r.x for r in spark.read.option("header", "true").csv(str(tmp_path / "c")).collect()} == {'["a"]', None}
    assert writers.release_manifest(spark, str(tmp_path / "o")).count() >= 1


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stage = str(tmp_path / "in")
    events.select("event_id", "user_id", "value").repartition(4).write.parquet(stage)
    like = spark.read.parquet(stage)
    s = streams.read_stream(spark, stage, like, 1)
    q = streams.running_totals(s, "user_id", "value").writeStream.outputMode("update").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.user_id: r.n for r in spark.sql("select user_id, max(n) as n from totals group by user_id").collect()}
    assert last == {r.user_id: r.n for r in like.groupBy("user_id").agg(F.count("value").alias("n")).collect()}
    for _ in range(2):
        streams.upsert_stream(streams.read_stream(spark, stage, like, 2), str(tmp_path / "out"), "event_id", str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == like.select("event_id").distinct().count()


def test_provider(spark):
    req = spark.createDataFrame([(1, "a\nb"), (2, None)], "k int, p string")
    assert {r.k: (r.reply, r.status) for r in run_provider(req, "k", "p", Echo(), workers=2).collect()} == {1: ("b", "ok"), 2: ("", "ok")}
    assert {r.k: r.status for r in replay(req, spark.createDataFrame([(1, "x")], "k int, reply string"), "k").collect()} == {1: "ok", 2: "failed"}


def test_queries_run_and_have_unique_columns(spark, sf):
    for name in ("clean_corpus_splits", "corpus_audit", "split_leakage", "token_usage", "latency_percentiles"):
        df = catalog.QUERIES[name](spark, sf)
        assert len(set(df.columns)) == len(df.columns) and df.count() >= 1
    assert not set(catalog.SQL) - set(catalog.QUERIES)


def test_nested_walks(spark):
    from gristmill.functions import nested as N

    df = spark.createDataFrame([('{"a": ["xx", {"b_id": "y", "c": 1}], "d": null}', 'say ```json\n{"x": {"tool": "t", "args": [1]}}\n```'), ("{", None), (None, "```\n{}\n```")], "j string, r string")
    got = df.select(N.string_leaves("j").alias("l"), N.ids("j").alias("i"), N.compact("j", 1, 1).alias("c"), N.canonical_json("j").alias("k"), N.tool_fields("r", ["tool", "args"]).alias("t")).collect()
    assert got[0].l == ["xx", "y"] and got[0].i == ["y"] and json.loads(got[0].c) == {"a": ["x"], "d": None} and got[0].k == '{"a":["xx",{"b_id":"y","c":1}],"d":null}'
    assert [r.t for r in got] == [True, False, False] and got[1].c is None and list(got[2].l) == []
    s = spark.createDataFrame([("so 1,200.0",), ("= 1200",), ("Yes!",)], "a string").select(N.answer_signature("a").alias("s")).collect()
    assert s[0].s == s[1].s == "1200" and s[2].s == "yes"


def test_windows_and_rotations(spark):
    df = spark.createDataFrame([("g", i, f"v{i}") for i in range(9)] + [("h", 100, "x")], "g string, i long, v string")
    w = sorted(r.i for r in sampling.coherent_window(df, "g", ["i"], 4).where("g = 'g'").collect())
    assert len(w) == 4 and w == list(range(w[0], w[0] + 4))
    n = {r.i: r.hard_negative for r in sampling.hard_negatives(df, "g", "i", "v").collect()}
    assert n[100] is None and sorted(n[i] for i in range(9)) == sorted(f"v{i}" for i in range(9)) and all(n[i] != f"v{i}" for i in range(9))


def test_support_spans_hold_every_word(spark):
    def spans(text, most):
        w, out, at = text.split(), [], 0
        while at < len(w) and (most is None or len(out) < most):
            end = min(len(w), at + 60)
            while end > at + 1 and len(" ".join(w[at:end])) > 600:
                end -= 1
            value = " ".join(w[at:end])
            if len(value) >= 20:
                out.append((f"c::span-{len(out) + 1:03d}", value))
            if end >= len(w):
                break
            at = max(at + 1, end - 10)
        return out

    rng = random.Random(8)
    word = lambda most: "".join(rng.choice("abcäß漢") for _ in range(rng.randrange(1, most)))
    texts = ["", "too short", " ".join(["x"] * 70), "y" * 700, f"{'a ' * 59}{'b' * 600} c"] + [" ".join(word(m) for _ in range(n)) for n in (12, 60, 61, 400, 1500) for m in (3, 8, 25, 130)] + [" ".join(f"n{i}" for i in range(55_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for most in (24, None):
        got = {r.i: [tuple(s) for s in r.s] for r in df.select("i", T.support_spans(F.lit("c"), F.col("t"), most=most).alias("s")).collect()}
        assert got == {i: spans(t, most) for i, t in enumerate(texts)}


def test_support_spans_query_keeps_whole_documents(spark, tmp_path):
    w = [f"word{i}" for i in range(3000)]
    spark.createDataFrame([(1, " ".join(w)), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["support_spans"](spark, str(tmp_path)).collect()
    assert {r.chunk_id for r in got} == {"1"} and {t for r in got for t in r.text.split()} == set(w)


def test_instruction_rows_keep_every_spelling(spark, tmp_path):
    stages = ["root_retention", "Private Solving ", "ROOT_RETENTION", "root-retention", "barrier\t", "elsewhere", None]
    rows = [(f"s{i}", x, None, "{}", True, "train") for i, x in enumerate(stages)] + [("masked", "barrier", None, "{}", False, "train")]
    spark.createDataFrame(rows, "sample_id string, stage string, subdomain string, target string, loss_mask boolean, split string").write.parquet(f"{tmp_path}/native_row.parquet")
    got = {r.sample_id: r.rendered.split("\n")[0] for r in catalog.QUERIES["instruction_rows"](spark, str(tmp_path)).collect()}
    names = ["root retention", "private solving", "root retention", "root retention", "barrier"]
    assert got == {f"s{i}": f"system: Produce the {n} stage." for i, n in enumerate(names)} | {"s5": "system: ", "s6": "system: "}
