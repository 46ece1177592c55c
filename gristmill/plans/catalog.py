"""All queries of the core by name, with the DuckDB SQL that checks them. Every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import canon
from gristmill.functions import nested as N
from gristmill.functions import text as T
from gristmill.operators import analytics as A
from gristmill.operators import contamination as K
from gristmill.operators import corpus as C
from gristmill.operators import grading as G
from gristmill.operators import records as R
from gristmill.operators import sampling as S
from gristmill.operators import splits as P
from gristmill.operators import statistics as U
from gristmill.session import spread, table
from gristmill.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


# SQL fragments
NORM = r"trim(regexp_replace(coalesce({0}, ''), '[\t-\r \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
N_TEXT = NORM.format("text")
WORDS = r"regexp_extract_all(lower({0}), '[a-z0-9_]+')"
BLOCKED = "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in T.BLOCKED_SCRIPTS) + "]"
BLOCKED_SQL = "regexp_matches(array_to_string(regexp_extract_all(coalesce({0}, ''), '\\p{{L}}'), ''), '" + BLOCKED.replace("{", "{{").replace("}", "}}") + "')"
FRACTION = "(concat('0x', substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
SPLIT = "case when " + FRACTION + " < 0.8 then 'train' when " + FRACTION + " < 0.9 then 'validation' else 'test' end"
SECRET_SQL = r"(regexp_matches(coalesce({0}, ''), '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----|\bAKIA[0-9A-Z]{{16}}\b|\b(sk|rk)-[A-Za-z0-9_-]{{20,}}\b') or len(list_filter(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9+/]{{40,}}={{0,2}}'), lambda x: not regexp_full_match(rtrim(x, '='), '[0-9A-Fa-f]{{40,128}}') and len(list_distinct(string_split(rtrim(x, '='), ''))) >= 8 and regexp_matches(x, '[a-z]') and regexp_matches(x, '[A-Z]') and regexp_matches(x, '[0-9+/]'))) > 0)"
REASONING_SQL = r"regexp_matches(coalesce({0}, ''), '(?i)<\s*/?\s*\|?think\|?\s*>|\bhidden chain[- ]of[- ]thought\b|\binternal reasoning:\s')"
LABEL_ = r"nullif(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '[-_\s]+', '{1}', 'g'), '')"


# --- the flagship, canonical forms, filters ------------------------------------------------------------------------


@query(f"""
with n as (select doc_id, coalesce(source, 'unknown') as source, text, lower({N_TEXT}) as t from documents),
k as (select *, row_number() over (partition by sha256(t) order by doc_id) as r from n where length(t) >= 100 and not {BLOCKED_SQL.format("text")} and not contains(coalesce(text, ''), chr(65533)))
select {SPLIT.format("source")} as split, source, count(*) as documents from k where r = 1 group by all
""")
def clean_corpus_splits(spark, d):
    n = docs(spark, d).select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), "text", F.lower(canon.normalize_text(F.coalesce("text", F.lit("")))).alias("t"))
    good = n.where((F.length("t") >= 100) & ~T.blocked_script(F.coalesce("text", F.lit(""))) & ~F.coalesce(F.col("text"), F.lit("")).contains("�"))
    first = good.select("doc_id", "source", canon.stable_hash("t").alias("h")).groupBy("h").agg(F.min_by("source", "doc_id").alias("source"))
    return first.groupBy(P.split_by("source").alias("split"), "source").agg(F.count(F.lit(1)).alias("documents"))


@query(f"select doc_id, substr(sha256({N_TEXT}), 1, 32) as content_hash, {FRACTION.format('cast(doc_id as varchar)')} as fraction, len({WORDS.format(N_TEXT)}) as words from documents")
def canonical_forms(spark, d):
    t = canon.normalize_text(F.coalesce("text", F.lit("")))
    return docs(spark, d).select("doc_id", canon.stable_hash(t, 32).alias("content_hash"), canon.hash_fraction(F.col("doc_id").cast("string")).alias("fraction"), F.size(canon.words(t)).alias("words"))


@query(r"""
with r as (select doc_id, text, case when """ + N_TEXT + r""" = '' then 'empty' when contains(text, chr(65533)) then 'replacement_character'
 when length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 24 then 'too_little_language' when """ + BLOCKED_SQL.format("text") + r""" then 'blocked_script' else 'accepted' end as reason from documents)
select reason, count(*) as documents from r group by reason
""")  # fmt: skip
def language_gates(spark, d):
    t = F.col("text")
    reason = F.when(canon.normalize_text(F.coalesce(t, F.lit(""))) == "", "empty").when(t.contains("�"), "replacement_character").when(T.letters("text") < 24, "too_little_language").when(T.blocked_script("text"), "blocked_script").otherwise("accepted")
    return docs(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("documents"))


@query(r"""
with b as (select doc_id, coalesce(text, '') as t, regexp_matches(coalesce(text, ''), '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\b(sk|rk)-[A-Za-z0-9_-]{20,}\b') as k,
 list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9+/]{40,}={0,2}'), lambda x: not regexp_full_match(rtrim(x, '='), '[0-9A-Fa-f]{40,128}') and len(list_distinct(string_split(rtrim(x, '='), ''))) >= 8 and regexp_matches(x, '[a-z]') and regexp_matches(x, '[A-Z]') and regexp_matches(x, '[0-9+/]')) as runs from documents)
select doc_id, k or len(runs) > 0 as secret, regexp_matches(t, '(?i)<\s*/?\s*\|?think\|?\s*>|\bhidden chain[- ]of[- ]thought\b|\binternal reasoning:\s') as reasoning, contains(lower(t), 'lorem ipsum') as placeholder from b
""")
def policy_scan(spark, d):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, d).select("doc_id", T.has_secret(t).alias("secret"), T.has_reasoning(t).alias("reasoning"), F.lower(t).contains("lorem ipsum").alias("placeholder"))


@query(r"""
with w as (select doc_id, """ + WORDS.format(N_TEXT) + r""" as w from documents)
select doc_id, case when len(w) < 24 then 0.0 else round(1.0 - len(list_distinct(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i+5], ' ')))) / (len(w) - 5)::double, 6) end as repetition from w
""")
def repetition(spark, d):
    t = canon.normalize_text(F.coalesce("text", F.lit("")))
    return docs(spark, d).select("doc_id", F.round(T.repetition(t), 6).alias("repetition"))


@query(r"""
with n as (select doc_id, """ + N_TEXT + r""" as t from documents),
l as (select doc_id, t, lower(t) as low, trim(regexp_replace(left(t, 240), '^[\w.-]+\s+', '')) as head from n)
select reason, count(*) as documents from (select case when t = '' then 'empty'
 when regexp_matches(head, '(?i)^(acknowledg(e)?ments?|table of contents|contents|copyright|colophon|about (the )?author|author biography|bibliography|references|index)\b') then 'front_matter_heading'
 when regexp_matches(left(low, 1600), 'would(n[''’]t| not) have been possible without|particularly supportive|thanks? (to|you)|grateful to') and regexp_matches(left(low, 1600), '\b(support|help|encourag|feedback|thank)\w*\b') then 'acknowledgments'
 when (contains(left(low, 1200), 'all rights reserved') or contains(left(low, 1200), 'isbn')) and contains(left(low, 1200), 'copyright') then 'copyright_or_colophon'
 when (contains(left(low, 1600), 'document outline') or contains(left(low, 1600), 'table of contents')) and len(regexp_extract_all(left(low, 2000), '\bchapter\s+\d+\b')) >= 3 then 'table_of_contents'
 else 'kept' end as reason from l) group by reason
""")
def non_substantive_pages(spark, d):
    return docs(spark, d).groupBy(F.coalesce(T.non_substantive("text"), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("documents"))


@query(r"""
select candidate_id, numbers from (select candidate_id, list_filter(list_transform(regexp_extract_all(coalesce(answer, ''), '-?\d[\d,]*\.?\d*'), lambda n: try_cast(replace(n, ',', '') as double)), lambda x: x is not null) as n,
 round(coalesce(list_sum(n), 0), 6) as numbers from candidate)
""")
def numbers_in_answers(spark, d):
    n = T.numbers(F.coalesce("answer", F.lit("")))
    return table(spark, d, "candidate").select("candidate_id", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 6).alias("numbers"))


@query(r"""
select doc_id, regexp_matches(coalesce(text, ''), '(?im)^\s*(#{0,3}\s*)?(user|assistant|system|human)\s*:') as leaks from documents
""")
def role_leaks(spark, d):
    return docs(spark, d).select("doc_id", T.role_leak(F.coalesce("text", F.lit(""))).alias("leaks"))


@query(r"""
select doc_id, regexp_replace(case when regexp_extract(coalesce(text, ''), '(?s)```[A-Za-z0-9_+-]*\n(.*?)```', 1) <> '' then regexp_extract(coalesce(text, ''), '(?s)```[A-Za-z0-9_+-]*\n(.*?)```', 1) else coalesce(text, '') end, '^\s+|\s+$', '', 'g') as code from documents
""")
def code_blocks(spark, d):
    return docs(spark, d).select("doc_id", T.code_block(F.coalesce("text", F.lit(""))).alias("code"))


# --- chunks, duplicates, contamination -----------------------------------------------------------------------------


@query()
def chunks(spark, d):
    return C.chunk_records(spread(table(spark, d, "source_document")))


@query()
def document_chunks(spark, d):
    return C.chunk(docs(spark, d), ["doc_id"], "text")


@query()
def support_spans(spark, d):
    c = docs(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return c.select("chunk_id", F.posexplode(T.support_spans(F.col("chunk_id"), F.coalesce("text", F.lit("")), most=None)).alias("n", "s")).select("chunk_id", "s.span_id", "s.text")


@query(f"""
with h as (select doc_id, substr(sha256(lower({N_TEXT})), 1, 32) as content_hash from documents)
select doc_id, content_hash, min(doc_id) over (partition by content_hash) as kept_key, count(*) over (partition by content_hash) as copies from h
""")
def exact_duplicates(spark, d):
    return C.exact_groups(docs(spark, d), "doc_id", "text")


@query()
def near_duplicates(spark, d):
    return C.near_duplicates(docs(spark, d), "doc_id", "text")


@query()
def fingerprints(spark, d):
    return C.simhashes(docs(spark, d), "doc_id", "text")


SH = "list_distinct(case when len(w) >= 8 then list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')) else [] end)"


class SETS:
    """SQL of (k, s, t): key, set of shingles and words of a text column."""

    @staticmethod
    def format(key: str, text: str, source: str) -> str:
        return f"select k, {SH} as s, array_to_string(w, ' ') as t from (select {key} as k, {WORDS.format(NORM.format(text))} as w from {source})"




@query(f"""
with items as (select k as item_id, s, t, len(s) as m from ({SETS.format("item_id", "question", "benchmark_item")}) where len(string_split(t, ' ')) >= 8),
recs as ({SETS.format("source_id", "text", "(select distinct source_id, text from source_document)")}),
shared as (select r.k, i.item_id, count(*) as c from (select k, unnest(s) as x from recs) r join (select item_id, unnest(s) as x from items) i using (x) group by all),
best as (select *, row_number() over (partition by k order by c desc, item_id) as r from shared)
select b.k as source_id, b.item_id, contains(recs.t, items.t) as exact, b.c as matching_shingles, round(b.c / greatest(1, m), 4) as coverage
from best b join items using (item_id) join recs using (k) where r <= 10 and (contains(recs.t, items.t) or (b.c >= 4 and b.c / greatest(1, m) >= 0.45))
""")
def contamination(spark, d):
    records = spread(table(spark, d, "source_document")).select("source_id", "text").distinct()
    return K.contamination(records, "source_id", "text", table(spark, d, "benchmark_item"), "item_id", "question")


@query(f"""
with e as (select episode_id, split, input.user_request as q from episode where input.user_request is not null),
a as (select *, len(s) as n from ({SETS.format("episode_id", "q", "(select distinct episode_id, q from e where split = 'train')")}) where t <> ''),
b as (select *, len(s) as n from ({SETS.format("episode_id", "q", "(select distinct episode_id, q from e where split <> 'train')")}) where t <> ''),
near as (select a.k as x, b.k as y, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from (select k, n, unnest(s) as z from a) a join (select k, n, unnest(s) as z from b) b using (z) group by all)
select x as episode_id, y as held_id from near where c >= 0.35 * least(na, nb) union select a.k, b.k from a join b using (t)
""")
def prompt_overlap(spark, d):
    e = table(spark, d, "episode").select("episode_id", "split", F.col("input.user_request").alias("q")).where("q is not null")
    held = e.where("split <> 'train'").select(F.col("episode_id").alias("held_id"), F.col("q").alias("hq")).distinct()
    return K.prompt_overlap(e.where("split = 'train'").select("episode_id", "q").distinct(), "episode_id", "q", held, "held_id", "hq")


@query(r"""
select count(*) as chunks, count(distinct source_group) as groups, count(distinct domain) as domains, count(chunk_id) - count(distinct chunk_id) as duplicate_ids, count(h) - count(distinct h) as duplicate_hashes,
 cast(sum((license is null)::int) as bigint) as missing_license, cast(sum((trim(coalesce(text, '')) = '')::int) as bigint) as empty_text, cast(sum(coalesce(contains(text, chr(65533)), false)::int) as bigint) as replacement_characters,
 cast(sum((""" + BLOCKED_SQL.format("text") + r""")::int) as bigint) as blocked_script,
 cast(sum((""" + SECRET_SQL.format("text") + r""")::int) as bigint) as secrets, cast(sum((""" + REASONING_SQL.format("text") + r""")::int) as bigint) as reasoning_markers
from (select source_id as chunk_id, metadata.source_group as source_group, metadata.domain as domain, metadata.license as license, text, sha256(lower(""" + N_TEXT + """)) as h from source_document)
""")  # fmt: skip
def corpus_audit(spark, d):
    s = spread(table(spark, d, "source_document"))
    c = s.select(F.col("source_id").alias("chunk_id"), F.col("metadata.source_group").alias("source_group"), F.col("metadata.domain").alias("domain"), F.col("metadata.license").alias("license"), "text", canon.stable_hash(F.lower(canon.normalize_text(F.coalesce("text", F.lit(""))))).alias("chunk_content_hash"))
    return C.audit(c)


# --- reports -------------------------------------------------------------------------------------------------------


@query("select model, provider_id, count(*) as rows, cast(sum(coalesce(prompt_tokens, 0)) as bigint) as prompt_tokens, cast(sum(coalesce(completion_tokens, 0)) as bigint) as completion_tokens from candidate group by all")
def token_usage(spark, d):
    return A.rollup_status(table(spark, d, "candidate"), ["model", "provider_id"], "prompt_tokens", "completion_tokens")


@query("""
with h as (select 'decision' as metric, integration.decision as value, count(*) as n from episode group by all union all select 'commitment', commitment.decision, count(*) from episode group by all
 union all select 'subdomain', value, n from (select subdomain as value, count(*) as n, row_number() over (order by count(*) desc, subdomain nulls first) as r from episode group by subdomain) where r <= 10)
select * from h
""")
def quality_report(spark, d):
    e = table(spark, d, "episode")
    return A.union_all([A.histogram(e, "decision", F.col("integration.decision")), A.histogram(e, "commitment", F.col("commitment.decision")), A.histogram(e, "subdomain", F.col("subdomain"), top=10)])


@query("""
with h as (select sha256(episode_id || '|' || split) as h from (select distinct episode_id, split from episode)), b as (select substr(h, 1, 3) as b, sha256(string_agg(h, '' order by h)) as s, count(*) as n from h group by 1)
select sha256(string_agg(s, '' order by b)) as fingerprint, cast(sum(n) as bigint) as rows from b
""")
def corpus_fingerprint(spark, d):
    return A.corpus_fingerprint(table(spark, d, "episode").select("episode_id", "split").distinct(), F.concat_ws("|", "episode_id", "split"))


@query("""
with a as (select count(*) as n, avg(metadata.judge_score) as s, avg((metadata.repair_round = 0)::int) as f, min(metadata.judge_score) as lo, count(distinct episode_id) as u from dpo_pair)
select 'enough' as gate, n >= 100 as passed from a union all select 'mean_score', s >= 0.82 from a union all select 'first_pass', f >= 0.5 from a union all select 'valid_scores', lo >= 0 from a union all select 'no_repeats', u = n from a
""")
def pilot_gates(spark, d):
    s = F.col("metadata.judge_score")
    return A.gates(table(spark, d, "dpo_pair"), {"enough": F.count(F.lit(1)) >= 100, "mean_score": F.avg(s) >= 0.82, "first_pass": F.avg((F.col("metadata.repair_round") == 0).cast("int")) >= 0.5, "valid_scores": F.min(s) >= 0, "no_repeats": F.countDistinct("episode_id") == F.count(F.lit(1))})


_PROFILE = "select '{0}' as \"column\", count({0}) as n, count(*) - count({0}) as nulls, round(avg({0}), 6) as mean, round(stddev_samp({0}), 6) as std, cast(min({0}) as double) as min, round(quantile_cont({0}, 0.25), 6) as p25, round(quantile_cont({0}, 0.5), 6) as median, round(quantile_cont({0}, 0.75), 6) as p75, cast(max({0}) as double) as max from lineitem"


@query(" union all ".join(_PROFILE.format(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def numeric_profile(spark, d):
    p = A.profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return p.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "median", "p75")})


@query("""
with e as (select quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) as e from lineitem)
select cast(1 + len(list_filter(e, lambda x: l_extendedprice > x)) as integer) as bin, count(*) as n, min(l_extendedprice) as low, max(l_extendedprice) as high, round(avg((l_returnflag = 'R')::int), 6) as rate from lineitem, e group by 1
""")
def quintile_rates(spark, d):
    return A.quantile_target(table(spark, d, "lineitem"), "l_extendedprice", (F.col("l_returnflag") == "R").cast("int"))


@query("""
with g as (select l_returnflag, l_linestatus, count(*) as n, round(avg(l_discount), 6) as rate from lineitem group by all having count(*) >= 50)
select *, cast(row_number() over (order by n desc, l_returnflag, l_linestatus) as integer) as rank from g qualify rank <= 20
""")
def segment_rates(spark, d):
    return A.segments(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", F.col("l_discount"), 50)


@query("""
with r as (select (user_id % 2)::int as arm, (event_type = 'purchase')::int as ok, unnest([{'kind': 'all', 'value': 'all'}, {'kind': 'day', 'value': cast(isodow(ts) % 7 + 1 as varchar)}, {'kind': 'hour', 'value': cast(hour(ts) as varchar)}, {'kind': 'cohort', 'value': cast(user_id % 20 as varchar)}]) as g from events),
a as (select g.kind as kind, g.value as value, sum((arm = 0)::int)::bigint as n0, sum((arm = 1)::int)::bigint as n1, sum(if(arm = 0, ok, 0)) as k0, sum(if(arm = 1, ok, 0)) as k1 from r group by all)
select kind, value, n0, n1, round(k0 / n0, 6) as rate0, round(k1 / n1, 6) as rate1, round(k1 / n1 - k0 / n0, 6) as uplift, round(case when k0 > 0 then (k1 / n1 - k0 / n0) / (k0 / n0) end, 6) as relative_uplift from a where n0 >= 20 and n1 >= 20
""")
def experiment_segments(spark, d):
    e = table(spark, d, "events")
    kinds = {"all": F.lit("all"), "day": F.dayofweek("ts"), "hour": F.hour("ts"), "cohort": F.col("user_id") % 20}
    return A.multi_group(e, kinds, (F.col("user_id") % 2).cast("int"), F.col("event_type") == "purchase")


@query("""
with p as (select n_name as k, sum(o_totalprice) / count(*) as v from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1),
x as (select a.k as a, b.k as b, round(a.v - b.v, 6) as difference from p a join p b on a.k < b.k)
select a, b, round(difference, 2) as difference, cast(row_number() over (order by abs(difference) desc, a, b) as integer) as rank from x qualify rank <= 96
""")
def group_comparison(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    p = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("k")).agg((F.sum("o_totalprice") / F.count(F.lit(1))).alias("v"))
    return A.compare_groups(p, "k", "v").withColumn("difference", F.round("difference", 2))


@query("""
with r as (select model, elapsed_seconds as v, row_number() over (partition by model order by elapsed_seconds) as r, count(*) over (partition by model) as n from candidate where elapsed_seconds is not null)
select model, max(n) as n, min(case when r = round_even((n - 1) * 0.5, 0) + 1 then v end) as p50, min(case when r = round_even((n - 1) * 0.9, 0) + 1 then v end) as p90, min(case when r = round_even((n - 1) * 0.99, 0) + 1 then v end) as p99 from r group by model
""")
def latency_percentiles(spark, d):
    return A.nearest_rank(table(spark, d, "candidate"), "model", "elapsed_seconds", [0.5, 0.9, 0.99])


@query(r"""
with s as (select task_id, substr(sha256(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(answer, '')), '[a-z0-9]+(?:''[a-z0-9]+)?'))), ' ')), 1, 16) as g from candidate),
c as (select task_id, g, count(*) as c from s group by all), p as (select task_id, c, c / sum(c) over (partition by task_id) as p from c)
select task_id, cast(sum(c) as bigint) as samples, count(*) as clusters, round(sum(-p * ln(p)), 6) as entropy from p group by task_id
""")
def answer_entropy(spark, d):
    c = table(spark, d, "candidate").select("task_id", A.signature(F.coalesce("answer", F.lit(""))).alias("g"))
    return A.semantic_entropy(c, "task_id", "g").withColumn("entropy", F.col("entropy") + F.lit(0.0))


@query(r"""
with p as (select distinct critique_id, corrected_answer as a, hard_negative as b from critique),
wa as (select critique_id, w, count(*) as c from (select critique_id, unnest(regexp_extract_all(lower(coalesce(a, '')), '[a-z0-9]+(?:''[a-z0-9]+)?')) as w from p) group by all),
wb as (select critique_id, w, count(*) as c from (select critique_id, unnest(regexp_extract_all(lower(coalesce(b, '')), '[a-z0-9]+(?:''[a-z0-9]+)?')) as w from p) group by all),
o as (select critique_id, sum(least(wa.c, wb.c)) as s from wa join wb using (critique_id, w) group by 1),
n as (select critique_id, len(regexp_extract_all(lower(coalesce(a, '')), '[a-z0-9]+(?:''[a-z0-9]+)?')) + len(regexp_extract_all(lower(coalesce(b, '')), '[a-z0-9]+(?:''[a-z0-9]+)?')) as n from p)
select critique_id, round(case when n = 0 then 1.0 else 2.0 * coalesce(s, 0) / n end, 6) as f1 from n left join o using (critique_id)
""")
def answer_overlap(spark, d):
    return A.token_f1(table(spark, d, "critique").select("critique_id", "corrected_answer", "hard_negative").distinct(), "critique_id", "corrected_answer", "hard_negative")


_SCORED = "(select metadata.judge_score as s, coalesce(metadata.repair_round, 1) = 0 as y, episode_id from dpo_pair where metadata.judge_score between 0 and 1)"


def scored(spark, d):
    return table(spark, d, "dpo_pair").where(F.col("metadata.judge_score").between(0, 1)).select("episode_id", F.col("metadata.judge_score").alias("s"), (F.coalesce(F.col("metadata.repair_round"), F.lit(1)) == 0).alias("y"))


@query(f"""
with r as {_SCORED}, t as (select distinct s as t from r union select 0.0 union select 1.0), n as (select sum(y::int) as p, sum(1 - y::int) as n from r),
m as (select t, (select sum(y::int) from r where s >= t) as tp, (select sum(1 - y::int) from r where s >= t) as fp from t),
x as (select t as threshold, round((coalesce(tp, 0) / p + 1 - coalesce(fp, 0) / n) / 2, 9) as balanced_accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) as precision, round((coalesce(tp, 0) + n - coalesce(fp, 0)) / (p + n), 9) as accuracy from m, n)
select balanced_accuracy, precision, accuracy, threshold from x order by 1 desc, 2 desc, 3 desc, 4 desc limit 1
""")
def calibrated_threshold(spark, d):
    return A.best_threshold(scored(spark, d), "s", "y")


@query("select integration.decision as gold, commitment.decision as predicted, count(*) as n from episode group by all")
def decision_confusion(spark, d):
    return A.confusion(table(spark, d, "episode").select(F.col("integration.decision").alias("gold"), F.col("commitment.decision").alias("predicted")), "gold", "predicted")


# --- sampling ------------------------------------------------------------------------------------------------------


@query("""
with r as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from documents)
select doc_id, source from r where n <= 7 or list_contains(list_transform(range(0, 7), lambda k: cast(round_even(k * (n - 1) / 6, 0) as bigint)), i)
""")
def even_cap(spark, d):
    return S.even_cap(docs(spark, d).select("doc_id", "source"), "source", ["doc_id"], 7)


@query("select doc_id, source from documents qualify row_number() over (partition by source order by sha256('17:' || doc_id), doc_id) <= 5")
def hash_cap(spark, d):
    return S.hash_cap(docs(spark, d).select("doc_id", "source"), "source", "doc_id", 5)


_WEIGHTS = "(select source as name, count(*) as w from documents group by 1)"
_QUOTA = "select name, cast(fl + (row_number() over (order by x - fl desc, name desc) <= {0} - sum(fl) over ())::int as bigint) as quota from (select name, w * {0} / sum(w) over () as x, floor(round(w * {0} / sum(w) over (), 9)) as fl from {1})"


@query(_QUOTA.format(1000, _WEIGHTS))
def quotas(spark, d):
    return S.largest_remainder(docs(spark, d).groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("w")), "name", "w", 1000)


def _jobs(spark, d):
    j = table(spark, d, "episode").where("domain is not null and source_group is not null")
    return j.groupBy("episode_id").agg(F.min(F.struct("domain", "source_group", F.coalesce("commitment.confidence", F.lit(0.0)).alias("score"))).alias("r")).select("episode_id", "r.*")


_JOBS = "(select episode_id, r.domain as domain, r.source_group as source_group, r.score as score from (select episode_id, min({'domain': domain, 'source_group': source_group, 'score': coalesce(commitment.confidence, 0.0)}) as r from episode where domain is not null and source_group is not null group by 1))"


@query(f"""
with j as {_JOBS}, q as (select name as domain, quota from ({_QUOTA.format(300, f"(select domain as name, count(*) as w from {_JOBS} group by 1)")})),
r as (select *, row_number() over (partition by domain, source_group order by score desc, episode_id) as r from j),
t as (select r.*, quota, row_number() over (partition by r.domain order by r, score desc, source_group, episode_id) as t from r left join q using (domain)),
c as (select * from t where t <= quota), f as (select *, row_number() over (order by score desc, episode_id) as f from t where not coalesce(t <= quota, false))
select episode_id, domain, source_group, score from c union all select episode_id, domain, source_group, score from f where f <= (select sum(quota) from q) - (select count(*) from c)
""")
def balanced_cap(spark, d):
    j = _jobs(spark, d)
    q = S.largest_remainder(j.groupBy(F.col("domain").alias("name")).agg(F.count(F.lit(1)).alias("w")), "name", "w", 300).withColumnRenamed("name", "domain")
    return S.balanced_cap(j, q, "domain", "source_group", "score", "episode_id")


@query("""
with t as (select doc_id, source, row_number() over (partition by source order by sha256('17:' || doc_id), doc_id) as r from documents)
select doc_id, source, cast(row_number() over (order by r, source nulls first) as integer) as position from t where r <= 500 qualify position <= 500
""")
def round_robin(spark, d):
    return S.round_robin(docs(spark, d).select("doc_id", "source"), "source", "doc_id", 500)


@query("""
with h as (select source, doc_id, sha256('17:' || doc_id) as h from documents)
select source, doc_id, nullif(coalesce(lead(doc_id) over (partition by source order by h, doc_id), first_value(doc_id) over (partition by source order by h, doc_id)), doc_id) as partner from h
""")
def derangement(spark, d):
    return S.derange(docs(spark, d), "source", "doc_id")


@query("select doc_id, source, n_chars from documents qualify row_number() over (partition by source order by n_chars desc nulls last, doc_id) <= 3")
def longest_per_source(spark, d):
    return S.first_n(docs(spark, d).select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 3)


@query("""
select task_id, ['amber', 'cobalt', 'dune'][cast(concat('0x', substr(sha256(task_id || ':judge'), 1, 8))::UBIGINT % 3 as integer) + 1] as provider from teacher_task
""")
def provider_rotation(spark, d):
    return table(spark, d, "teacher_task").select("task_id", S.rotate(F.col("task_id"), "judge", ["amber", "cobalt", "dune"]).alias("provider"))


@query("""
with s as (select doc_id, source, case when n_chars > 2000 then 'long' when n_chars > 500 then 'medium' else 'short' end as bucket, round(least(4.0, log10(coalesce(n_chars, 0) + 1)), 6) as score from documents)
select doc_id, source, bucket, score, cast(row_number() over (partition by bucket order by score desc, doc_id) as integer) as rank from s qualify rank <= case bucket when 'long' then 40 when 'medium' then 20 else 10 end
""")
def source_ranking(spark, d):
    b = F.when(F.col("n_chars") > 2000, "long").when(F.col("n_chars") > 500, "medium").otherwise("short")
    s = docs(spark, d).select("doc_id", "source", b.alias("bucket"), F.coalesce("n_chars", F.lit(0)).alias("_n"))
    return S.bucket_rank(s, "bucket", {"long": 40, "medium": 20, "short": 10}, F.round(S.popularity_score(F.col("_n")), 6), "doc_id").drop("_n")


@query("select doc_id, substr(sha256('3:' || doc_id), 1, 16) as epoch_key from documents")
def epoch_order(spark, d):
    return S.epoch_order(docs(spark, d).select("doc_id"), "doc_id", 3)


@query(r"select distinct part, array_to_string(list_transform(regexp_extract_all(lower(part), '\d+|\D+'), lambda t: case when regexp_full_match(t, '\d+') then lpad(t, 20, '0') else t end), '') as sort_key from source_document where part is not null")
def natural_order(spark, d):
    return table(spark, d, "source_document").where("part is not null").select("part", S.natural_key(F.col("part")).alias("sort_key")).distinct()


_LAB_D, _LAB_G = LABEL_.format("domain", "_"), LABEL_.format("source_group", "-")


@query(f"""
with g0 as (select distinct {_LAB_D} as domain, {_LAB_G} as source_group from episode_job where {_LAB_D} is not null and {_LAB_G} is not null),
g as (select *, row_number() over (partition by domain order by sha256('17:' || source_group), source_group) - 1 as i, count(*) over (partition by domain) as n from g0),
s as (select distinct domain, unnest(range(1, 121)) as slot from g0)
select domain, slot, source_group, substr(sha256(domain || '|' || source_group || '|' || slot), 1, 20) as job_id from s join g using (domain) where (slot - 1) % n = i
""")
def job_schedule(spark, d):
    g = table(spark, d, "episode_job").select(canon.label("domain", "_").alias("domain"), canon.label("source_group", "-").alias("source_group")).where("domain is not null and source_group is not null")
    return S.schedule(g, "source_group", "domain", g.select("domain").distinct().withColumn("quota", F.lit(120)))


@query("""
with t as (select doc_id, source, case when n_chars is null then 1 else 0 end as f, case when lang = 'en' then 0 else 1 end as tier, sha256('17:' || doc_id) as h from documents)
select doc_id, source, cast(row_number() over (order by tier, f, h, doc_id) as integer) as position from t qualify position <= 1000
""")
def work_queue(spark, d):
    t = F.when(F.col("lang") == "en", 0).otherwise(1)
    return S.queue_order(docs(spark, d), t, F.col("n_chars").isNull().cast("int"), "doc_id", 1000).select("doc_id", "source", "position")


# --- splits --------------------------------------------------------------------------------------------------------


@query(f"""
select lineage_component_id, {SPLIT.format("lineage_component_id")} as by_lineage,
 case when cast(concat('0x', substr(sha256('{{"lineage":"' || lineage_component_id || '","split":"packet"}}'), 1, 8)) as ubigint) / 4294967295.0 < 0.1 then 'validation' else 'train' end as by_packet,
 case when cast(concat('0x', substr(sha256('split:' || lineage_component_id), 1, 8)) as ubigint) % 10 <= 7 then 'train' when cast(concat('0x', substr(sha256('split:' || lineage_component_id), 1, 8)) as ubigint) % 10 = 8 then 'validation' else 'test' end as by_decile,
 case when cast(concat('0x', substr(sha1(lineage_component_id), 1, 8)) as ubigint) / 4294967296.0 < 0.05 then 'test' when cast(concat('0x', substr(sha1(lineage_component_id), 1, 8)) as ubigint) / 4294967296.0 < 0.08 then 'validation' else 'train' end as by_sha1
from (select distinct lineage_component_id from native_row where lineage_component_id is not null)
""")
def lineage_splits(spark, d):
    x = table(spark, d, "native_row").select("lineage_component_id").where("lineage_component_id is not null").distinct()
    c = F.col("lineage_component_id")
    return x.select(c, P.split_by(c).alias("by_lineage"), P.packet_split(c, "packet", 0.1).alias("by_packet"), P.decile_split(c).alias("by_decile"), P.sha1_split(c).alias("by_sha1"))


@query("""
select 'lineage_in_several_splits' as "check", count(*) as n from (select lineage_component_id from native_row where lineage_component_id is not null group by 1 having count(distinct split) > 1)
union all select 'episode_in_several_splits', count(*) from (select episode_id from native_row where episode_id is not null group by 1 having count(distinct split) > 1)
union all select 'repeated_sample', count(*) from (select sample_id from native_row group by 1 having count(*) > 1)
union all select 'empty_split', 3 - count(distinct case when split in ('train', 'validation', 'test') then split end) from native_row
""")
def split_leakage(spark, d):
    return P.leakage_report(table(spark, d, "native_row"), "sample_id", "episode_id", "lineage_component_id", "split")


@query("select count(*) as rows from episode t where split = 'train' and not exists (select 1 from episode h where h.split <> 'train' and h.lineage_component_id = t.lineage_component_id)")
def train_without_held_out(spark, d):
    e = table(spark, d, "episode")
    return P.without_held_out(e.where("split = 'train'"), e.where("split <> 'train'"), "lineage_component_id").agg(F.count(F.lit(1)).alias("rows"))


@query("""
select distinct episode_id, reference from (select episode_id, unnest(list_transform(chunks, lambda c: c.source_id)) as reference from episode_job) r where not exists (select 1 from source_document s where s.source_id = r.reference)
""")
def unknown_sources(spark, d):
    j = table(spark, d, "episode_job").select("episode_id", F.transform("chunks", lambda c: c["source_id"]).alias("refs"))
    return P.unknown_references(j, "episode_id", "refs", table(spark, d, "source_document"), "source_id")


# --- records and views ---------------------------------------------------------------------------------------------


@query(f"""
select candidate_id, task_id, completion_tokens from (select candidate_id, task_id, completion_tokens, row_number() over (partition by sha256({NORM.format("answer")}) order by coalesce(completion_tokens, -1) desc, candidate_id) as r from (select distinct candidate_id, task_id, answer, completion_tokens from candidate)) where r = 1
""")
def best_answers(spark, d):
    c = table(spark, d, "candidate").select("candidate_id", "task_id", "answer", F.col("completion_tokens").cast("double").alias("score"), "completion_tokens").distinct()
    return R.best_by_text(c, "answer", "score", "candidate_id").select("candidate_id", "task_id", "completion_tokens")


@query("""
with e as (select distinct episode_id, 'a' as origin from episode where split = 'train'), n as (select distinct episode_id, 'b' as origin from native_row where split = 'train')
select * from e union all select * from n where not exists (select 1 from e where e.episode_id = n.episode_id)
""")
def existing_first(spark, d):
    e = table(spark, d, "episode").where("split = 'train'").select("episode_id", F.lit("a").alias("origin")).distinct()
    n = table(spark, d, "native_row").where("split = 'train'").select("episode_id", F.lit("b").alias("origin")).distinct()
    return R.existing_first(e, n, "episode_id")


@query("""
select source, min(doc_id) as doc_id, array_to_string(list_sort(list(distinct lang)), '; ') as search_terms from documents where source is not null group by source
""")
def merged_catalog(spark, d):
    return R.merged_catalog(docs(spark, d).where("source is not null").select("source", "lang", "doc_id"), "source", "lang", ["doc_id"])


@query("select c.candidate_id, coalesce(t.prompt, '') as prompt from candidate c left join teacher_task t using (task_id)")
def answers_with_prompts(spark, d):
    return R.lookup(table(spark, d, "candidate").select("candidate_id", "task_id"), table(spark, d, "teacher_task"), "task_id", ["prompt"]).select("candidate_id", "prompt")


@query("""
with t as (select task_id, task_id as claim, count(*) as a from teacher_task group by all), c as (select task_id, task_id as claim, count(*) as b from critique group by all)
select task_id, claim, case when b is null then 'unchecked' when a is null then 'unknown' else 'repeated' end as problem from t full join c using (task_id, claim) where b is null or a is null or b > 1
""")
def critique_coverage(spark, d):
    t = table(spark, d, "teacher_task").select("task_id", F.col("task_id").alias("claim"))
    return R.exactly_once(t, table(spark, d, "critique").select("task_id", F.col("task_id").alias("claim")), "task_id", "claim")


@query(f"""
select sample_id, 'system: ' || case when s in ('framing', 'decomposition', 'private_solving', 'barrier', 'verification', 'continuation', 'synthesis', 'commitment', 'counterfactual', 'root_retention') then 'Produce the ' || replace(s, '_', ' ') || ' stage.' else '' end
 || chr(10) || chr(10) || 'user: ' || coalesce(subdomain, '') || chr(10) || chr(10) || 'assistant: ' || target as rendered, split
from (select *, {LABEL_.format("stage", "_")} as s from native_row where loss_mask)
""")
def instruction_rows(spark, d):
    v = R.instruction_view(table(spark, d, "native_row"), F.coalesce("subdomain", F.lit("")))
    return v.select("sample_id", R.render_messages("messages").alias("rendered"), "split")


@query(f"""
select critique_id, a as preferred, b as non_preferred from (select distinct critique_id, corrected_answer as a, hard_negative as b from critique)
where a is not null and b is not null and {NORM.format("a")} <> {NORM.format("b")}
""")
def preference_pairs(spark, d):
    k = table(spark, d, "critique").select("critique_id", "corrected_answer", "hard_negative").distinct()
    a, b = k.select("critique_id", F.col("corrected_answer").alias("t")), k.select("critique_id", F.col("hard_negative").alias("t"))
    v = R.preference_view(a.where("t is not null"), b.where("t is not null"), "critique_id", "t")
    return v.select("critique_id", F.col("preferred_output")[0]["content"].alias("preferred"), F.col("non_preferred_output")[0]["content"].alias("non_preferred"))


@query("""
with x as (select task_id, candidate_id, coalesce(answer, '') as t, coalesce(cast(sum(length(coalesce(answer, ''))) over (partition by task_id order by candidate_id rows between unbounded preceding and 1 preceding) as bigint), 0) as b from (select distinct task_id, candidate_id, answer from candidate))
select task_id, candidate_id, left(t, 600 - b) as text from x where b < 600
""")
def packets_under_budget(spark, d):
    c = table(spark, d, "candidate").select("task_id", "candidate_id", F.coalesce("answer", F.lit("")).alias("text")).distinct()
    return R.truncate_packet(c, "task_id", "candidate_id", "text", 600)


@query()
def judge_views(spark, d):
    c = table(spark, d, "candidate").select("task_id", "candidate_id", F.length(F.coalesce("answer", F.lit(""))).alias("n")).distinct()
    return R.pack_under_budget(c, "task_id", ["candidate_id"], "candidate_id", "n", 800)


@query("select task_id, cast(v as integer) as variant, task_id || '-v' || lpad(cast(v as varchar), 2, '0') as variant_id from teacher_task, range(1, 4) t(v)")
def task_variants(spark, d):
    return R.variants(table(spark, d, "teacher_task").select("task_id"), "task_id", 3)


@query("""
with e as (select episode_id, split, loaded_at, input.user_request as q, integration.published_answer as a, integration.decision as dec, commitment.confidence as c, integration.selected_artifacts as s, concat_ws(chr(10), input.user_request, integration.published_answer) as t from episode),
r as (select unnest(list_filter([case when not coalesce(regexp_full_match(episode_id, 'ep-[0-9a-f]{20}'), false) then 'id' end, case when not coalesce(split in ('train', 'validation', 'test'), false) then 'split' end, case when not coalesce(trim(q) <> '', false) then 'request' end,
 case when not coalesce(dec <> 'publish' or trim(a) <> '', false) then 'answer' end, case when not coalesce(c between 0 and 1, false) then 'confidence' end, case when len(list_distinct(coalesce(s, []))) <> len(coalesce(s, [])) then 'artifacts' end,
 case when """ + SECRET_SQL.format("t") + """ then 'secret' end, case when """ + REASONING_SQL.format("t") + """ then 'reasoning' end, case when """ + BLOCKED_SQL.format("t") + """ then 'script' end], lambda x: x is not null)) as rule from e)
select rule, count(*) as episodes from r group by rule
""")
def episode_rules(spark, d):
    return table(spark, d, "episode").select(F.explode(R.errors(R.episode_rules())).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("episodes"))


@query()
def arithmetic_errors(spark, d):
    return docs(spark, d).select("doc_id", R.arithmetic_errors(F.coalesce("text", F.lit(""))).alias("wrong")).where(F.size("wrong") > 0)


@query("""
select sample_id, cast(json_extract(target, '$.score') as integer) = cast(regexp_extract(target, '(-?\\d[\\d,]*\\.?\\d*)[^\\d]*$', 1) as double) as correct from native_row where json_extract(target, '$.score') is not null
""")
def graded_targets(spark, d):
    n = table(spark, d, "native_row").withColumn("score", F.get_json_object("target", "$.score")).where("score is not null")
    return n.select("sample_id", G.grade(F.lit("numeric"), F.col("target"), F.col("score"), F.lit("")).alias("correct"))


@query(r"""
select candidate_id, round(0.35 * least(1.0, len(regexp_extract_all(lower(a), '[a-z0-9]+(?:''[a-z0-9]+)?')) / 60.0) + 0.45 + 0.10 * (not regexp_matches(a, '(?i)\b(todo|tbd|lorem ipsum|placeholder)\b|\.\.\.\s*$'))::int
 + 0.10 * (regexp_matches(a, '([.!?)\]}]|```)\s*$') and not regexp_matches(a, '(?i)\b(and|or|to|with|because|including|such as)\s*[.!?]?\s*$'))::int, 6) as completion from (select candidate_id, coalesce(answer, '') as a from candidate)
""")
def answer_completion(spark, d):
    return table(spark, d, "candidate").select("candidate_id", G.completion("answer", 60, []).alias("completion"))


# --- statistics ----------------------------------------------------------------------------------------------------


@query(f"""
with r as {_SCORED}, m as (select s, y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 as mr from r), n as (select sum(y::int) as n1, sum(1 - y::int) as n0 from r)
select cast(n1 as bigint) as n1, cast(n0 as bigint) as n0, round(((select sum(mr) from m where y) - n1 * (n1 + 1) / 2) / (n1 * n0), 9) as auroc from n
""")
def judge_auroc(spark, d):
    return U.auroc(scored(spark, d), "s", "y")


@query("""
with b as (select prompt_tokens as a, completion_tokens as b from candidate where prompt_tokens is not null and completion_tokens is not null),
r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb from b)
select round(corr(ra, rb), 9) as spearman, count(*) as n from r
""")
def token_rank_correlation(spark, d):
    return U.spearman(table(spark, d, "candidate"), "prompt_tokens", "completion_tokens")




@query(f"""
with r as (select episode_id, max(s) as s, bool_or(y) as y from {_SCORED} group by 1), x as (select sum((not y)::int) over (order by s desc, episode_id rows unbounded preceding) as e, count(*) over () as n from r)
select max(n) as n, round(sum(e) / (max(n) * max(n)), 9) as augrc from x
""")
def judge_augrc(spark, d):
    r = scored(spark, d).groupBy("episode_id").agg(F.max("s").alias("s"), F.bool_or("y").alias("y"))
    return U.risk_coverage(r.select("episode_id", "s", (~F.col("y")).alias("w")), "s", "w", "episode_id")


@query("select count(prompt_tokens - completion_tokens) as n, round(avg(prompt_tokens - completion_tokens), 9) as mean, round(avg(prompt_tokens - completion_tokens) - 1.2815515655446004 * stddev_samp(prompt_tokens - completion_tokens) / sqrt(count(prompt_tokens - completion_tokens)), 9) as lower from candidate")
def token_difference_bound(spark, d):
    return U.paired_lcb(table(spark, d, "candidate"), "prompt_tokens", "completion_tokens")


@query(f"""
with r as (select s, (cast(concat('0x', substr(sha256(episode_id), 1, 8)) as ubigint) % 5)::integer as fold from {_SCORED}), k as (select fold, s, row_number() over (partition by fold order by s) as r, count(*) over (partition by fold) as n from r)
select fold, max(n) as n, min(case when r = ceil((n + 1) * 0.9 - 1e-12) then s end) as threshold from k group by fold
""")
def conformal_folds(spark, d):
    fold = F.pmod(F.conv(canon.stable_hash("episode_id", 8), 16, 10).cast("long"), F.lit(5)).cast("int")
    return U.conformal_threshold(scored(spark, d).withColumn("fold", fold), "fold", "s", 0.1)


@query(f"with r as {_SCORED} select t as threshold, (select count(*) from r where s >= t) as accepted, round((select count(*) from r where s >= t) / (select count(*) from r), 6) as coverage, round((select avg(1 - y::int) from r where s >= t), 6) as risk from (select unnest([0.7, 0.8, 0.9]::double[]) as t)")
def selective_risk(spark, d):
    return U.selective_risk(scored(spark, d), "s", "y", [0.7, 0.8, 0.9])


@query()
def paired_areas(spark, d):
    c = table(spark, d, "candidate").select(F.col("prompt_tokens").cast("double").alias("a"), F.col("completion_tokens").cast("double").alias("b"), (F.length("answer") > 400).alias("y")).where("y is not null")
    return U.delong_pair(c, "a", "b", "y")


@query()
def paired_test(spark, d):
    k = table(spark, d, "critique").select("accepted", (F.col("confidence") > 0.8).alias("sure")).where("accepted is not null and sure is not null")
    return U.mcnemar(k, "accepted", "sure")


@query()
def betting_process(spark, d):
    c = table(spark, d, "candidate").where("elapsed_seconds is not null and completion_tokens is not null").select(F.concat_ws("/", "model", "provider_id").alias("stream"), "candidate_id", (-F.col("elapsed_seconds")).alias("a"), F.col("completion_tokens").cast("double").alias("b"), (F.length("answer") > 400).alias("ok")).distinct()
    return U.e_process(c, "stream", "candidate_id", "a", "b", "ok").drop("waiting")


@query("""
with z as (select model, (avg(prompt_tokens - completion_tokens) / (stddev_samp(prompt_tokens - completion_tokens) / sqrt(count(prompt_tokens - completion_tokens)))) as z from candidate group by model)
select count(z) as n, round(sum(z) / sqrt(count(z)), 6) as z from z
""")
def pooled_differences(spark, d):
    x = F.col("prompt_tokens") - F.col("completion_tokens")
    z = table(spark, d, "candidate").groupBy("model").agg(F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x))).alias("z"))
    return U.stouffer(z, "z").select("n", F.round("z", 6).alias("z"))


# --- streams as batches --------------------------------------------------------------------------------------------


@query("select date_trunc('minute', ts) as start, event_type, count(*) as n from events group by all")
def request_rates(spark, d):
    return streams.request_rates(table(spark, d, "events"), "ts", "event_type")


@query("""
with u as (select user_id, event_id, value, sum(coalesce(value, 0)) over (partition by user_id order by ts, event_id rows unbounded preceding) as used from events)
select user_id, event_id, round(used, 4) as used from u where used <= 200
""")
def budgeted_requests(spark, d):
    return streams.within_budget(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 200).select("user_id", "event_id", F.round("used", 4).alias("used"))


@query("select task_id from teacher_task where task_id not in (select task_id from candidate where task_id is not null)")
def open_work(spark, d):
    return streams.todo(table(spark, d, "teacher_task"), table(spark, d, "candidate"), "task_id").select("task_id")


# --- nested values, windows, rotations -----------------------------------------------------------------------------


@query(r"select sample_id, json_extract_string(target, '$.summary') as summary from native_row")
def target_strings(spark, d):
    return table(spark, d, "native_row").select("sample_id", F.try_element_at(N.string_leaves("target"), F.lit(1)).alias("summary"))


@query(r"""
with n as (select candidate_id, lower(trim(regexp_replace(coalesce(answer, ''), '[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) as t from candidate)
select candidate_id, 'none:' || left(replace(t, '−', '-'), 80) as signature from n
""")
def answer_signatures(spark, d):
    return table(spark, d, "candidate").select("candidate_id", N.answer_signature(F.coalesce("answer", F.lit("")), F.lit("none")).alias("signature"))


@query(r"""
select candidate_id, coalesce(try_cast(replace(list_last(regexp_extract_all(' ' || coalesce(answer, ''), '[^\w.]([-+]?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?)', 1)), ',', '') as double) = length(answer), false) as correct from candidate
""")
def graded_lengths(spark, d):
    c = table(spark, d, "candidate").select("candidate_id", F.coalesce("answer", F.lit("")).alias("answer"))
    return c.select("candidate_id", G.grade(F.lit("numeric"), F.col("answer"), F.length("answer").cast("string"), F.lit("")).alias("correct"))


@query()
def canonical_targets(spark, d):
    return table(spark, d, "native_row").select("sample_id", F.substring(F.sha2(N.canonical_json("target"), 256), 1, 32).alias("target_hash"))


@query("""
with h as (select source, doc_id, title, sha256('17:' || doc_id) as h from documents), n as (select source, doc_id, coalesce(lead({'k': doc_id, 'v': title}) over w, first_value({'k': doc_id, 'v': title}) over w) as x from h window w as (partition by source order by h, doc_id))
select source, doc_id, case when x.k <> doc_id then x.v end as hard_negative from n
""")
def hard_negatives(spark, d):
    return S.hard_negatives(docs(spark, d), "source", "doc_id", "title")


@query()
def coherent_windows(spark, d):
    return S.coherent_window(docs(spark, d).select("doc_id", "source", "part"), "source", ["doc_id"], 4)


@query(r"""
select doc_id, len(regexp_extract_all(coalesce(text, ''), '(?m)^#{1,6}[ 	]+([^
]+?)[ 	
]*$')) as headings, array_to_string(list_filter(['code', 'table'], lambda k: case k when 'code' then contains(lower(coalesce(text, '')), '```') else contains(lower(coalesce(text, '')), '|---|') end), ',') as holds from documents
""")
def document_features(spark, d):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, d).select("doc_id", F.size(F.regexp_extract_all(t, F.lit(r"(?m)^#{1,6}[ \t]+([^\n]+?)[ \t\r]*$"), F.lit(1))).alias("headings"), F.array_join(T.marker_coverage(t, {"code": ["```"], "table": ["|---|"]}), ",").alias("holds"))
