"""Record operators: keyed deduplication, joins with asserted keys, views for training, deterministic validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.canon import label, normalize_text, stable_hash
from gristmill.functions import text as T
from gristmill.operators.corpus import first_by

# --- deduplication -------------------------------------------------------------------------------------------------


def best_by_text(df: DataFrame, text: str, score: str, tie: str) -> DataFrame:
    """One row for each normalised, case-sensitive text: the best score, then the least tie."""
    keyed = df.withColumn("_key", stable_hash(normalize_text(F.coalesce(text, F.lit(""))), 32))
    return first_by(keyed, ["_key"], [-F.coalesce(F.col(score), F.lit(-1.0)), F.col(tie)]).drop("_key")


def first_on_both(df: DataFrame, order: str, key_a: str, key_b: str) -> DataFrame:
    """First-wins on two keys at once: a row stays if no kept row before it shares either key.

    In each round rows that are first on both keys among the undecided are kept, and all that share a key with
    them fall out; the rounds needed are the longest chain of such conflicts, and each decides its first row at least.
    Null keys collide with nothing; rows without an order are left out.
    """
    from gristmill.session import cut

    left, kept = cut(df.where(F.col(order).isNotNull()).select(order, key_a, key_b)), None
    while kept is None or not left.isEmpty():
        a = left.where(F.col(key_a).isNotNull()).groupBy(key_a).agg(F.min(order).alias("_a"))
        b = left.where(F.col(key_b).isNotNull()).groupBy(key_b).agg(F.min(order).alias("_b"))
        j = left.join(a, key_a, "left").join(b, key_b, "left")
        now = cut(j.where((F.col("_a").isNull() | (F.col("_a") == F.col(order))) & (F.col("_b").isNull() | (F.col("_b") == F.col(order)))).select(order, key_a, key_b))
        kept = now.select(order) if kept is None else kept.union(now.select(order))
        left = cut(left.join(now.select(order), order, "left_anti").join(now.select(key_a), key_a, "left_anti").join(now.select(key_b), key_b, "left_anti").select(order, key_a, key_b))
    return df.join(kept, order, "left_semi")


def existing_first(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows, then new rows whose key they lack."""
    return existing.unionByName(new.join(existing.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def merged_catalog(df: DataFrame, key: str, term: str, order: list) -> DataFrame:
    """One row for each key, the first by an order, with all its search terms joined in order."""
    cols = [F.col(c) for c in df.columns if c not in (key, term)]
    g = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"), F.array_join(F.array_sort(F.collect_set(term)), "; ").alias("search_terms"))
    return g.select(key, "_r.*", "search_terms")


# --- joins ---------------------------------------------------------------------------------------------------------


def lookup(left: DataFrame, right: DataFrame, key: str, columns: list[str], default: str = "") -> DataFrame:
    """Left join on a key the right side must hold once; missing texts become the default. Repeated keys raise when run."""
    one = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in columns])
    one = one.where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("_n")
    return left.join(one, key, "left").withColumns({c: F.coalesce(c, F.lit(default)) for c in columns})


def exactly_once(claims: DataFrame, checks: DataFrame, key: str, claim: str) -> DataFrame:
    """key, claim, problem: claims without a check, checks of no claim, claims checked more than once."""
    a = claims.groupBy(key, claim).agg(F.count(F.lit(1)).alias("a"))
    b = checks.groupBy(key, claim).agg(F.count(F.lit(1)).alias("b"))
    j = a.join(b, [key, claim], "full")
    return j.withColumn("problem", F.when(F.col("b").isNull(), "unchecked").when(F.col("a").isNull(), "unknown").when(F.col("b") > 1, "repeated")).where("problem is not null").select(key, claim, "problem")


# --- views for training --------------------------------------------------------------------------------------------

#: The stages of an episode's native rows.
STAGES = ["framing", "decomposition", "private_solving", "barrier", "verification", "continuation", "synthesis", "commitment", "counterfactual", "root_retention"]


def native_rows(episodes: DataFrame) -> DataFrame:
    """Stage rows of episodes with arrays lanes, continuation_pairs, counterfactuals, root_anchor_evaluations, in one scan.

    One row each for framing, decomposition, barrier, verification, synthesis and commitment, one for every element
    of the arrays; continuation rows train only if eligible. Null arrays count as empty.
    """

    def single(stage: str, target: Column) -> Column:
        return F.array(F.struct(F.lit(stage).alias("stage"), F.lit(0).alias("index"), target.alias("target"), F.lit(True).alias("loss_mask")))

    def each(stage: str, items: str, mask=None) -> Column:
        return F.transform(F.coalesce(F.transform(items, lambda x: F.struct(F.to_json(x).alias("t"), (mask(x) if mask else F.lit(True)).alias("m"))), F.array().cast("array<struct<t:string,m:boolean>>")), lambda x, i: F.struct(F.lit(stage).alias("stage"), i.alias("index"), x["t"].alias("target"), F.coalesce(x["m"], F.lit(False)).alias("loss_mask")))

    parts = [
        single("framing", F.to_json("frame")), single("decomposition", F.to_json(F.struct("routing"))), each("private_solving", "lanes"), single("barrier", F.to_json("barrier")), single("verification", F.to_json(F.struct("verification"))),
        each("continuation", "continuation_pairs", lambda x: x["eligible"]), single("synthesis", F.to_json("integration")), single("commitment", F.to_json("commitment")), each("counterfactual", "counterfactuals"), each("root_retention", "root_anchor_evaluations"),
    ]
    e = episodes.select("episode_id", "split", "lineage_component_id", "domain", F.explode(F.concat(*parts)).alias("r"))
    return e.select(F.concat_ws("-", "episode_id", "r.stage", F.col("r.index").cast("string")).alias("sample_id"), "episode_id", "split", "lineage_component_id", "domain", "r.stage", "r.target", "r.loss_mask")


def instruction_view(rows: DataFrame, user: Column, system: dict[str, str] | None = None) -> DataFrame:
    """sample_id, messages, split of rows that train; the system text is looked up by stage in any spelling, empty for others."""
    texts = system or {s: f"Produce the {s.replace('_', ' ')} stage." for s in STAGES}
    table = F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), F.lit(v))])
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.where("loss_mask").select("sample_id", F.array(turn("system", F.coalesce(table[F.col("stage")], table[label("stage", "_")], F.lit(""))), turn("user", user), turn("assistant", F.col("target"))).alias("messages"), "split")


def preference_view(accepted: DataFrame, rejected: DataFrame, key: str, text: str) -> DataFrame:
    """key, preferred_output, non_preferred_output for keys on both sides whose texts differ after normalising."""
    turn = lambda c: F.array(F.struct(F.lit("assistant").alias("role"), F.col(c).alias("content")))
    j = accepted.select(key, F.col(text).alias("_a")).join(rejected.select(key, F.col(text).alias("_b")), key).where(normalize_text("_a") != normalize_text("_b"))
    return j.select(key, turn("_a").alias("preferred_output"), turn("_b").alias("non_preferred_output"))


def role_errors(messages: str) -> Column:
    """Whether turns fail to alternate user and assistant, after at most one system turn, ending with the assistant."""
    roles = F.transform(messages, lambda m: m["role"])
    body = F.when(F.try_element_at(roles, F.lit(1)) == "system", F.slice(roles, F.lit(2), F.size(roles))).otherwise(roles)
    good = F.forall(F.transform(body, lambda r, i: r == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    return ~(good & (F.size(body) > 0) & (F.size(body) % 2 == 0))


def render_messages(messages: str) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n")


def variants(df: DataFrame, key: str, times: int) -> DataFrame:
    v = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("variant"))
    return v.withColumn("variant_id", F.concat(F.col(key), F.lit("-v"), F.lpad(F.col("variant").cast("string"), 2, "0")))


def pack_under_budget(df: DataFrame, key: str, order: list[str], item: str, size: str, budget: int) -> DataFrame:
    """key, taken, omitted: items smallest first while they fit, skipping what does not (bounded lists of one record)."""
    items = F.array_sort(F.collect_list(F.struct(F.col(size).cast("long").alias("s"), F.col(item).alias("i"))))
    g = df.groupBy(key).agg(items.alias("x"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("taken"), F.array().cast("array<string>").alias("omitted"))
    fits = lambda a, x: a["used"] + x["s"] <= budget
    fold = F.aggregate("x", zero, lambda a, x: F.struct(F.when(fits(a, x), a["used"] + x["s"]).otherwise(a["used"]).alias("used"), F.when(fits(a, x), F.array_append(a["taken"], x["i"].cast("string"))).otherwise(a["taken"]).alias("taken"), F.when(fits(a, x), a["omitted"]).otherwise(F.array_append(a["omitted"], x["i"].cast("string"))).alias("omitted")))
    return g.select(key, fold.alias("f")).select(key, "f.taken", "f.omitted", "f.used")


def truncate_packet(df: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """Rows of a packet in order under a running character budget, the last one cut."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum(F.length(text)).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_before", before).where(F.col("_before") < budget).withColumn(text, F.left(F.col(text), (F.lit(budget) - F.col("_before")).cast("int"))).drop("_before")


# --- validation ----------------------------------------------------------------------------------------------------


def errors(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks, in order; a rule that cannot be told counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def text_rules(column: str) -> dict[str, Column]:
    t = F.coalesce(column, F.lit(""))
    return {f"{column}: replacement character": ~t.contains("�"), f"{column}: secret": ~T.has_secret(t), f"{column}: private reasoning": ~T.has_reasoning(t), f"{column}: blocked script": ~T.blocked_script(t)}


def unique(items: Column) -> Column:
    return F.size(F.array_distinct(items)) == F.size(items)


def covers(items: Column, other: Column) -> Column:
    """Both arrays hold the same values."""
    return (F.size(F.array_except(items, other)) == 0) & (F.size(F.array_except(other, items)) == 0)


def ordered_labels(x: Column, names: list[str]) -> Column:
    """All labels occur at line starts, in the given order."""
    return x.rlike("(?s)" + ".*".join(rf"(?:^|\n)\s*{n}\s*:" for n in names))


def arithmetic_errors(x: Column) -> Column:
    """Equations ``a op b = c`` of a text that do not hold, as written; chained and power expressions are left alone."""
    num = r"(-?\d[\d,]*(?:\.\d+)?)"
    pattern = rf"(?<![\d.,*/+\-^] ?){num}\s*([+\-*/×÷])\s*{num}\s*=\s*{num}(?!\s*[*/+\-^×÷]|\d|[.,]\d)"
    cols = [F.regexp_extract_all(x, F.lit(pattern), F.lit(i)) for i in (1, 2, 3, 4)]
    value = lambda s: F.regexp_replace(s, ",", "").cast("double")

    def wrong(z: Column) -> Column:
        a, op, b, c = value(z["0"]), z["1"], value(z["2"]), value(z["3"])
        got = F.when(op == "+", a + b).when(op == "-", a - b).when(op.isin("*", "×"), a * b).otherwise(F.try_divide(a, b))
        places = F.length(F.regexp_extract(z["3"], r"\.(\d+)$", 1))
        slack = F.greatest(F.lit(1e-9), 1e-9 * F.abs(c), 0.5 * F.pow(F.lit(10.0), -places))
        return F.coalesce(F.abs(got - c) > slack, F.lit(False))

    return F.array_distinct(F.transform(F.filter(F.arrays_zip(*[c.alias(str(i)) for i, c in enumerate(cols)]), wrong), lambda z: F.concat_ws(" ", z["0"], z["1"], z["2"], F.lit("="), z["3"])))


def declared_word_count(x: Column) -> Column:
    """(declared, counted) of a text that states "(N words)"; nulls if it states none."""
    said = F.regexp_extract(x, r"(?i)\((\d{1,5})\s+words\)", 1)
    body = F.regexp_replace(x, r"(?i)\(\d{1,5}\s+words\)", " ")
    return F.struct(said.try_cast("int").alias("declared"), F.when(said != "", F.regexp_count(body, F.lit(r"\S+"))).alias("counted"))


def episode_rules() -> dict[str, Column]:
    """Invariants of an episode row with request, answer, decision, confidence and difficulty."""
    request, answer = F.col("input.user_request"), F.col("integration.published_answer")
    return {
        "id": F.col("episode_id").rlike(r"^ep-[0-9a-f]{20}$"),
        "split": F.col("split").isin("train", "validation", "test"),
        "request": F.trim(request) != "",
        "answer": (F.col("integration.decision") != "publish") | (F.trim(answer) != ""),
        "confidence": F.col("commitment.confidence").between(0, 1),
        "artifacts": unique(F.coalesce("integration.selected_artifacts", F.array().cast("array<string>"))),
        "secret": ~T.has_secret(F.concat_ws("\n", request, answer)),
        "reasoning": ~T.has_reasoning(F.concat_ws("\n", request, answer)),
        "script": ~T.blocked_script(F.concat_ws("\n", request, answer)),
    }


def json_leaves(x: str) -> Column:
    """All string leaves of a flat JSON object, in order of keys."""
    m = F.from_json(x, "map<string,string>")
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: e["value"])
