"""DuckDB SQL of this package's queries, where SQL can express them on whole tables."""

from gristmill.llm.splits import UNKNOWN

LABEL = r"nullif(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '[-_\s]+', '{1}', 'g'), '')"

P3 = f"""
with jobs as (select distinct {LABEL.format("source_group", "-")} as g, episode_id from episode_job where episode_id is not null)
select g as source_group from jobs where g is not null group by g
having count(*) * 25 > (select count(distinct episode_id) from jobs)
"""

P4 = r"""
select distinct source_id from (
  select source_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) as p from source_document where source_id is not null)
where length(regexp_replace(p, '^\s+|\s+$', '', 'g')) > 4200
"""

_P7 = f"""
with cells as (select distinct sample_id, {LABEL.format("domain", "_")} as domain, {LABEL.format("stage", "_")} as stage from native_row),
k as (select domain, stage, count(*) as k from cells where domain is not null and stage is not null group by all)
select t.domain, t.stage from target_mix t left join k using (domain, stage)
where 10000 * coalesce(k, 0) < target_per_mille * (select count(distinct sample_id) from cells) or coalesce(k, 0) < min_rows
"""

_KNOWN = "case when {0} not in (" + ", ".join(f"'{x}'" for x in UNKNOWN) + ") then {0} end"

_P5 = f"""
with recursive j as (select distinct episode_id as e, {_KNOWN.format("g")} as g, {_KNOWN.format("c")} as c from (select episode_id, {LABEL.format("source_group", "-")} as g, {LABEL.format("lineage_component_id", "-")} as c from episode_job) where episode_id is not null),
half as (select 'e' || e as a, 'g' || g as b from j where g is not null union select 'e' || e, 'c' || c from j where c is not null),
edges as (select a, b from half union select b, a from half),
reach as (select distinct 'g' || g as s, 'g' || g as node from j where g is not null union select s, b from reach join edges on node = a)
select substr(s, 2) as source_group_a, substr(node, 2) as source_group_b from reach where node like 'g%' and s < node
"""

SQL = {"p5_found": _P5, "p3_found": P3, "p4_found": P4, "p7_found": _P7}
