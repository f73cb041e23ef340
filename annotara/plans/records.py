"""Queries of the core problems: hierarchies, nested records, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotara.operators import hierarchy, nested, packed
from annotara.session import cut, table

LINKS = {"subcls": "subcls", "br": "br"}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every node of both hierarchies."""
    out = hierarchy.solve(hierarchy.links(table(spark, d, "concepts"), "node_id", LINKS))
    return out.select("link", F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path from the root to every node that reaches one."""
    out = hierarchy.solve(hierarchy.links(table(spark, d, "concepts"), "node_id", LINKS), with_path=True)
    return out.filter("depth >= 0").select("link", F.col("node").alias("node_id"), F.array_join("path", ">").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of both hierarchies."""
    out = cut(hierarchy.solve(hierarchy.links(table(spark, d, "concepts"), "node_id", LINKS), with_path=True))
    return hierarchy.descendants(out).select("link", F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries, references, passages and annotations as one flat table."""
    return nested.flat_records(table(spark, d, "omim_responses"), table(spark, d, "bioc_docs"))


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every table that the paths of both record kinds have, all fields kept."""
    out = nested.all_tables(table(spark, d, "omim_responses"), table(spark, d, "bioc_docs"))
    place = lambda c: F.array_join(c, ".").alias(c)
    return out.select("src", "tbl", "rec_id", place("ordinals"), place("parent"), F.to_json("fields").alias("fields"))


def p3_locations(spark: SparkSession, d: str) -> DataFrame:
    """One of those tables: the places of annotations, with their parents' positions."""
    out = nested.all_tables(table(spark, d, "omim_responses"), table(spark, d, "bioc_docs")).filter("src = 'bioc' and tbl = 'passages[].annotations[].locations[]'")
    pos = lambda i: F.element_at("ordinals", i)
    return out.select(F.col("rec_id").alias("row_no"), pos(1).alias("passage"), pos(2).alias("annotation"), pos(3).alias("pos"), F.col("fields")["offset"].cast("int").alias("offset"), F.col("fields")["length"].cast("int").alias("length"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Keywords, one per row with position."""
    return packed.unpack(packed.packed_fields(table(spark, d, "geo_series")), ["row_no", "src"]).select("row_no", "src", "pos", "val")


_CLEAN = "regexp_replace(regexp_replace({c}, '^[\\s<]+|[\\s>]+$', '', 'g'), '^.*[/#]', '')"


def _clean(c: str) -> str:
    b = _CLEAN.format(c=c)
    p = f"regexp_replace({b}, '^([A-Za-z]+)_([0-9A-Za-z]+)$', '\\1:\\2')"
    return f"case when {b} = '' then null when regexp_matches({p}, '^[A-Za-z]+:') then upper(split_part({p}, ':', 1)) || substr({p}, strpos({p}, ':')) else {p} end"


_EDGES = f"""edges as (
  select link, node, min(parent) as parent from (
    select 'subcls' as link, {_clean('node_id')} as node, {_clean('subcls')} as parent from concepts
    union all select 'br', {_clean('node_id')}, {_clean('br')} from concepts)
  where node is not null and parent is not null group by link, node)"""

_TREE = f"""with recursive {_EDGES},
tops as (select distinct link, parent as node from edges e where not exists (select 1 from edges f where f.link = e.link and f.node = e.parent)),
tree(link, node, root, depth, path) as (
  select link, node, node, 0::bigint, node from tops
  union all select t.link, e.node, t.root, t.depth + 1, t.path || '>' || e.node from tree t join edges e on e.link = t.link and e.parent = t.node)"""

def _json(c: str) -> str:
    """The elements of a value that should be an array: a lone object is one, also held as text."""
    held = f"(case when json_valid({c}->>'$') then ({c}->>'$')::json end)"
    one = lambda j: f"when json_type({j}) = 'ARRAY' then from_json({j}, '[\"json\"]') when json_type({j}) = 'OBJECT' then [{j}]"
    return f"(case {one(c)} when json_type({c}) = 'VARCHAR' then (case {one(held)} end) end)"


def _bare(c: str, wrapper: str) -> str:
    return f"(case when json_type({c}->'{wrapper}') = 'OBJECT' then {c}->'{wrapper}' else {c} end)"


def _elements(rel: str, keys: str, c: str, wrapper: str) -> str:
    each = f"select {keys}, unnest({_json(c)}) as e, unnest(range(len({_json(c)}))) as pos from {rel}"
    return f"(select {keys}, pos, {_bare('e', wrapper)} as e from ({each}) where json_type(e) = 'OBJECT')"


_P3 = f"""with r as (select response_id as rec, {_bare('j', 'omim')} as j from (select response_id, omim::json as j from omim_responses where json_valid(omim))),
en as {_elements('r', 'rec', "(j->'entryList')", 'entry')}, er as {_elements('(select rec, pos as up, e as x from en)', 'rec, up', "(x->'referenceList')", 'reference')},
rl as {_elements('r', 'rec', "(j->'referenceLists')", '-')}, lr as {_elements('(select rec, pos as up, e as x from rl)', 'rec, up', "(x->'referenceList')", 'reference')},
pa as (select row_no, p, i - 1 as i from (select row_no, unnest(passages) as p, generate_subscripts(passages, 1) as i from bioc_docs) where p is not null),
an as (select row_no, i, a, k - 1 as k from (select row_no, i, unnest(p.annotations) as a, generate_subscripts(p.annotations, 1) as k from pa) where a is not null)
select 'entry' as kind, rec as rec_id, pos as pos1, -1::bigint as pos2, coalesce(e->>'mimNumber', '') as ident from en
union all select 'entry_ref', rec, up, pos, coalesce(e->>'pubmedID', '') from er union all select 'list_ref', rec, up, pos, coalesce(e->>'pubmedID', '') from lr
union all select 'passage', row_no, i, -1, coalesce(p.offset::varchar, '') from pa union all select 'annotation', row_no, i, k, coalesce(a.infons.concept, '') from an"""

QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p3_found": p3_found, "p3_locations": p3_locations, "p3_tables": p3_tables, "p6_found": p6_found}

SQL = {
    "p3_found": _P3,
    "p3_locations": """with pa as (select row_no, unnest(passages) as p, unnest(range(len(passages))) as i from bioc_docs), an as (select row_no, i, unnest(p.annotations) as a, unnest(range(len(p.annotations))) as k from pa where p is not null),
lo as (select row_no, i, k, unnest(a.locations) as l, unnest(range(len(a.locations))) as n from an where a is not null) select row_no, i as passage, k as annotation, n as pos, l.offset as offset, l.length as length from lo where l is not null""",
    "p2_found": f"""{_TREE},
walk(link, node, cur) as (
  select e.link, e.node, e.parent from edges e where not exists (select 1 from tree t where t.link = e.link and t.node = e.node)
  union select w.link, w.node, e.parent from walk w join edges e on e.link = w.link and e.node = w.cur),
circle as (select w.link, w.node, w.cur from walk w join walk v on v.link = w.link and v.node = w.cur and v.cur = w.cur)
select link, node as node_id, root as root_id, depth from tree
union all select link, node, min(cur), -1::bigint from circle group by link, node""",
    "p2_paths": f"{_TREE} select link, node as node_id, path from tree",
    "p2_descendants": f"""{_TREE}, parts as (select link, node, depth, string_split(path, '>') as p from tree where depth > 0),
lv as (select link, node, depth, p, unnest(range(0, depth)) as i from parts)
select link, p[i + 1] as node_id, node as descendant_id, depth - i as distance from lv""",
}
