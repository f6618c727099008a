"""Queries over module_tree."""

from weftline.operators.hierarchy import descendants, hierarchy_faults, resolve_hierarchy, with_descendants
from weftline.plans.registry import core
from weftline.runtime import table

_ANC = """WITH RECURSIVE n AS (SELECT DISTINCT id, parent_id, name, lvl FROM module_tree WHERE id IS NOT NULL),
a(id, anc) AS (SELECT id, parent_id FROM n WHERE parent_id IS NOT NULL
  UNION SELECT a.id, n.parent_id FROM a JOIN n ON n.id = a.anc WHERE n.parent_id IS NOT NULL),
cyc AS (SELECT DISTINCT id FROM a WHERE id = anc),
below AS (SELECT DISTINCT id FROM a WHERE anc IN (SELECT id FROM cyc) AND id NOT IN (SELECT id FROM cyc)),
orph AS (SELECT DISTINCT id FROM a WHERE anc NOT IN (SELECT id FROM n)),
dep AS (SELECT n.id, count(a.anc) AS depth FROM (SELECT DISTINCT id FROM n) n LEFT JOIN a USING (id) GROUP BY n.id)"""


@core.query(
    "p6_found",
    _ANC
    + """ SELECT n.id, CASE WHEN n.id IN (SELECT id FROM cyc) THEN 'cycle' WHEN n.id IN (SELECT id FROM below) THEN 'below_cycle'
 WHEN n.id IN (SELECT id FROM orph) THEN 'orphan' ELSE 'lvl' END AS kind FROM n JOIN dep USING (id)
 WHERE n.id IN (SELECT id FROM cyc) OR n.id IN (SELECT id FROM below) OR n.id IN (SELECT id FROM orph) OR n.lvl IS NULL OR n.lvl <> dep.depth""",
)
def p6_found(spark, d):
    return hierarchy_faults(table(spark, d, "module_tree"))


@core.query(
    "p6_nodes",
    _ANC
    + """, up(id, cur, pid, path, depth) AS (SELECT id, id, parent_id, name, 0 FROM n WHERE id NOT IN (SELECT id FROM cyc) AND id NOT IN (SELECT id FROM below)
  UNION ALL SELECT up.id, n.id, n.parent_id, n.name || '/' || up.path, up.depth + 1 FROM up JOIN n ON n.id = up.pid),
fin AS (SELECT id, arg_max(cur, depth) AS top, max(depth) AS depth, arg_max(path, depth) AS path FROM up GROUP BY id),
kids AS (SELECT a.anc AS id, count(*) AS c FROM a JOIN fin USING (id) GROUP BY a.anc)
SELECT n.id, n.parent_id, n.name,
 CASE WHEN n.id IN (SELECT id FROM cyc) THEN 'cycle' WHEN n.id IN (SELECT id FROM below) THEN 'below_cycle' WHEN n.id IN (SELECT id FROM orph) THEN 'orphan' ELSE 'tree' END AS kind,
 CASE WHEN n.id NOT IN (SELECT id FROM orph) THEN fin.top END AS root_id, CAST(fin.depth AS INTEGER) AS depth, fin.path,
 CASE WHEN fin.id IS NOT NULL THEN coalesce(kids.c, 0) END AS descendants
FROM n LEFT JOIN fin USING (id) LEFT JOIN kids USING (id)""",
)
def p6_nodes(spark, d):
    return with_descendants(resolve_hierarchy(table(spark, d, "module_tree"))).drop("id_path")


@core.query(
    "p6_descendants",
    _ANC + " SELECT anc AS ancestor_id, id AS descendant_id FROM a WHERE anc IN (SELECT id FROM n) AND id NOT IN (SELECT id FROM cyc) AND id NOT IN (SELECT id FROM below)",
)
def p6_descendants(spark, d):
    return descendants(resolve_hierarchy(table(spark, d, "module_tree"))).select("ancestor_id", "descendant_id")


