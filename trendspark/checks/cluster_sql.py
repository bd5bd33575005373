"""The density hierarchy as DuckDB SQL.

A spanning tree is grown from the least id, always by the nearest point (``grown``). In the
order of growth the components below a weight are runs: a run ends where the next point was
reached by that weight or more. So every distinct weight gives its components by a running
sum, and the condensed hierarchy follows from runs inside runs.
"""

from __future__ import annotations

# fixed value: how far labels move the planted points apart
APART = 0.6

POINTS = f"""
points as materialized (
    select vec_id id, cast(embedding[1] as double) + {APART}::double * (label % 4) x,
           cast(embedding[2] as double) + {APART}::double * (label // 4) y, cast(embedding[3] as double) z
    from embeddings),
size as materialized (select count(*) n, greatest(2, cast(floor(sqrt(count(*))) as int)) least,
                greatest(1, least(count(*) - 1, cast(floor(floor(sqrt(count(*))) / 1.5::double) as int))) samples from points),
apart as materialized (
    select a.id i, b.id j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 9) d
    from points a join points b on a.id <> b.id),
core as materialized (
    select i, d core from (select i, d, row_number() over (partition by i order by d, j) k from apart), size where k = samples),
reach as materialized (
    select i, j, greatest(d, a.core, b.core) w from apart join core a using (i) join core b on b.i = j),
grown as (
    select 0 step, id, cast('infinity' as double) best, case when id = first_ then 0 end at_, first_ newest
    from points, (select min(id) first_ from points)
    union all
    select step + 1, id, near, case when id = pick then step + 1 else at_ end, pick
    from (select *, first_value(id) over (order by at_ is not null, near, id) pick
          from (select g.step, g.id, g.at_, case when g.at_ is null then least(g.best, w) else g.best end near
                from grown g left join reach on i = g.newest and j = g.id))
    where step + 1 < (select n from size)),
path as materialized (
    select at_ place, id, case when at_ = 0 then cast('infinity' as double) else best end w
    from grown where step = (select n - 1 from size))"""

HIERARCHY = """
levels as materialized (
    select w, row_number() over (order by w desc) lvl from (select distinct w from path where place > 0)),
runs as materialized (
    select lvl, l.w, place, id, sum(case when p.w >= l.w then 1 else 0 end) over (partition by lvl order by place) run
    from levels l, path p),
big as materialized (
    select lvl, w, min(place) lo, max(place) hi from runs, size group by lvl, w, run, least having count(*) >= least),
held as materialized (
    select b.lvl, b.w, b.lo, b.hi, coalesce(p.lo, -1) above
    from big b left join big p on p.lvl = b.lvl - 1 and b.lo between p.lo and p.hi),
born as materialized (
    select lvl, lo, hi, 1 / w birth, lvl * 1000000 + lo node
    from (select *, count(*) over (partition by lvl, above) heirs from held) where heirs > 1),
owned as materialized (
    select h.lvl, h.lo, h.hi, max_by(b.node, b.lvl) node
    from held h join born b on b.lvl <= h.lvl and h.lo between b.lo and b.hi group by all),
stays as materialized (
    select node, place, max(lvl) last_ from owned join path on place between lo and hi group by all),
steady as materialized (
    select s.node, sum(1 / l.w - b.birth) stability
    from stays s join levels l on l.lvl = s.last_ + 1 join born b using (node) group by s.node),
tree as materialized (
    select b.node, b.lvl, b.lo, b.hi, stability, o.node above, row_number() over (order by b.lvl desc, b.lo) nth
    from born b join steady using (node)
    left join owned o on o.lvl = b.lvl - 1 and b.lo between o.lo and o.hi),
weighed as (
    select 0::bigint nth, []::struct(node bigint, above bigint, v double, kept boolean)[] found
    union all
    select t.nth, list_append(found, {
        'node': t.node, 'above': t.above, 'kept': t.stability >= parts.v or parts.n = 0,
        'v': greatest(t.stability, parts.v)})
    from (select w.found, t.nth, t.node, t.above, t.stability, {
            'n': len(list_filter(found, lambda f: f.above = t.node)),
            'v': coalesce(list_sum(list_transform(list_filter(found, lambda f: f.above = t.node), lambda f: f.v)), 0)} parts
          from weighed w join tree t on t.nth = w.nth + 1) t),
kept as materialized (
    select t.* from tree t join (select unnest(found) f from (select found from weighed order by nth desc limit 1)) on f.node = t.node
    where f.kept),
chosen as materialized (
    select * from kept k where not exists (select 1 from kept o where o.lvl < k.lvl and k.lo between o.lo and o.hi)),
named as materialized (
    select node, row_number() over (order by count(*) desc, min(id)) - 1 topic
    from chosen join path on place between lo and hi group by node)"""

TREE_WEIGHTS = f"""with recursive {POINTS}
select 'all' category, row_number() over (order by w) "rank", round(w, 6) w from path where place > 0"""

VECTOR_CLUSTERS = f"""with recursive {POINTS}, {HIERARCHY}
select 'all' category, p.id paper_id, cast(coalesce(topic, -1) as int) topic
from path p left join (chosen join named using (node)) on place between lo and hi"""

CLUSTER_SIZES = f"""with recursive {POINTS}, {HIERARCHY}
select 'all' category, cast(coalesce(topic, -1) as int) topic, count(*) papers
from path p left join (chosen join named using (node)) on place between lo and hi group by all"""
