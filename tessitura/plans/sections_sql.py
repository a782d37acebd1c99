"""DuckDB SQL of merging and naming sections, for the oracles of several queries."""

from __future__ import annotations

from tessitura.operators.arrangement import KICK, MIN_BARS


def merged(src: str, keys: str = "track") -> str:
    """CTEs up to ``sec`` (keys, i, start_bar, length_bars, p): sections from ``src`` (keys, bar, source, present), p a sorted list.

    Runs of equal patterns are a list, of which each turn of the recursion merges the shortest.
    """
    beside = lambda j: f"{{'d': len(runs[i].p) + len(runs[{j}].p) - 2 * len(list_intersect(runs[i].p, runs[{j}].p)), 'n': -runs[{j}].n, 'j': {j}}}"
    return f"""sp as (select {keys}, min(bar) a, max(bar) b from {src} group by all),
sg as (select {keys}, unnest(range(a, b + 1)) bar from sp),
so as (select {keys}, bar, list_sort(list(source)) p from {src} where present group by all),
sb as (select sg.*, coalesce(so.p, []) p from sg left join so using ({keys}, bar)),
sn as (select *, coalesce((p <> lag(p) over (partition by {keys} order by bar))::int, 1) new from sb),
si as (select *, sum(new) over (partition by {keys} order by bar) k from sn),
sr as (select {keys}, k, count(*)::bigint n, any_value(p) p from si group by all),
sm({keys}, runs) as (select {keys}, list({{'n': n, 'p': p}} order by k) from sr group by all
 union all
 select {keys}, case when i > 1 and i < len(runs) and runs[i - 1].p = runs[i + 1].p
   then list_concat(runs[1:i - 2], [{{'n': runs[i - 1].n + runs[i].n + runs[i + 1].n, 'p': runs[i - 1].p}}], runs[i + 2:])
   when j < i then list_concat(runs[1:j - 1], [{{'n': runs[j].n + runs[i].n, 'p': runs[j].p}}], runs[i + 1:])
   else list_concat(runs[1:i - 1], [{{'n': runs[j].n + runs[i].n, 'p': runs[j].p}}], runs[j + 1:]) end
 from (select *, case when i = 1 then 2 when i = len(runs) then i - 1 else list_min([{beside("i - 1")}, {beside("i + 1")}]).j end j
  from (select *, list_position(list_transform(runs, lambda x: x.n), list_min(list_transform(runs, lambda x: x.n)))::bigint i from sm
   where len(runs) > 1 and list_min(list_transform(runs, lambda x: x.n)) < {MIN_BARS}))),
sf as (select {keys}, runs from sm where len(runs) = 1 or list_min(list_transform(runs, lambda x: x.n)) >= {MIN_BARS}),
su as (select {keys}, unnest(range(1, len(runs) + 1)) i, runs from sf),
sec as (select sp.{keys}, i, sp.a - sp.a + coalesce(sum(runs[i].n) over (partition by sp.{keys} order by i rows between unbounded preceding and 1 preceding), 0)::bigint start_bar, runs[i].n length_bars, runs[i].p p from su join sp using ({keys}))"""


def named(keys: str = "track") -> str:
    """CTEs after ``sec`` up to ``lab`` (keys, start_bar, length_bars, p, label)."""
    return f"""sband as (select {keys}, list_sort(list_distinct(flatten(list(p)))) band from sec group by all),
sl as (select sec.*, band, len(p) = len(band) whole, count(*) over (partition by {keys}) many from sec join sband using ({keys})),
sq as (select *, coalesce(max(case when whole then i end) over (partition by {keys}), many - 1) last_whole from sl),
sx as (select *, case when len(p) = 0 then 'silence' when whole then 'all' when i = 1 then 'intro' when i > last_whole then 'outro'
  when list_contains(band, '{KICK}') and not list_contains(p, '{KICK}') and not list_contains(p, 'bass') then 'breakdown' else 'groove' end kind from sq),
lab as (select {keys}, start_bar, length_bars, p, case when kind <> 'all' then kind when lag(kind) over (partition by {keys} order by i) = 'breakdown' then 'drop' else 'full' end label from sx)"""
