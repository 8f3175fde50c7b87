"""Sequential rules in SQL for a second engine: recursive tables that decide a greedy choice round by round."""

from __future__ import annotations


def decided(name: str, conflicts: str) -> str:
    """Table ``name`` (k, s) of the nodes in ``conflicts`` (later, earlier): s is 1 for kept, 2 for lost.

    A node is lost if an earlier one in conflict with it is kept, and kept once all of those are lost.
    """
    return f"""{name}_nodes AS MATERIALIZED (SELECT later AS k FROM {conflicts} UNION SELECT earlier FROM {conflicts}),
{name}_state(k, s) AS (SELECT k, 0 FROM {name}_nodes
  UNION ALL SELECT k, CASE WHEN s > 0 THEN s WHEN kept > 0 THEN 2 WHEN lost = n THEN 1 ELSE 0 END FROM (
    SELECT t.k, t.s, count(c.earlier) AS n, count(*) FILTER (WHERE e.s = 1) AS kept, count(*) FILTER (WHERE e.s = 2) AS lost
    FROM {name}_state t LEFT JOIN {conflicts} c ON c.later = t.k LEFT JOIN {name}_state e ON e.k = c.earlier GROUP BY t.k, t.s)
  WHERE EXISTS (SELECT 1 FROM {name}_state WHERE s = 0)),
{name} AS MATERIALIZED (SELECT DISTINCT k, s FROM {name}_state WHERE s > 0)"""


def matching(name: str, edges: str) -> str:
    """Table ``name`` (band, a, b, d): edges taken by (d, a, b) while both ends are free."""
    return f"""{name}_e AS MATERIALIZED (SELECT band, a, b, d, row_number() OVER (ORDER BY d, a, b) AS k FROM {edges}),
{name}_c AS MATERIALIZED (SELECT l.k AS later, e.k AS earlier FROM {name}_e l JOIN {name}_e e ON e.band = l.band AND e.a = l.a AND e.k < l.k
  UNION SELECT l.k, e.k FROM {name}_e l JOIN {name}_e e ON e.band = l.band AND e.b = l.b AND e.k < l.k),
{decided(f'{name}_d', f'{name}_c')},
{name} AS MATERIALIZED (SELECT band, a, b, d FROM {name}_e WHERE k NOT IN (SELECT k FROM {name}_d WHERE s = 2))"""


def removal(name: str, edges: str) -> str:
    """Table ``name`` (id): losers of the ``edges`` (a, b, loser) that act by (a, b), where one with a removed end does nothing."""
    return f"""{name}_e AS MATERIALIZED (SELECT a, b, loser, row_number() OVER (ORDER BY a, b) AS k FROM {edges}),
{name}_c AS MATERIALIZED (SELECT l.k AS later, e.k AS earlier FROM {name}_e l JOIN {name}_e e ON e.loser = l.a AND e.k < l.k
  UNION SELECT l.k, e.k FROM {name}_e l JOIN {name}_e e ON e.loser = l.b AND e.k < l.k),
{decided(f'{name}_d', f'{name}_c')},
{name} AS MATERIALIZED (SELECT DISTINCT loser AS id FROM {name}_e WHERE k NOT IN (SELECT k FROM {name}_d WHERE s = 2))"""
