"""SQL twins of the order-dependent box algorithms (recursive over the box rank inside an image)."""

from __future__ import annotations


def iou_sql(a: str, b: str) -> str:
    inter = (f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
             f" * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))")
    area = lambda t: f"(greatest(0, {t}.x2 - {t}.x1) * greatest(0, {t}.y2 - {t}.y1))"
    return (f"CASE WHEN {inter} > 0 THEN CAST({inter} AS DOUBLE) / ({area(a)} + {area(b)} - {inter}) ELSE 0.0 END")


def assign_ctes(seekers: str, targets: str, t: float, order: str, seeker: str, target: str,
                keys: str = "image_id", out: str = "matched", p: str = "") -> str:
    """CTEs ending in ``out``: keys, seeker id, target (or null), best_iou.

    ``keys`` are the seeker keys; targets are shared on image_id.
    """
    ks = [k.strip() for k in keys.split(",")]
    kl = ", ".join(ks)
    on = " AND ".join(f"r.{k} = s.{k}" for k in ks)
    return f"""
{p}s AS MATERIALIZED (SELECT {kl}, {seeker} AS sid, x1, y1, x2, y2,
  row_number() OVER (PARTITION BY {kl} ORDER BY {order}) AS rn FROM {seekers}),
{p}pairs AS MATERIALIZED (SELECT {', '.join('s.' + k for k in ks)}, s.rn, g.{target} AS tid, {iou_sql('s', 'g')} AS iou
  FROM {p}s s JOIN {targets} g ON s.image_id = g.image_id
  WHERE least(s.x2, g.x2) > greatest(s.x1, g.x1) AND least(s.y2, g.y2) > greatest(s.y1, g.y1)),
{p}lists AS MATERIALIZED (SELECT {kl}, rn, list({{'tid': tid, 'iou': iou}} ORDER BY iou DESC, tid) AS c FROM {p}pairs GROUP BY {kl}, rn),
{p}steps AS MATERIALIZED (SELECT s.*, l.c FROM {p}s s LEFT JOIN {p}lists l ON {' AND '.join(f's.{k} = l.{k}' for k in ks)} AND s.rn = l.rn),
{p}rec AS (SELECT {', '.join('s.' + k for k in ks)}, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS sid, CAST([] AS BIGINT[]) AS taken,
    CAST(NULL AS BIGINT) AS target, CAST(0.0 AS DOUBLE) AS best_iou FROM {p}s s WHERE s.rn = 1
  UNION ALL
  SELECT {kl}, rn, sid, CASE WHEN b.iou >= {t} THEN list_append(taken, b.tid) ELSE taken END,
    CASE WHEN b.iou >= {t} THEN b.tid END, coalesce(b.iou, 0.0)
  FROM (SELECT {', '.join('s.' + k for k in ks)}, s.rn, s.sid, r.taken,
          list_filter(s.c, lambda e: NOT list_contains(r.taken, e.tid))[1] AS b
        FROM {p}rec r JOIN {p}steps s ON {on} AND s.rn = r.rn + 1)),
{out} AS MATERIALIZED (SELECT {kl}, sid, target, best_iou FROM {p}rec WHERE rn > 0)"""


def suppress_ctes(boxes: str, t: float, order: str, box_id: str, keys: str = "image_id", out: str = "seeded",
                  fixed: str = "FALSE", p: str = "n") -> str:
    """CTEs ending in ``out``: all box columns plus ``seed``."""
    ks = [k.strip() for k in keys.split(",")]
    kl = ", ".join(ks)
    eq = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    return f"""
{p}s AS MATERIALIZED (SELECT *, {fixed} AS is_fixed, row_number() OVER (PARTITION BY {kl} ORDER BY {order}) AS rn FROM {boxes}),
{p}edges AS MATERIALIZED (SELECT {', '.join('b.' + k for k in ks)}, b.rn, list(a.rn ORDER BY a.rn) AS c
  FROM {p}s a JOIN {p}s b ON {eq('a', 'b')} AND a.rn < b.rn
  WHERE NOT b.is_fixed AND {iou_sql('a', 'b')} >= {t} GROUP BY {', '.join('b.' + k for k in ks)}, b.rn),
{p}steps AS MATERIALIZED (SELECT {', '.join('s.' + k for k in ks)}, s.rn, coalesce(e.c, CAST([] AS BIGINT[])) AS c
  FROM {p}s s LEFT JOIN {p}edges e ON {eq('s', 'e')} AND s.rn = e.rn),
{p}rec AS (SELECT {kl}, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS hit FROM {p}s WHERE rn = 1
  UNION ALL
  SELECT {kl}, rn, CASE WHEN hit IS NULL THEN list_append(kept, rn) ELSE kept END, hit
  FROM (SELECT {', '.join('s.' + k for k in ks)}, s.rn, r.kept,
          list_filter(s.c, lambda e: list_contains(r.kept, e))[1] AS hit
        FROM {p}rec r JOIN {p}steps s ON {eq('r', 's')} AND s.rn = r.rn + 1)),
{out} AS MATERIALIZED (SELECT s.* EXCLUDE (rn, is_fixed), coalesce(k.{box_id}, s.{box_id}) AS seed
  FROM {p}s s JOIN {p}rec r ON {eq('s', 'r')} AND s.rn = r.rn
  LEFT JOIN {p}s k ON {eq('s', 'k')} AND k.rn = r.hit)"""
