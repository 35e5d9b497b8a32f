"""The registered queries in DuckDB SQL, over the same given tables."""

from __future__ import annotations

import re

from inkveil import fixtures as X
from inkveil.operators.rules import DOCTOR_STOPS, label_pattern, value_pattern

LINES = f"lines AS ({X.BOXED_LINES})"
REQ = f"req AS ({X.REQUESTS})"
META = f"meta AS ({X.IMAGE_META})"
DOMAINS = f"domains AS ({X.DOMAIN_MAP})"
MANIFEST = f"sheet AS ({X.MANIFEST}), manifest AS (SELECT file, row_num, trim(url) AS url, image_id FROM sheet WHERE starts_with(trim(url), 'http'))"

# DuckDB's patterns of the labels, from the same words
DOCTOR = rf"{value_pattern('doctor')}(?:[：:\s\d{DOCTOR_STOPS}]|$)"
NUMBER, STAFF = value_pattern("medical_id"), value_pattern("name")
EMPTY = f"{label_pattern('empty')}$"
FORMATS = (
    ("id_card", r"(?:^|[^0-9A-Za-z])([0-9]{17}[0-9Xx]|[0-9]{15})(?:[^0-9A-Za-z]|$)"),
    ("phone", r"(?:^|[^0-9])(1[3-9][0-9]{9}|0[0-9]{2,3}-[0-9]{7,8})(?:[^0-9]|$)"),
    ("email", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"),
    ("date", r"(?:^|[^0-9])([0-9]{4}(?:-[0-9]{1,2}-[0-9]{1,2}|/[0-9]{1,2}/[0-9]{1,2}|\.[0-9]{1,2}\.[0-9]{1,2}|年[0-9]{1,2}月[0-9]{1,2}日))(?:[^0-9]|$)"),
    ("age", r"(?:^|[^0-9])([0-9]{1,3}岁)"),
)
RULES = (("doctor", DOCTOR, 1), ("medical_id", NUMBER, 0), ("name", STAFF, 0))


def values(rules, table: str = "lines") -> str:
    """CTE m: a row for each match."""
    parts = [
        f"SELECT image_id, line_index, text, x1, y1, x2, y2, {n} AS rule_no, CAST(unnest(range(len(l))) AS INT) AS match_no, '{category}' AS category, unnest(l) AS value, {miss} AS prefix_miss "
        f"FROM (SELECT *, regexp_extract_all(text, '{pattern}', 1) AS l FROM {table})"
        for n, (category, pattern, miss) in enumerate(rules)
    ]
    return "m AS (" + " UNION ALL ".join(parts) + ")"


#: CTE rule_poly over m: the polygon of an upright line's part, moved outward from its centre.
_POLY = """
v AS (SELECT *, instr(text, value) - 1 AS pos, greatest(length(text), 1) AS n, greatest(2, CAST(trunc(greatest(y2 - y1, 1) * CAST(0.15 AS DOUBLE)) AS INT)) AS pad FROM m),
w AS (SELECT *, CASE WHEN pos < 0 OR pos = 0 AND length(value) >= n THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), pos / CAST(n AS DOUBLE) - prefix_miss * (CAST(1 AS DOUBLE) / n)) END AS a,
             CASE WHEN pos < 0 OR pos = 0 AND length(value) >= n THEN CAST(1 AS DOUBLE) ELSE (pos + length(value)) / CAST(n AS DOUBLE) END AS b FROM v),
s AS (SELECT *, x1 + (x2 - x1) * a AS xa, x1 + (x2 - x1) * b AS xb FROM w),
c AS (SELECT *, (xa + xb + xb + xa) / CAST(4 AS DOUBLE) AS mx, (y1 + y1 + y2 + y2) / CAST(4 AS DOUBLE) AS my FROM s),
d AS (SELECT *, sqrt((xa - mx) * (xa - mx) + (y1 - my) * (y1 - my)) AS na, sqrt((xb - mx) * (xb - mx) + (y1 - my) * (y1 - my)) AS nb,
             sqrt((xb - mx) * (xb - mx) + (y2 - my) * (y2 - my)) AS nc, sqrt((xa - mx) * (xa - mx) + (y2 - my) * (y2 - my)) AS nd FROM c),
rule_poly AS (SELECT *,
   CAST(trunc(xa + (xa - mx) / na * pad) AS INT) AS p0, CAST(trunc(y1 + (y1 - my) / na * pad) AS INT) AS p1,
   CAST(trunc(xb + (xb - mx) / nb * pad) AS INT) AS p2, CAST(trunc(y1 + (y1 - my) / nb * pad) AS INT) AS p3,
   CAST(trunc(xb + (xb - mx) / nc * pad) AS INT) AS p4, CAST(trunc(y2 + (y2 - my) / nc * pad) AS INT) AS p5,
   CAST(trunc(xa + (xa - mx) / nd * pad) AS INT) AS p6, CAST(trunc(y2 + (y2 - my) / nd * pad) AS INT) AS p7 FROM d)
"""


def poly(table: str, prefix: str) -> str:
    """The same over another table, as CTE <prefix>rule_poly."""
    out = _POLY
    for name in ("v", "w", "s", "c", "d"):
        out = out.replace(f"\n{name} AS (", f"\n{prefix}{name} AS (").replace(f" FROM {name})", f" FROM {prefix}{name})")
    return out.replace(" FROM m)", f" FROM {table})").replace("rule_poly AS", f"{prefix}rule_poly AS")


RULE_POLY = poly("m", "")
POINTS = "p0, p1, p2, p3, p4, p5, p6, p7"
POLYGON = f"concat_ws(',', {POINTS})"
RULE_REGIONS = f"rule_regions AS (SELECT image_id, 'rule' AS source, CAST(line_index AS BIGINT) * 100000 + rule_no * 1000 + match_no AS seq, value AS text, category, {POINTS}, line_index AS ocr_line_index FROM rule_poly)"

SIGN = """
sign AS (SELECT *, length(regexp_extract(text, '^(?s:(.*?手签[：:]\\s*))', 1)) AS k, greatest(y2 - y1, 1) AS h FROM lines WHERE regexp_matches(text, '手签[：:]')),
sign_regions AS (SELECT image_id, 'rule' AS source, 1000000000000 + CAST(line_index AS BIGINT) * 100000 AS seq, '[手写签名]' AS text, 'handwritten_signature' AS category,
  CAST(trunc(x1 + (x2 - x1) * (k / CAST(length(text) AS DOUBLE))) AS INT) AS p0, CAST(trunc(y1 - h * CAST(0.5 AS DOUBLE)) AS INT) AS p1, x2 + (x2 - x1) AS p2, CAST(trunc(y1 - h * CAST(0.5 AS DOUBLE)) AS INT) AS p3,
  x2 + (x2 - x1) AS p4, CAST(trunc(y2 + h * CAST(0.5 AS DOUBLE)) AS INT) AS p5, CAST(trunc(x1 + (x2 - x1) * (k / CAST(length(text) AS DOUBLE))) AS INT) AS p6, CAST(trunc(y2 + h * CAST(0.5 AS DOUBLE)) AS INT) AS p7,
  line_index AS ocr_line_index FROM sign)
"""


def empty_labels(table: str) -> str:
    return f"""
label AS (SELECT *, greatest(y2 - y1, 1) AS h, greatest(x2 - x1, 1) AS w FROM {table} WHERE regexp_matches(text, '{EMPTY}') AND NOT regexp_matches(text, '{DOCTOR}')),
free AS (SELECT * FROM label l WHERE NOT EXISTS (SELECT 1 FROM {table} o WHERE o.image_id = l.image_id AND o.line_index <> l.line_index AND o.confidence > CAST(0.7 AS DOUBLE) AND length(trim(o.text)) >= 2
   AND (o.x1 + o.x2) / CAST(2 AS DOUBLE) BETWEEN l.x2 AND l.x2 + CAST(trunc(l.w * CAST(0.7 AS DOUBLE)) AS INT)
   AND (o.y1 + o.y2) / CAST(2 AS DOUBLE) BETWEEN l.y1 - CAST(trunc(l.h * CAST(0.3 AS DOUBLE)) AS INT) AND l.y2 + CAST(trunc(l.h * CAST(0.3 AS DOUBLE)) AS INT))),
empty_regions AS (SELECT image_id, 'rule' AS source, 2000000000000 + CAST(line_index AS BIGINT) * 100000 AS seq, '[手写姓名]' AS text, 'doctor' AS category,
  x2 AS p0, CAST(trunc(y1 - h * CAST(0.5 AS DOUBLE)) AS INT) AS p1, CAST(trunc(x2 + (x2 - x1) * CAST(0.7 AS DOUBLE)) AS INT) AS p2, CAST(trunc(y1 - h * CAST(0.5 AS DOUBLE)) AS INT) AS p3,
  CAST(trunc(x2 + (x2 - x1) * CAST(0.7 AS DOUBLE)) AS INT) AS p4, CAST(trunc(y2 + h * CAST(0.5 AS DOUBLE)) AS INT) AS p5, x2 AS p6, CAST(trunc(y2 + h * CAST(0.5 AS DOUBLE)) AS INT) AS p7, line_index AS ocr_line_index FROM free)
"""


ALL_RULES = f"{LINES}, {values(RULES)}, {RULE_POLY}, {RULE_REGIONS}, {SIGN}, {empty_labels('lines')}, all_rules AS (SELECT * FROM rule_regions UNION ALL SELECT * FROM sign_regions UNION ALL SELECT * FROM empty_regions)"
BOXES = f"{ALL_RULES}, every AS (SELECT * FROM all_rules UNION ALL SELECT image_id, 'llm', line_index, text, 'name', x1, y1, x2, y1, x2, y2, x1, y2, line_index FROM lines)"


def dedupe(table: str, prefix: str = "") -> str:
    """CTE kept: image_id, source, seq, paint_order after greedy suppression by falling area."""
    return f"""
{prefix}boxed AS (SELECT *, least(p0, p2, p4, p6) AS bx1, least(p1, p3, p5, p7) AS by1, greatest(p0, p2, p4, p6) AS bx2, greatest(p1, p3, p5, p7) AS by2,
          list_position(['llm', 'rule', 'cv', 'adj', 'face'], source) AS o FROM {table}),
{prefix}ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CAST(bx2 - bx1 AS BIGINT) * (by2 - by1) DESC, o, seq) AS r FROM {prefix}boxed),
{prefix}folded AS (SELECT image_id, list_reduce(list({{'r': r, 'source': source, 'seq': seq, 'x1': bx1, 'y1': by1, 'x2': bx2, 'y2': by2}} ORDER BY r).list_transform(lambda e: [e]),
   lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: least(k.x2, x[1].x2) > greatest(k.x1, x[1].x1) AND least(k.y2, x[1].y2) > greatest(k.y1, x[1].y1)
       AND CAST(least(k.x2, x[1].x2) - greatest(k.x1, x[1].x1) AS BIGINT) * (least(k.y2, x[1].y2) - greatest(k.y1, x[1].y1))
         / CAST(CAST(k.x2 - k.x1 AS BIGINT) * (k.y2 - k.y1) + CAST(x[1].x2 - x[1].x1 AS BIGINT) * (x[1].y2 - x[1].y1)
           - CAST(least(k.x2, x[1].x2) - greatest(k.x1, x[1].x1) AS BIGINT) * (least(k.y2, x[1].y2) - greatest(k.y1, x[1].y1)) AS DOUBLE) > 0.3)) > 0 THEN acc ELSE list_concat(acc, x) END) AS l
   FROM {prefix}ranked GROUP BY image_id),
{prefix}kept AS (SELECT image_id, e.source AS source, e.seq AS seq, CAST(i AS INT) AS paint_order FROM (SELECT image_id, unnest(l) AS e, unnest(range(1, len(l) + 1)) AS i FROM {prefix}folded))
"""


STATS = "stats AS (SELECT image_id, count(*) AS line_count, sum(length(replace(replace(text, ' ', ''), chr(10), ''))) AS char_count, substring(trim(string_agg(text, '' ORDER BY line_index)), 1, 200) AS ocr_text FROM lines {where} GROUP BY image_id)"
CHECKED = f"""{LINES}, {MANIFEST}, {STATS.format(where='')},
checked AS (SELECT m.file, m.row_num, m.url, m.image_id, CASE WHEN bad THEN 0 ELSE coalesce(line_count, 0) END AS line_count, CAST(CASE WHEN bad THEN 0 ELSE coalesce(char_count, 0) END AS BIGINT) AS char_count,
   CASE WHEN bad THEN '' ELSE coalesce(ocr_text, '') END AS ocr_text, NOT bad AND coalesce(char_count >= 5, false) AS has_text, CASE WHEN bad THEN 'download failed' END AS error
   FROM (SELECT *, image_id % 10 = 9 AS bad FROM manifest) m LEFT JOIN stats USING (image_id))"""
PARSED = f"""{REQ}, {DOMAINS}, split AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+', '') AS path FROM req),
parsed AS (SELECT s.*, coalesce(nullif(regexp_extract(host, '^(.+)\\.cos\\.([^.]+)\\.(myqcloud\\.com|tencentcos\\.cn)$', 1), ''), d.bucket) AS bucket,
   coalesce(nullif(regexp_extract(host, '^(.+)\\.cos\\.([^.]+)\\.(myqcloud\\.com|tencentcos\\.cn)$', 2), ''), d.region) AS region, url_decode(path) AS key FROM split s LEFT JOIN domains d ON s.host = d.domain)"""
SUFFIX = r"regexp_extract({0}, '[^/](\.[^./]+)/*$', 1)"


def _derived(mark: str, key: str = "key") -> str:
    ext = SUFFIX.format(key)
    return f"concat(substring({key}, 1, length({key}) - length({ext})), {mark}, {ext})"


CLEANED = """
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY item_seq) - 1 AS INT) AS k FROM ({items}) items WHERE image_id % 11 <> 0),
item AS (SELECT image_id, k AS item_seq, line_index, category,
   CASE WHEN regexp_matches(text, '^[\\x{{4e00}}-\\x{{9fff}}\\w]+[：:]$') THEN NULL WHEN regexp_matches(text, '^[\\x{{4e00}}-\\x{{9fff}}\\w]+[：:]\\s*.+$') THEN regexp_extract(text, '^[\\x{{4e00}}-\\x{{9fff}}\\w]+[：:]\\s*(.+)$', 1) ELSE text END AS text FROM numbered)
""".format(items=X.ITEMS)
LOCATED = """
tries AS (SELECT i.*, prefix_miss, substring(i.text, prefix_miss + 1) AS matched FROM item i, (SELECT unnest([0, 1, 2]) AS prefix_miss) s WHERE i.text IS NOT NULL AND (prefix_miss = 0 OR (prefix_miss < least(3, length(i.text) - 1) AND length(i.text) - prefix_miss >= 2))),
m2 AS (SELECT t.image_id, l.line_index, l.text, l.x1, l.y1, l.x2, l.y2, t.item_seq, t.matched AS value, t.category, t.prefix_miss
   FROM tries t JOIN lines l ON t.image_id = l.image_id AND contains(l.text, t.matched)
   QUALIFY row_number() OVER (PARTITION BY t.image_id, t.item_seq ORDER BY CASE WHEN t.prefix_miss = 0 AND l.line_index = t.line_index THEN 0 ELSE 1 END, t.prefix_miss, abs(l.line_index - t.line_index), l.line_index) = 1)
"""
SIGNED = """
asked AS (SELECT image_id, count(*) AS item_seq, CAST(image_id % 50 AS DOUBLE) AS a, CAST(10 AS DOUBLE) AS b, CAST(image_id % 130 AS DOUBLE) AS c, CAST(30.5 AS DOUBLE) AS d FROM numbered WHERE image_id % 4 = 0 GROUP BY image_id),
pct AS (SELECT image_id, item_seq, width, height, CASE WHEN c > 100 THEN trunc(a) ELSE trunc(a / 100.0 * width) END AS pa, CASE WHEN c > 100 THEN trunc(b) ELSE trunc(b / 100.0 * height) END AS pb,
   CASE WHEN c > 100 THEN trunc(c) ELSE trunc(c / 100.0 * width) END AS pc, CASE WHEN c > 100 THEN trunc(d) ELSE trunc(d / 100.0 * height) END AS pd FROM asked JOIN meta USING (image_id)),
cornered AS (SELECT image_id, item_seq, width, height, CAST(least(pa, pc) AS INT) AS x1, CAST(least(pb, pd) AS INT) AS y1, CAST(greatest(pa, pc) AS INT) AS x2, CAST(greatest(pb, pd) AS INT) AS y2 FROM pct),
padded AS (SELECT *, CAST(trunc(greatest(x2 - x1, y2 - y1) * CAST(0.15 AS DOUBLE)) AS INT) AS pad FROM cornered),
signed AS (SELECT image_id, item_seq, greatest(0, x1 - pad) AS x1, greatest(0, y1 - pad) AS y1, least(width, x2 + pad) AS x2, least(height, y2 + pad) AS y2 FROM padded)
"""
MODEL_REGIONS = f"""
model AS (SELECT image_id, 'llm' AS source, CAST(item_seq AS BIGINT) AS seq, value AS text, category, {POINTS}, line_index AS ocr_line_index FROM m2_rule_poly
   UNION ALL SELECT image_id, 'llm', item_seq, '[手写签名]', 'handwritten_signature', x1, y1, x2, y1, x2, y2, x1, y2, -1 FROM signed WHERE x2 > x1 AND y2 > y1)
"""
PICTURES = f"""pic AS ({X.PICTURES}), boxes AS ({X.PICTURE_BOXES}),
px AS (SELECT image_id, width, height, angle, i, (i // 3) % width AS x, (i // 3) // width AS y, i % 3 AS c, (image_id * 7 + i * 13 + (i // 5) * 31) % 256 AS v FROM (SELECT *, unnest(range(width * height * 3)) AS i FROM pic))"""
GRAY = f"""pic AS ({X.PICTURES}), area AS ({X.PICTURE_AREAS}),
px AS (SELECT image_id, i % width AS x, i // width AS y, (image_id * 7 + i * 13 + (i // 5) * 31) % 256 AS v FROM (SELECT *, unnest(range(width * height)) AS i FROM pic)),
ink AS (SELECT image_id, area_id, CAST(y AS INT) AS y, x, x - row_number() OVER (PARTITION BY image_id, area_id, y ORDER BY x) AS island FROM px JOIN area USING (image_id) WHERE v <= 140 AND x >= ax1 AND x < ax2 AND y >= ay1 AND y < ay2),
runs AS (SELECT image_id, area_id, y, CAST(min(x) AS INT) AS x1, CAST(max(x) + 1 AS INT) AS x2 FROM ink GROUP BY image_id, area_id, y, island)"""
DIGEST = "md5(string_agg(printf('%02X', CAST({v} AS BIGINT)), '' ORDER BY {i}))"
INSIDE = "b.image_id = px.image_id AND px.x BETWEEN b.x1 AND b.x2 AND px.y BETWEEN b.y1 AND b.y2"



PROFILES = """prof(profile, min_part, of_image, max_aspect, min_strokes, fill_lo, fill_hi, strict, min_w, min_h, max_part, max_width, max_bottom) AS (VALUES
 ('near_doctor', CAST(0.005 AS DOUBLE), false, 10.0, 2, CAST(0.01 AS DOUBLE), CAST(0.5 AS DOUBLE), false, 15, 8, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)),
 ('bottom_context', 0.0005, true, 12.0, 1, 0.02, 0.45, false, 20, 10, 0.7, NULL, NULL), ('bottom_strict', 0.0005, true, 12.0, 4, 0.03, 0.35, false, 30, 15, 0.3, 0.4, 0.95), ('verify', 0.003, false, 12.0, 2, 0.01, 0.45, true, 0, 0, NULL, NULL, NULL))"""
#: CTE q from strokes, runs and areas: the regions of areas with handwriting.
JUDGED = """
judged AS (SELECT * FROM areas JOIN prof USING (profile)),
kept AS (SELECT s.* FROM strokes s JOIN judged j USING (image_id, area_id) WHERE size >= CASE WHEN of_image THEN width * height ELSE (ax2 - ax1) * (ay2 - ay1) END * min_part
  AND greatest(w, h) / CAST(greatest(least(w, h), 1) AS DOUBLE) <= max_aspect AND NOT (of_image AND w > (ax2 - ax1) * CAST(0.7 AS DOUBLE) AND (y - ay1 < 3 OR y + h > ay2 - 3))),
merged AS (SELECT image_id, area_id, count(*) AS n, min(x) AS mx1, min(y) AS my1, max(x + w) AS mx2, max(y + h) AS my2 FROM kept GROUP BY ALL),
boxed AS (SELECT *, profile = 'verify' AS v, CASE WHEN profile = 'verify' THEN ax1 ELSE mx1 END AS bx1, CASE WHEN profile = 'verify' THEN ay1 ELSE my1 END AS by1, CASE WHEN profile = 'verify' THEN ax2 ELSE mx2 END AS bx2, CASE WHEN profile = 'verify' THEN ay2 ELSE my2 END AS by2
  FROM merged JOIN judged USING (image_id, area_id) WHERE n >= min_strokes),
inked AS (SELECT image_id, area_id, sum(greatest(0, least(r.x2, bx2) - greatest(r.x1, bx1))) AS ink FROM runs r JOIN boxed USING (image_id, area_id) WHERE r.y BETWEEN by1 AND by2 - 1 GROUP BY ALL),
filled AS (SELECT *, bx2 - bx1 AS bw, by2 - by1 AS bh, coalesce(ink, 0) / (CAST(bx2 - bx1 AS DOUBLE) * (by2 - by1)) AS fill FROM boxed LEFT JOIN inked USING (image_id, area_id)),
passed AS (SELECT *, CASE WHEN v THEN 0 ELSE greatest(CAST(trunc(bh * CAST(0.3 AS DOUBLE)) AS INT), 5) END AS pad FROM filled WHERE CASE WHEN strict THEN fill > fill_lo AND fill < fill_hi ELSE fill BETWEEN fill_lo AND fill_hi END AND bw >= min_w AND bh >= min_h
  AND (max_part IS NULL OR bw * bh <= (ax2 - ax1) * (ay2 - ay1) * max_part) AND (max_width IS NULL OR bw <= (ax2 - ax1) * max_width) AND (max_bottom IS NULL OR by2 - ay1 <= (ay2 - ay1) * max_bottom)),
q AS (SELECT image_id, area_id, fill, greatest(0, bx1 - pad) AS a, greatest(coalesce(limit_y, 0), by1 - pad) AS b, least(width, bx2 + pad) AS c, least(height, by2 + pad) AS d FROM passed)"""


def painted(source: str, seq: int, to: str) -> str:
    """CTEs up to `to`: the pixels of `source` after each request's box number `seq` is painted in the request's mode."""
    mirrored = lambda at, n: f"CASE WHEN abs({at}) % greatest(2 * ({n} - 1), 1) >= {n} THEN greatest(2 * ({n} - 1), 1) - abs({at}) % greatest(2 * ({n} - 1), 1) ELSE abs({at}) % greatest(2 * ({n} - 1), 1) END"
    return f"""
{to}_held AS MATERIALIZED (SELECT s.*, x - x1 AS px, y - y1 AS py, least(x2 + 1, width) - x1 AS w, least(y2 + 1, height) - y1 AS h FROM {source} s JOIN boxes b ON b.image_id = s.image_id AND b.seq = {seq} AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2),
{to}_down AS MATERIALIZED (SELECT a.request_id, a.c, a.px, a.py, a.w, sum(k.weight * b.v) AS v FROM {to}_held a JOIN kernel k ON a.mode = 'blur' JOIN {to}_held b ON b.request_id = a.request_id AND b.c = a.c AND b.px = a.px AND b.py = {mirrored('a.py + k.t - 17', 'a.h')} GROUP BY ALL),
{to}_blur AS MATERIALIZED (SELECT a.request_id, a.c, a.px, a.py, round_even(sum(k.weight * b.v), 0) AS p FROM {to}_down a JOIN kernel k ON true JOIN {to}_down b ON b.request_id = a.request_id AND b.c = a.c AND b.py = a.py AND b.px = {mirrored('a.px + k.t - 17', 'a.w')} GROUP BY ALL),
{to}_new AS (SELECT h.request_id, h.i, CAST(CASE h.mode WHEN 'white' THEN 255 WHEN 'black' THEN 0 WHEN 'gray' THEN 128 WHEN 'blur' THEN b.p WHEN 'rows' THEN CASE h.py % 2 WHEN 0 THEN 255 ELSE 0 END
   ELSE round_even(avg(v) OVER (PARTITION BY h.request_id, h.c, h.py * greatest(1, h // 15) // h, h.px * greatest(1, w // 15) // w), 0) END AS BIGINT) AS p FROM {to}_held h LEFT JOIN {to}_blur b USING (request_id, c, px, py)),
{to} AS MATERIALIZED (SELECT s.* REPLACE (coalesce(n.p, s.v) AS v) FROM {source} s LEFT JOIN {to}_new n USING (request_id, i))"""


def masked_requests(mode: str = "coalesce(mask_mode, 'white')", where: str = "mode <> 'invalid-mode'", seqs: int = 2) -> str:
    """Every request's picture after its boxes are painted in turn; the kernel has 35 weights, as no picture is large enough for more."""
    steps = ", ".join(painted(f"p{k}", k, f"p{k + 1}") for k in range(seqs))
    return f"""WITH {PICTURES.replace('px AS', 'px AS MATERIALIZED')}, req AS (SELECT * FROM (SELECT request_id, image_id, {mode} AS mode FROM ({X.MASK_REQUESTS})) WHERE {where}),
raw AS (SELECT t, exp(-((t - 17) * (t - 17)) / CAST(2 * (0.3 * ((35 - 1) * 0.5 - 1) + 0.8) * (0.3 * ((35 - 1) * 0.5 - 1) + 0.8) AS DOUBLE)) AS e FROM (SELECT unnest(range(35)) AS t)), kernel AS MATERIALIZED (SELECT t, e / sum(e) OVER () AS weight FROM raw),
p0 AS MATERIALIZED (SELECT request_id, mode, px.* FROM px JOIN req USING (image_id)), {steps}
SELECT request_id, image_id, any_value(mode) AS mask_mode, image_id IN (SELECT image_id FROM boxes WHERE seq < {seqs}) AS masked, any_value(height) AS height, any_value(width) AS width, {DIGEST.format(v='v', i='i')} AS pixels FROM p{seqs} GROUP BY request_id, image_id"""


#: Strokes don't touch, so a stroke of an area is the part of a rectangle of ink in it, and the ink of a box the sum of such parts.
DETECT_PIXELS = f"""WITH {ALL_RULES}, meta AS ({X.SCAN_META}), {CLEANED}, {LOCATED}, {poly('m2', 'm2_')}, {SIGNED},
named AS (SELECT image_id, 'llm' AS source, CAST(item_seq AS BIGINT) AS seq, value AS text, category, {POINTS}, line_index AS ocr_line_index FROM m2_rule_poly),
doc AS (SELECT r.image_id, CASE source WHEN 'llm' THEN 1 ELSE 2 END * 1000000000000000 + seq AS area_id, width, height, least(p0, p2, p4, p6) AS x1, least(p1, p3, p5, p7) AS y1, greatest(p0, p2, p4, p6) AS x2, greatest(p1, p3, p5, p7) AS y2
  FROM (SELECT * FROM named UNION ALL SELECT * FROM all_rules) r JOIN meta USING (image_id) WHERE category = 'doctor'),
near AS (SELECT image_id, area_id, width, height, greatest(0, x1 - CAST(trunc(greatest(y2 - y1, 20) * CAST(0.5 AS DOUBLE)) AS INT)) AS ax1, y2 AS ay1, least(width, x2 + CAST(trunc(greatest(y2 - y1, 20) * CAST(0.5 AS DOUBLE)) AS INT)) AS ax2, least(height, y2 + CAST(trunc(greatest(y2 - y1, 20) * CAST(2.5 AS DOUBLE)) AS INT)) AS ay2 FROM doc),
ends AS (SELECT image_id, max(y2) AS last_y, regexp_matches(string_agg(text, '' ORDER BY line_index), '签名|手签|签字|签章|盖章') AS has_context FROM lines GROUP BY image_id),
areas AS (SELECT image_id, area_id, ax1, ay1, ax2, ay2, width, height, 'near_doctor' AS profile, CAST(NULL AS INT) AS limit_y FROM near a WHERE ay2 - ay1 >= 10 AND ax2 - ax1 >= 20 AND NOT EXISTS (SELECT 1 FROM lines o
    WHERE o.image_id = a.image_id AND o.confidence > CAST(0.7 AS DOUBLE) AND length(trim(o.text)) >= 2 AND (o.x1 + o.x2) / CAST(2 AS DOUBLE) BETWEEN ax1 AND ax2 AND (o.y1 + o.y2) / CAST(2 AS DOUBLE) BETWEEN ay1 AND ay2)
  UNION ALL SELECT image_id, 0, CAST(trunc(width * CAST(0.03 AS DOUBLE)) AS INT), last_y, width - CAST(trunc(width * CAST(0.03 AS DOUBLE)) AS INT), height, width, height, CASE WHEN has_context THEN 'bottom_context' ELSE 'bottom_strict' END, last_y FROM ends JOIN meta USING (image_id) WHERE height - last_y >= height * CAST(0.08 AS DOUBLE)
  UNION ALL SELECT image_id, item_seq + 1, s.x1, s.y1, s.x2, s.y2, width, height, 'verify', NULL FROM signed s JOIN meta USING (image_id) WHERE s.x2 - s.x1 >= 10 AND s.y2 - s.y1 >= 5),
scribbles AS ({X.SCAN_INK.replace('explode(sequence(0, 6))', 'unnest(range(7))').replace('explode(sequence(0, 4))', 'unnest(range(5))')}),
runs AS (SELECT a.image_id, a.area_id, greatest(s.x, ax1) AS x1, least(s.x + s.w, ax2) AS x2, greatest(s.y, ay1) AS y1, least(s.y + s.h, ay2) AS y2 FROM scribbles s JOIN areas a USING (image_id) WHERE least(s.x + s.w, ax2) > greatest(s.x, ax1) AND least(s.y + s.h, ay2) > greatest(s.y, ay1)),
strokes AS (SELECT image_id, area_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS size FROM runs), {PROFILES},
{JUDGED.replace("sum(greatest(0, least(r.x2, bx2) - greatest(r.x1, bx1)))", "sum(greatest(0, least(r.x2, bx2) - greatest(r.x1, bx1)) * greatest(0, least(r.y2, by2) - greatest(r.y1, by1)))").replace(" WHERE r.y BETWEEN by1 AND by2 - 1", "")},
signature AS (SELECT image_id, area_id, '[手写签名]' AS text, 'handwritten_signature' AS category, a AS p0, b AS p1, c AS p2, b AS p3, c AS p4, d AS p5, a AS p6, d AS p7, -1 AS ocr_line_index FROM q),
model AS (SELECT * FROM named UNION ALL SELECT image_id, 'llm', area_id - 1, * EXCLUDE (image_id, area_id) FROM signature WHERE area_id BETWEEN 1 AND 999999999999999),
{dedupe('model', 'first_')},
face AS ({X.FACES}), g AS (SELECT face.image_id, x, y, width, height, greatest(0, x) AS x1, greatest(0, y) AS y1, least(width, x + w) AS x2, least(height, y + h) AS y2 FROM face JOIN meta USING (image_id)
  WHERE w >= greatest(16, CAST(trunc(least(width, height) * CAST(0.02 AS DOUBLE)) AS INT)) AND h >= greatest(16, CAST(trunc(least(width, height) * CAST(0.02 AS DOUBLE)) AS INT))),
fp AS (SELECT *, CAST(trunc((x2 - x1) * CAST(0.2 AS DOUBLE)) AS INT) AS pw, CAST(trunc((y2 - y1) * CAST(0.3 AS DOUBLE)) AS INT) AS ph FROM g WHERE x2 > x1 AND y2 > y1),
fq AS (SELECT image_id, CAST(x AS BIGINT) * 100000 + y AS seq, greatest(0, x1 - pw) AS a, greatest(0, y1 - ph) AS b, least(width, x2 + pw) AS c, least(height, y2 + ph) AS d FROM fp),
met AS (SELECT model.* FROM model JOIN first_kept USING (image_id, source, seq) UNION ALL SELECT * FROM all_rules
  UNION ALL SELECT image_id, 'cv', area_id, * EXCLUDE (image_id, area_id) FROM signature WHERE area_id = 0
  UNION ALL SELECT image_id, 'adj', area_id, * EXCLUDE (image_id, area_id) FROM signature s WHERE area_id >= 2000000000000000 OR area_id >= 1000000000000000 AND (image_id, area_id - 1000000000000000) IN (SELECT (image_id, seq) FROM first_kept)
  UNION ALL SELECT image_id, 'face', seq, '[人像]', 'portrait', a, b, c, b, c, d, a, d, -1 FROM fq), {dedupe('met', 'last_')}
SELECT image_id, source, seq, text, category, {POLYGON} AS polygon, ocr_line_index, paint_order FROM last_kept JOIN met USING (image_id, source, seq)"""

NO_DOMAIN = "domain <> 'cdn.example.com'"


def settled(sql: str) -> str:
    """Every common table is worked out once, whatever the planner would choose."""
    return re.sub(r"\bAS \((?=\s*SELECT)", "AS MATERIALIZED (", sql)


ORACLE: dict[str, str] = {
    "s1_manifest": f"WITH {MANIFEST} SELECT file, row_num, url, image_id FROM manifest",
    "p1_parse_object_url": f"WITH {PARSED} SELECT request_id, bucket, region, CASE WHEN bucket IS NOT NULL THEN key END AS key, CASE WHEN bucket IS NULL THEN 'unknown host' END AS url_error FROM parsed",
    "p2_build_object_url": f"WITH {PARSED} SELECT request_id, concat('https://', coalesce(f.domain, concat(p.bucket, '.cos.', p.region, '.myqcloud.com')), '/', key) AS object_url FROM parsed p LEFT JOIN (SELECT bucket, region, arg_min(domain, ordinal) AS domain FROM domains GROUP BY ALL) f ON p.bucket = f.bucket AND p.region = f.region WHERE p.bucket IS NOT NULL",
    "p3_derive_key": f"WITH {PARSED} SELECT request_id, {_derived(chr(39) + '_masked_' + chr(39) + ' || CAST(request_id + 1700000000 AS VARCHAR)')} AS masked_key, {_derived(chr(39) + '_bak_1700000000' + chr(39))} AS backup_key, {_derived(chr(39) + '_masked_vision' + chr(39))} AS local_key FROM parsed WHERE bucket IS NOT NULL AND host <> 'cdn.example.com'",
    "p4_supported_ext": f"WITH {REQ}, e AS (SELECT request_id, lower({SUFFIX.format(chr(39).join(['split_part(url, ', '?', ', 1)']))}) AS ext FROM req) SELECT request_id, ext, ext IN ('', '.jpg', '.jpeg', '.png', '.bmp', '.webp', '.tiff', '.tif') AS ext_ok FROM e",
    "p5_sniff_format": f"""WITH {REQ}, h AS (SELECT request_id, ['FFD8FFE000', '89504E470D0A1A0A0000', '424D11', '52494646AA', '49492A00', '4D4D002A', '00', '4142434445464748494A', ''][request_id % 9 + 1] AS head FROM req),
f AS (SELECT *, CASE WHEN starts_with(head, 'FFD8FF') THEN 'JPEG' WHEN starts_with(head, '89504E470D0A1A0A') THEN 'PNG' WHEN starts_with(head, '424D') THEN 'BMP' WHEN starts_with(head, '52494646') THEN 'WEBP' WHEN starts_with(head, '49492A00') OR starts_with(head, '4D4D002A') THEN 'TIFF' END AS kind FROM h)
SELECT request_id, CASE WHEN length(head) >= 4 THEN kind END AS format, CASE WHEN length(head) < 4 THEN 'empty' WHEN kind IS NULL THEN 'unknown format ' || substring(head, 1, 16) END AS format_error FROM f""",
    "p5_sniff_files": f"""WITH pic AS ({X.PICTURES}), empty AS (SELECT *, image_id % 11 = 0 AND image_id % 9 <> 0 AS none FROM pic)
SELECT concat(CAST(image_id % 10 AS VARCHAR), '/', CAST(image_id AS VARCHAR), '.bmp') AS name, CASE WHEN NOT none THEN 'BMP' END AS format, CASE WHEN none THEN 'empty' END AS format_error FROM empty
UNION ALL SELECT concat('page ', CAST(page_id AS VARCHAR)), NULL, 'unknown format ' || substring(hex(encode(html)), 1, 16) FROM pages""",
    "p6_media_type": f"""WITH {REQ}, e AS (SELECT request_id, lower({SUFFIX.format('url')}) AS ext FROM req)
SELECT request_id, CASE ext WHEN '.png' THEN 'image/png' WHEN '.bmp' THEN 'image/bmp' WHEN '.webp' THEN 'image/webp' WHEN '.tiff' THEN 'image/tiff' ELSE 'image/jpeg' END AS media_type,
CASE WHEN ext IN ('.jpg', '.jpeg', '.png', '.bmp', '.webp', '.gif', '.tiff') THEN ext WHEN request_id % 2 = 0 THEN '.png' ELSE '.jpg' END AS suffix FROM e""",
    "p7_request_defaults": f"WITH {REQ} SELECT request_id, coalesce(nullif(llm_provider, ''), 'main') AS llm_provider, coalesce(mask_mode, 'white') AS mask_mode, CASE WHEN request_id % 2 = 0 THEN 'date' ELSE 'name,id_card,phone,medical_id,doctor,email,address,hospital,portrait' END AS categories FROM req",
    "p8_mask_mode": f"WITH {REQ} SELECT request_id, mask_mode, coalesce(mask_mode IN ('black', 'gray', 'white', 'blur', 'mosaic'), false) AS mode_ok FROM req",
    "p9_error_class": f"WITH {REQ} SELECT request_id, CASE WHEN message IS NULL THEN 'ok' WHEN regexp_matches(lower(message), 'out of memory|resourceexhausted|cannot allocate|cublas_status|cudnn_status') THEN 'overload' ELSE 'error' END AS outcome FROM req",
    "p10_normalize_ocr": f"""WITH {LINES}, solid AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY line_index) - 1 AS INT) AS i, max(line_index) OVER (PARTITION BY image_id) AS last FROM lines),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY i) - 1 AS INT) AS k FROM solid WHERE o_orderkey % 6 <> 0)
SELECT image_id, k AS line_index, text, concat_ws(',', CAST(round_even(x1 + 0.5, 0) AS INT), CAST(round_even(y1 + 0.5, 0) AS INT), CAST(round_even(x2 + 0.5, 0) AS INT), CAST(round_even(y1 + 0.5, 0) AS INT), CAST(round_even(x2 + 0.5, 0) AS INT), CAST(round_even(y2 + 0.5, 0) AS INT), CAST(round_even(x1 + 0.5, 0) AS INT), CAST(round_even(y2 + 0.5, 0) AS INT)) AS polygon,
CASE WHEN line_index = last THEN CAST(0 AS DOUBLE) ELSE confidence END AS confidence FROM kept WHERE o_orderkey % 5 <> 0""",
    "p11_rescale_bbox": f"""WITH {LINES}, {META}, s AS (SELECT l.*, CASE WHEN greatest(width, height) > 960 THEN CAST(1 AS DOUBLE) / (CAST(960 AS DOUBLE) / greatest(width, height)) END AS k FROM lines l JOIN meta USING (image_id)),
t AS (SELECT image_id, line_index, CASE WHEN k IS NULL THEN x1 ELSE CAST(trunc(x1 * k) AS INT) END AS x1, CASE WHEN k IS NULL THEN y1 ELSE CAST(trunc(y1 * k) AS INT) END AS y1, CASE WHEN k IS NULL THEN x2 ELSE CAST(trunc(x2 * k) AS INT) END AS x2, CASE WHEN k IS NULL THEN y2 ELSE CAST(trunc(y2 * k) AS INT) END AS y2 FROM s)
SELECT image_id, line_index, concat_ws(',', x1, y1, x2, y1, x2, y2, x1, y2) AS polygon FROM t""",
    "p12_line_boxes": f"WITH {LINES} SELECT image_id, line_index, x1, y1, x2, y2 FROM lines",
    "p13_vision_size": f"WITH {META} SELECT image_id, CASE WHEN greatest(width, height) > 1280 THEN CAST(trunc(width * (CAST(1280 AS DOUBLE) / greatest(width, height))) AS INT) ELSE width END AS sent_width, CASE WHEN greatest(width, height) > 1280 THEN CAST(trunc(height * (CAST(1280 AS DOUBLE) / greatest(width, height))) AS INT) ELSE height END AS sent_height FROM meta",
    "p14_exif_angle": f"WITH {META} SELECT image_id, CASE exif_orientation WHEN 3 THEN 180 WHEN 6 THEN 90 WHEN 8 THEN 270 ELSE 0 END AS angle FROM meta",
    "p15_face_regions": f"""WITH {META}, f AS ({X.FACES}), g AS (SELECT f.image_id, width, height, greatest(0, x) AS x1, greatest(0, y) AS y1, least(width, x + w) AS x2, least(height, y + h) AS y2 FROM f JOIN meta USING (image_id)
  WHERE w >= greatest(16, CAST(trunc(least(width, height) * CAST(0.02 AS DOUBLE)) AS INT)) AND h >= greatest(16, CAST(trunc(least(width, height) * CAST(0.02 AS DOUBLE)) AS INT))),
p AS (SELECT *, CAST(trunc((x2 - x1) * CAST(0.2 AS DOUBLE)) AS INT) AS pw, CAST(trunc((y2 - y1) * CAST(0.3 AS DOUBLE)) AS INT) AS ph FROM g WHERE x2 > x1 AND y2 > y1),
q AS (SELECT image_id, greatest(0, x1 - pw) AS a, greatest(0, y1 - ph) AS b, least(width, x2 + pw) AS c, least(height, y2 + ph) AS d FROM p)
SELECT image_id, concat_ws(',', a, b, c, b, c, d, a, d) AS polygon, 'portrait' AS category FROM q""",
    "j1_locate_items": f"""WITH {LINES}, items AS ({X.ITEMS}), skip AS (SELECT unnest([0, 1, 2]) AS prefix_miss),
tries AS (SELECT i.*, prefix_miss, substring(i.text, prefix_miss + 1) AS matched FROM items i, skip WHERE prefix_miss = 0 OR (prefix_miss < least(3, length(i.text) - 1) AND length(i.text) - prefix_miss >= 2)),
hits AS (SELECT t.image_id, t.item_seq, t.matched, t.prefix_miss, l.line_index AS found_line, CASE WHEN t.prefix_miss = 0 AND l.line_index = t.line_index THEN 0 ELSE 1 END AS tier, abs(l.line_index - t.line_index) AS far FROM tries t JOIN lines l ON t.image_id = l.image_id AND contains(l.text, t.matched))
SELECT image_id, item_seq, matched, prefix_miss, found_line FROM hits QUALIFY row_number() OVER (PARTITION BY image_id, item_seq ORDER BY tier, prefix_miss, far, found_line) = 1""",
    "j4_signature_boxes": f"""WITH {META}, b AS (SELECT image_id, width, height, CAST(image_id * 3 % 70 AS DOUBLE) AS a, CAST(image_id * 7 % 90 AS DOUBLE) AS b, CAST(image_id * 5 % 130 AS DOUBLE) AS c, CAST(image_id * 11 % 97 AS DOUBLE) AS d FROM meta),
p AS (SELECT *, CASE WHEN c > 100 THEN a ELSE trunc(a / 100.0 * width) END AS pa, CASE WHEN c > 100 THEN b ELSE trunc(b / 100.0 * height) END AS pb, CASE WHEN c > 100 THEN c ELSE trunc(c / 100.0 * width) END AS pc, CASE WHEN c > 100 THEN d ELSE trunc(d / 100.0 * height) END AS pd FROM b),
o AS (SELECT image_id, width, height, CAST(least(pa, pc) AS INT) AS x1, CAST(least(pb, pd) AS INT) AS y1, CAST(greatest(pa, pc) AS INT) AS x2, CAST(greatest(pb, pd) AS INT) AS y2 FROM p),
q AS (SELECT *, CAST(trunc(greatest(x2 - x1, y2 - y1) * CAST(0.15 AS DOUBLE)) AS INT) AS pad FROM o),
r AS (SELECT image_id, 0 AS item_seq, greatest(0, x1 - pad) AS x1, greatest(0, y1 - pad) AS y1, least(width, x2 + pad) AS x2, least(height, y2 + pad) AS y2 FROM q) SELECT * FROM r WHERE x2 > x1 AND y2 > y1""",
    "j5_empty_labels": f"WITH {LINES}, wide AS (SELECT image_id, line_index, text, confidence, x1, y1, x2, y2 FROM lines UNION ALL SELECT image_id, line_index + 1000, '印刷', confidence, x2 + 2, y1, x2 + 8, y2 FROM lines WHERE image_id % 3 = 0), {empty_labels('wide')} SELECT image_id, source, seq, text, category, {POLYGON} AS polygon, ocr_line_index FROM empty_regions",
    "j6_search_areas": f"""WITH {LINES}, {META}, {values(RULES)}, {RULE_POLY}, {RULE_REGIONS},
d AS (SELECT r.image_id, r.seq, width, height, least(p0, p2, p4, p6) AS x1, least(p1, p3, p5, p7) AS y1, greatest(p0, p2, p4, p6) AS x2, greatest(p1, p3, p5, p7) AS y2 FROM rule_regions r JOIN meta USING (image_id) WHERE category = 'doctor'),
a AS (SELECT image_id, seq, greatest(0, x1 - CAST(trunc(greatest(y2 - y1, 20) * CAST(0.5 AS DOUBLE)) AS INT)) AS ax1, y2 AS ay1, least(width, x2 + CAST(trunc(greatest(y2 - y1, 20) * CAST(0.5 AS DOUBLE)) AS INT)) AS ax2, least(height, y2 + CAST(trunc(greatest(y2 - y1, 20) * CAST(2.5 AS DOUBLE)) AS INT)) AS ay2 FROM d)
SELECT * FROM a WHERE ay2 - ay1 >= 10 AND ax2 - ax1 >= 20 AND NOT EXISTS (SELECT 1 FROM lines o WHERE o.image_id = a.image_id AND o.confidence > CAST(0.7 AS DOUBLE) AND length(trim(o.text)) >= 2
  AND (o.x1 + o.x2) / CAST(2 AS DOUBLE) BETWEEN ax1 AND ax2 AND (o.y1 + o.y2) / CAST(2 AS DOUBLE) BETWEEN ay1 AND ay2)""".replace("\nd AS (SELECT r.", "\ndoc AS (SELECT r.").replace("FROM d)\nSELECT * FROM a", "FROM doc)\nSELECT * FROM a"),
    "j8_text_check": f"WITH {CHECKED} SELECT * FROM checked",
    "j7_rows_with_text": f"WITH {CHECKED} SELECT file, row_num, url FROM checked WHERE error IS NULL AND has_text ORDER BY file, row_num",
    "s4_report": f"WITH {CHECKED} SELECT file, row_num, url, CASE WHEN has_text THEN 'yes' ELSE 'no' END AS has_text, line_count, char_count, ocr_text, error FROM checked ORDER BY file, row_num",
    "a1_meaningful_text": f"WITH {LINES}, {META}, g AS (SELECT image_id, count(*) AS n, max(length(trim(text))) AS longest FROM lines GROUP BY image_id) SELECT meta.image_id, coalesce(n, 0) AS n_lines, coalesce(n, 0) >= 2 AND coalesce(longest, 0) >= 3 AS meaningful FROM meta LEFT JOIN g USING (image_id)",
    "a2_ocr_quality": f"""WITH {LINES}, q AS (SELECT image_id, count(*) AS total_lines, avg(length(text)) AS avg_len, count(*) FILTER (length(text) >= 4) AS long_lines, count(*) FILTER (length(trim(text)) >= 3) AS n3, count(*) FILTER (length(trim(text)) >= 3 AND y2 - y1 > 1.5 * (x2 - x1)) AS up FROM lines GROUP BY image_id),
r AS (SELECT *, total_lines >= 4 AND avg_len >= 3 AND long_lines >= 2 AS valid, n3 >= 3 AND up > n3 * 0.5 AS is_vertical FROM q) SELECT image_id, total_lines, round(avg_len, 9) AS avg_len, long_lines, valid, is_vertical, NOT valid OR is_vertical AS need_rotation FROM r""",
    "a3_page_text": f"WITH {LINES} SELECT image_id, string_agg(text, chr(10) ORDER BY line_index) AS full_text, CAST(count(*) AS INT) AS total_lines FROM lines GROUP BY image_id",
    "a4_text_statistics": f"WITH {LINES}, {STATS.format(where='')} SELECT image_id, line_count, CAST(char_count AS BIGINT) AS char_count, ocr_text, char_count >= 5 AS has_text FROM stats",
    "a5_batch_summary": f"WITH {CHECKED} SELECT file, CAST(grouping(file) AS INT) AS is_total, count(*) AS total, count(*) FILTER (error IS NULL AND has_text) AS has_text, count(*) FILTER (error IS NULL AND NOT has_text) AS no_text, count(*) FILTER (error IS NOT NULL) AS error FROM checked GROUP BY ROLLUP (file)",
    "a6_detect_result": f"""WITH {ALL_RULES}, {dedupe('all_rules')}, items AS (SELECT image_id, count(*) AS n, string_agg(concat_ws('|', text, category, concat_ws(',', bx1, by1, bx2, by2), ocr_line_index), ';' ORDER BY paint_order) AS items FROM kept JOIN boxed USING (image_id, source, seq) GROUP BY image_id),
t AS (SELECT image_id, count(*) AS total_lines FROM lines GROUP BY image_id) SELECT image_id, total_lines, CAST(coalesce(n, 0) AS INT) AS sensitive_count, coalesce(items, '') AS items FROM t LEFT JOIN items USING (image_id)""",
    "a7_process_stats": f"""WITH {ALL_RULES}, {META}, {dedupe('all_rules')}, items AS (SELECT image_id, count(*) AS n, string_agg(text, ';' ORDER BY paint_order, text) AS items FROM kept JOIN boxed USING (image_id, source, seq) GROUP BY image_id),
t AS (SELECT image_id, count(*) AS total_lines FROM lines GROUP BY image_id) SELECT meta.image_id, coalesce(total_lines, 0) AS total_lines, coalesce(n, 0) AS sensitive_count, coalesce(n, 0) AS masked_count, coalesce(items, '') AS sensitive_items FROM meta LEFT JOIN t USING (image_id) LEFT JOIN items USING (image_id)""",
    "a8_source_counts": f"""WITH {BOXES}, {dedupe('every')}, f AS (SELECT image_id, count(*) AS final FROM kept GROUP BY image_id), g AS (SELECT image_id, count(*) FILTER (source = 'llm') AS llm, count(*) FILTER (source = 'rule') AS rule, count(*) FILTER (source = 'cv') AS cv, count(*) FILTER (source = 'adj') AS adj, count(*) FILTER (source = 'face') AS face FROM every GROUP BY image_id)
SELECT g.*, coalesce(final, 0) AS final, rule + cv + adj + face AS extra FROM g LEFT JOIN f USING (image_id)""",
    "a9_dedupe_regions": f"WITH {BOXES}, {dedupe('every')} SELECT * FROM kept",
    "a9_dense_images": f"WITH b AS ({X.DENSE_BOXES}), every AS (SELECT image_id, source, seq, x1 AS p0, y1 AS p1, x2 AS p2, y1 AS p3, x2 AS p4, y2 AS p5, x1 AS p6, y2 AS p7 FROM b), {dedupe('every')} SELECT * FROM kept",
    "wb_detect": f"""WITH {ALL_RULES}, {META}, {CLEANED}, {LOCATED}, {poly('m2', 'm2_')}, {SIGNED}, {MODEL_REGIONS}, {dedupe('model', 'first_')},
met AS (SELECT model.* FROM model JOIN first_kept USING (image_id, source, seq) UNION ALL SELECT * FROM all_rules), {dedupe('met')}
SELECT image_id, source, seq, text, category, {POLYGON} AS polygon, ocr_line_index, paint_order FROM kept JOIN met USING (image_id, source, seq)""",
    "wb_detect_pixels": DETECT_PIXELS,
    "x1_mask_solid": f"""WITH {PICTURES} SELECT image_id, image_id IN (SELECT image_id FROM boxes) AS masked, any_value(height) AS height, any_value(width) AS width,
{DIGEST.format(v=f'CASE WHEN EXISTS (SELECT 1 FROM boxes b WHERE {INSIDE}) THEN 0 ELSE v END', i='i')} AS pixels FROM px GROUP BY image_id""",
    "x1_mask_requests": masked_requests(),
    "x1_reject_requests": f"SELECT request_id, image_id, mask_mode, 'unknown mask mode: ' || mask_mode AS error FROM ({X.MASK_REQUESTS}) WHERE mask_mode = 'invalid-mode'",
    "d3_registered_mode": masked_requests("'rows'", "true", 1),
    "wa_mask_batch": f"""WITH {LINES}, {PICTURES}, enough AS (SELECT image_id FROM lines GROUP BY image_id HAVING count(*) >= 2 AND max(length(trim(text))) >= 3), taken AS (SELECT boxes.* FROM boxes JOIN enough USING (image_id))
SELECT image_id, image_id IN (SELECT image_id FROM taken) AS masked, any_value(height) AS height, any_value(width) AS width, {DIGEST.format(v=f'CASE WHEN EXISTS (SELECT 1 FROM taken b WHERE {INSIDE}) THEN 255 ELSE v END', i='i')} AS pixels FROM px GROUP BY image_id""",
    "x1_mask_mosaic": f"""WITH {PICTURES}, cut AS (SELECT b.image_id, b.x1, b.y1, least(b.x2 + 1, width) - b.x1 AS w, least(b.y2 + 1, height) - b.y1 AS h FROM boxes b JOIN pic USING (image_id) WHERE seq = 0),
held AS (SELECT px.image_id, i, c, v, (y - y1) * greatest(1, h // 15) // h AS r, (x - x1) * greatest(1, w // 15) // w AS k FROM px JOIN cut USING (image_id) WHERE x >= x1 AND x < x1 + w AND y >= y1 AND y < y1 + h),
painted AS (SELECT image_id, i, round_even(avg(v) OVER (PARTITION BY image_id, c, r, k), 0) AS p FROM held)
SELECT image_id, image_id IN (SELECT image_id FROM cut) AS masked, any_value(height) AS height, any_value(width) AS width, {DIGEST.format(v='coalesce(p, v)', i='px.i')} AS pixels FROM px LEFT JOIN painted USING (image_id, i) GROUP BY image_id""",
    "x3_rotate_images": f"""WITH {PICTURES}, turned AS (SELECT *, CASE angle WHEN 90 THEN (x * height + height - 1 - y) WHEN 180 THEN (height - 1 - y) * width + width - 1 - x WHEN 270 THEN (width - 1 - x) * height + y ELSE y * width + x END * 3 + c AS spot FROM px)
SELECT image_id, any_value(CASE WHEN angle % 180 = 90 THEN width ELSE height END) AS height, any_value(CASE WHEN angle % 180 = 90 THEN height ELSE width END) AS width, {DIGEST.format(v='v', i='spot')} AS pixels FROM turned GROUP BY image_id""",
    "x4_ink_runs": f"WITH {GRAY} SELECT * FROM runs",
    "x5_strokes": f"""WITH RECURSIVE {GRAY}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x1) AS n FROM runs WHERE area_id = 0),
near AS (SELECT a.image_id, a.n AS a, b.n AS b FROM r a JOIN r b ON a.image_id = b.image_id AND abs(a.y - b.y) = 1 AND a.x1 <= b.x2 AND b.x1 <= a.x2),
reach AS (SELECT image_id, n AS a, n AS b FROM r UNION SELECT reach.image_id, reach.a, near.b FROM reach JOIN near ON reach.image_id = near.image_id AND reach.b = near.a),
label AS (SELECT image_id, a AS n, min(b) AS label FROM reach GROUP BY ALL)
SELECT image_id, 0 AS area_id, min(x1) AS x, min(y) AS y, max(x2) - min(x1) AS w, CAST(max(y) - min(y) + 1 AS INT) AS h, CAST(sum(x2 - x1) AS INT) AS size FROM r JOIN label USING (image_id, n) GROUP BY image_id, label""",
    "j9_images_with_regions": f"WITH pic AS ({X.PICTURES}), boxes AS ({X.PICTURE_BOXES}), g AS (SELECT image_id, string_agg(concat_ws(',', x1, y1, x2, y1, x2, y2, x1, y2), ';' ORDER BY seq) AS polygons FROM boxes GROUP BY image_id) SELECT image_id, polygons IS NOT NULL AS masked, coalesce(polygons, '') AS polygons FROM pic LEFT JOIN g USING (image_id)",
    "s1_read_manifest": f"WITH {MANIFEST} SELECT row_num, url, image_id FROM manifest",
    "s3_write_masked": f"""WITH {PARSED}, k AS (SELECT {_derived(chr(39) + '_masked_' + chr(39) + ' || CAST(request_id + 1700000000 AS VARCHAR)')} AS key, url AS content FROM parsed WHERE bucket IS NOT NULL AND host <> 'cdn.example.com')
SELECT key, content, CASE lower({SUFFIX.format('key')}) WHEN '.png' THEN 'image/png' WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.bmp' THEN 'image/bmp' WHEN '.webp' THEN 'image/webp' WHEN '.tiff' THEN 'image/tiff' ELSE 'application/octet-stream' END AS content_type FROM k""",
    "s1_row_numbers": f"WITH sheet AS ({X.MANIFEST}), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY row_num) + 1 AS INT) AS place FROM sheet) SELECT file AS sheet, place AS row_num, trim(url) AS url, image_id FROM n WHERE starts_with(trim(url), 'http')",
    "s2_read_images": f"""WITH {PICTURES}, bad AS (SELECT image_id FROM pic WHERE image_id % 9 = 0)
SELECT image_id, any_value(height) AS height, any_value(width) AS width, {DIGEST.format(v='v', i='i')} AS pixels, NULL AS error FROM px WHERE image_id NOT IN (FROM bad) AND image_id % 11 <> 0 GROUP BY image_id UNION ALL SELECT image_id, NULL, NULL, NULL, 'not an image' FROM bad""",
    "s3_repeated_jobs": f"""WITH {PARSED}, k AS (SELECT request_id, {_derived("'_masked_1700000000'")} AS key, url AS content FROM parsed WHERE bucket IS NOT NULL AND host <> 'cdn.example.com' AND request_id % 10 <> 0),
r AS (SELECT key, first(CASE WHEN request_id % 3 < 2 THEN content ELSE 'later' END) AS content FROM k GROUP BY key)
SELECT key, content, CASE lower({SUFFIX.format('key')}) WHEN '.png' THEN 'image/png' WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.bmp' THEN 'image/bmp' WHEN '.webp' THEN 'image/webp' WHEN '.tiff' THEN 'image/tiff' ELSE 'application/octet-stream' END AS content_type FROM r""",
    "a10_daily_latency": f"""WITH s AS (SELECT * FROM ({X.DAILY_METRICS}) WHERE day >= DATE '1995-01-01' AND day < DATE '1997-01-01'), l AS (SELECT 'orientation_ms' AS stage, orientation_ms AS ms FROM s UNION ALL SELECT 'ocr_ms', ocr_ms FROM s UNION ALL SELECT 'rotation_retry_ms', rotation_retry_ms FROM s UNION ALL SELECT 'detect_ms', detect_ms FROM s UNION ALL SELECT 'mask_ms', mask_ms FROM s)
SELECT stage, count(*) AS images, round(avg(ms), 6) AS avg_ms, round(max(ms), 6) AS max_ms, round(sum(ms) / sum(sum(ms)) OVER (), 6) AS share, true AS p50_near, true AS p95_near FROM l GROUP BY stage""",
    "p10_normalize_legacy": f"""WITH {LINES}, kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY line_index) - 1 AS INT) AS k FROM lines WHERE o_orderkey % 6 <> 0)
SELECT image_id, k AS line_index, text, concat_ws(',', CAST(round_even(x1 + 0.5, 0) AS INT), CAST(round_even(y1 + 0.5, 0) AS INT), CAST(round_even(x2 + 0.5, 0) AS INT), CAST(round_even(y1 + 0.5, 0) AS INT), CAST(round_even(x2 + 0.5, 0) AS INT), CAST(round_even(y2 + 0.5, 0) AS INT), CAST(round_even(x1 + 0.5, 0) AS INT), CAST(round_even(y2 + 0.5, 0) AS INT)) AS polygon,
CASE WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE confidence END AS confidence FROM kept""",
    "a10_stage_latency": f"""WITH s AS ({X.STAGE_METRICS}), l AS (SELECT 'orientation_ms' AS stage, orientation_ms AS ms FROM s UNION ALL SELECT 'ocr_ms', ocr_ms FROM s UNION ALL SELECT 'rotation_retry_ms', rotation_retry_ms FROM s UNION ALL SELECT 'detect_ms', detect_ms FROM s UNION ALL SELECT 'mask_ms', mask_ms FROM s)
SELECT stage, count(*) AS images, round(avg(ms), 6) AS avg_ms, round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(max(ms), 6) AS max_ms, round(sum(ms) / sum(sum(ms)) OVER (), 6) AS share FROM l WHERE ms IS NOT NULL GROUP BY stage""",
    "w2_paint_order": f"WITH {BOXES}, {dedupe('every')} SELECT image_id, source, seq, CAST(r AS INT) AS paint_order FROM ranked",
    "w3_choose_orientation": f"""WITH t AS ({X.ATTEMPTS}), q AS (SELECT image_id, attempt, angle, count(*) AS n, avg(length(text)) AS avg_len, count(*) FILTER (length(text) >= 4) AS n4, count(*) FILTER (length(trim(text)) >= 3) AS n3, count(*) FILTER (length(trim(text)) >= 3 AND y2 - y1 > 1.5 * (x2 - x1)) AS up FROM t GROUP BY ALL),
m AS (SELECT image_id, attempt, angle, n, n3 >= 3 AND up > n3 * 0.5 AS vertical, n >= 4 AND avg_len >= 3 AND n4 >= 2 AS valid FROM q),
ids AS (SELECT DISTINCT image_id FROM m),
s0 AS (SELECT i.image_id, 0 AS attempt, 0 AS angle, coalesce(n, 0) AS n, coalesce(vertical, false) AS vertical, coalesce(valid, false) AS valid, false AS stopped, coalesce(vertical, false) AS origin FROM ids i LEFT JOIN m ON m.image_id = i.image_id AND m.attempt = 0),
{', '.join(f'''b{k} AS (SELECT s.*, x.angle AS xa, x.n AS xn, x.vertical AS xv, x.valid AS xok, x.image_id IS NOT NULL AND NOT s.stopped AND ((s.vertical AND NOT x.vertical AND x.n >= 3) OR (NOT s.vertical AND NOT x.vertical AND x.n > s.n) OR (x.valid AND NOT s.valid) OR x.n > s.n * 1.5) AS use FROM s{k - 1} s LEFT JOIN m x ON x.image_id = s.image_id AND x.attempt = {k}),
s{k} AS (SELECT image_id, CASE WHEN use THEN {k} ELSE attempt END AS attempt, CASE WHEN use THEN xa ELSE angle END AS angle, CASE WHEN use THEN xn ELSE n END AS n, CASE WHEN use THEN xv ELSE vertical END AS vertical, CASE WHEN use THEN xok ELSE valid END AS valid, stopped OR (use AND NOT xv AND xok AND (NOT origin OR xa = 270)) AS stopped, origin FROM b{k})''' for k in (1, 2, 3))}
SELECT image_id, attempt, angle, n AS total_lines FROM s3""",
    "u1_union_regions": f"WITH {BOXES} SELECT image_id, source, CAST(list_position(['llm', 'rule', 'cv', 'adj', 'face'], source) AS BIGINT) AS source_ord, count(*) AS n FROM every GROUP BY ALL",
    "f1_rule_values": f"WITH {LINES}, {values(RULES)} SELECT image_id, line_index, rule_no, match_no, category, value, prefix_miss FROM m",
    "f2_value_position": f"""WITH {LINES}, v AS (SELECT *, CASE line_index % 3 WHEN 0 THEN '医生：李四审核' WHEN 1 THEN '岁条码' ELSE '：张' END AS value FROM lines),
p AS (SELECT *, instr(text, value) - 1 AS plain, instr(replace(text, ' ', ''), replace(value, ' ', '')) - 1 AS squeezed FROM v)
SELECT image_id, line_index, CAST(CASE WHEN plain >= 0 THEN plain WHEN squeezed >= 0 THEN list_filter(range(length(text)), lambda i: substring(text, i + 1, 1) <> ' ')[squeezed + 1] ELSE -1 END AS INT) AS position FROM p""",
    "f3_rule_regions": f"WITH {LINES}, {values(RULES)}, {RULE_POLY}, {RULE_REGIONS} SELECT image_id, source, seq, text, category, {POLYGON} AS polygon, ocr_line_index FROM rule_regions",
    "f4_llm_items": f"""WITH items AS ({X.ITEMS}), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY item_seq) - 1 AS INT) AS k FROM items WHERE image_id % 11 <> 0),
i AS (SELECT image_id, k AS item_seq, line_index, CASE WHEN regexp_matches(text, '^[\\x{{4e00}}-\\x{{9fff}}\\w]+[：:]$') THEN NULL WHEN regexp_matches(text, '^[\\x{{4e00}}-\\x{{9fff}}\\w]+[：:]\\s*.+$') THEN regexp_extract(text, '^[\\x{{4e00}}-\\x{{9fff}}\\w]+[：:]\\s*(.+)$', 1) ELSE text END AS text, category, false AS signature FROM n)
SELECT * FROM i WHERE text IS NOT NULL UNION ALL SELECT image_id, CAST(count(*) AS INT), NULL, NULL, 'unknown', true FROM n WHERE image_id % 4 = 0 GROUP BY image_id""",
    "f5_clean_item_text": f"WITH items AS ({X.ITEMS}) SELECT image_id, item_seq, CASE WHEN regexp_matches(text, '^[\\x{{4e00}}-\\x{{9fff}}\\w]+[：:]$') THEN NULL WHEN regexp_matches(text, '^[\\x{{4e00}}-\\x{{9fff}}\\w]+[：:]\\s*.+$') THEN regexp_extract(text, '^[\\x{{4e00}}-\\x{{9fff}}\\w]+[：:]\\s*(.+)$', 1) ELSE text END AS cleaned FROM items",
    "f6_signature_labels": f"WITH {LINES}, {SIGN} SELECT image_id, source, seq, text, category, {POLYGON} AS polygon, ocr_line_index FROM sign_regions",
    "f9_signature_context": f"WITH {LINES} SELECT image_id, regexp_matches(string_agg(text, '' ORDER BY line_index), '签名|手签|签字|签章|盖章') AS has_context FROM lines GROUP BY image_id",
    "f10_iou": f"""WITH {LINES}, b AS (SELECT image_id, line_index, x1, y1, x2, y2, x1 + 5 AS u1, y1 + line_index AS v1, x2 - 9 AS u2, y2 + 3 AS v2 FROM lines),
i AS (SELECT *, least(x2, u2) - greatest(x1, u1) AS w, least(y2, v2) - greatest(y1, v1) AS h FROM b)
SELECT image_id, line_index, round(CASE WHEN w > 0 AND h > 0 THEN CAST(w * h AS DOUBLE) / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - w * h) ELSE CAST(0 AS DOUBLE) END, 9) AS iou FROM i""",
    "f11_category_prompt": f"WITH {REQ} SELECT request_id, CASE WHEN request_id % 2 = 0 THEN concat('Find these kinds of values:', chr(10), '1. date: dates of any kind', chr(10), '2. other: other') ELSE concat('Find these kinds of values:', chr(10), '1. name: names of people other than staff', chr(10), '2. phone: telephone numbers', chr(10), 'Leave out dates.') END AS prompt FROM req",
    "f12_vision_lines": f"""WITH {LINES}, {META}, j AS (SELECT image_id, '[' || string_agg('{{"index":' || line_index || ',"text":"' || text || '"}}', ',' ORDER BY line_index) || ']' AS lines_json FROM lines GROUP BY image_id)
SELECT meta.image_id, coalesce(lines_json, '[]') AS lines_json, 'p' AS prompt, 'image/png' AS media_type, to_base64(encode(repeat(CAST(meta.image_id AS VARCHAR), 40))) AS payload FROM meta LEFT JOIN j USING (image_id)""",
    "f13_written_formats": f"WITH {LINES}, {values([(c, p, 0) for c, p in FORMATS])}, {RULE_POLY}, {RULE_REGIONS} SELECT image_id, source, seq, text, category, {POLYGON} AS polygon, ocr_line_index FROM rule_regions",
    "f13_documents": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), v AS (SELECT doc_id, 'phone' AS category, unnest(regexp_extract_all(t, '(?:^|[^0-9])(1[3-9][0-9]{9}|0[0-9]{2,3}-[0-9]{7,8})(?:[^0-9]|$)', 1)) AS value FROM l UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(t, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,})', 1)) FROM l) SELECT doc_id AS image_id, category, count(*) AS n, count(DISTINCT value) AS n_values FROM v GROUP BY ALL",
    "x6_signature_regions": f"""WITH runs AS ({X.INK_RUNS}), strokes AS ({X.STROKES}),
{PROFILES},
areas AS (SELECT DISTINCT image_id, area_id, 40 AS ax1, 90 AS ay1, 260 AS ax2, 200 AS ay2, 600 AS width, 800 AS height, CAST(NULL AS INT) AS limit_y, ['near_doctor', 'bottom_context', 'bottom_strict', 'verify'][area_id + 1] AS profile FROM strokes),
{JUDGED}
SELECT image_id, CAST(area_id AS BIGINT) AS seq, concat_ws(',', a, b, c, b, c, d, a, d) AS polygon, round(fill, 9) AS fill FROM q""",
    "x7_bottom_areas": f"WITH {LINES}, {META}, b AS (SELECT image_id, max(y2) AS last_y FROM lines GROUP BY image_id) SELECT b.image_id, CAST(trunc(width * CAST(0.03 AS DOUBLE)) AS INT) AS ax1, last_y AS ay1, width - CAST(trunc(width * CAST(0.03 AS DOUBLE)) AS INT) AS ax2, height AS ay2 FROM b JOIN meta USING (image_id) WHERE height - last_y >= height * CAST(0.08 AS DOUBLE)",
    "r1_stream_detect": f"WITH {LINES}, {values([*RULES, *[(c, p, 0) for c, p in FORMATS]])}, {RULE_POLY}, {RULE_REGIONS} SELECT image_id, source, seq, text, category, {POLYGON} AS polygon, ocr_line_index FROM rule_regions",
    "r2_stream_outcomes": f"""WITH a AS (SELECT *, time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS window_start FROM ({X.ARRIVALS})),
-- the watermark of a delivery follows the latest time of those before it
seen AS (SELECT k, date_trunc('milliseconds', max(ts)) - INTERVAL '1 day' AS mark FROM (SELECT unnest(range(7)) AS k) d JOIN a ON arrival < k GROUP BY k),
kept AS (SELECT a.* FROM a LEFT JOIN seen ON k = arrival WHERE mark IS NULL OR window_start + INTERVAL '10 minutes' > mark)
SELECT endpoint, window_start, window_start + INTERVAL '10 minutes' AS window_end, count(*) FILTER (status <> 'error') AS n_ok, count(*) FILTER (status = 'error') AS n_error, round(avg(elapsed_ms), 6) AS avg_ms
FROM kept WHERE window_start + INTERVAL '10 minutes' <= (SELECT mark FROM seen WHERE k = 6) GROUP BY ALL""",
    "r2_request_outcomes": f"WITH r AS ({X.REQUEST_LOG}) SELECT endpoint, time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') + INTERVAL '10 minutes' AS window_end, count(*) FILTER (status <> 'error') AS n_ok, count(*) FILTER (status = 'error') AS n_error, round(avg(elapsed_ms), 6) AS avg_ms FROM r GROUP BY ALL",
}


ORACLE["r1_stream_replay"] = ORACLE["r1_stream_detect"]
for _name in ("wb_detect", "wb_detect_pixels"):
    ORACLE[_name] = settled(ORACLE[_name])


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
