"""SQL text of the role views, written independently of the DataFrame versions."""

from __future__ import annotations

AREA = "CASE WHEN {k} % 10 < 7 THEN 'E' WHEN {k} % 10 < 9 THEN 'W' ELSE '9' END || lpad(CAST({k} AS VARCHAR), 12, '0')"


def area(key: str) -> str:
    return AREA.format(k=key)


INCIDENTS = f"""
incidents AS (
  SELECT o.o_orderkey AS incident_id, r.n_name AS reported_by,
         strftime(o.o_orderdate, '%Y-%m') AS month, strftime(o.o_orderdate, '%Y') AS year,
         o.o_orderpriority AS category,
         CASE WHEN o.o_orderkey % 97 <> 0 THEN {area("o.o_custkey")} END AS area_code,
         CASE WHEN o.o_orderkey % 97 <> 0 THEN (o.o_custkey * 37 % 500) / 10.0 END AS x,
         CASE WHEN o.o_orderkey % 97 <> 0 THEN ((o.o_custkey * 91 + 50) % 500) / 10.0 END AS y
  FROM orders o
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation r ON r.n_nationkey = CASE WHEN o.o_orderkey % 11 = 0 THEN (c.c_nationkey + 1) % 25 ELSE c.c_nationkey END
)"""

BOUNDARIES = f"""
boundaries AS (
  SELECT {area("c.c_custkey")} AS geo_code, c.c_custkey % 4 AS kind,
         n.n_name || ' ' || g.r_name || ' ' || lpad(CAST(c.c_custkey AS VARCHAR), 12, '0') AS geo_label,
         CAST(c.c_custkey % 100 * 10 AS DOUBLE) AS x0, CAST(c.c_custkey // 100 * 10 AS DOUBLE) AS y0
  FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region g ON g.r_regionkey = n.n_regionkey
)"""

LETTERS = """CASE WHEN {k} % 25 < 9 THEN 'A' WHEN {k} % 25 < 15 THEN 'B' WHEN {k} % 25 < 19 THEN 'C'
              WHEN {k} % 25 < 22 THEN 'D' WHEN {k} % 25 < 24 THEN 'E' ELSE 'F' END"""

FIXED_LABELS = f"""
area_labels AS (
  SELECT {area("c_custkey")} AS area_code, {LETTERS.format(k="c_custkey")} AS traj FROM customer
)"""

SHIPMENTS = """
shipments AS (
  SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS area_code, strftime(l_shipdate, '%Y-%m') AS month,
         strftime(l_shipdate, '%Y') AS year, l_returnflag AS category
  FROM lineitem
)"""

SHIPMENT_LABELS = f"""
shipment_labels AS (
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS area_code, {LETTERS.format(k="s_suppkey")} AS traj
  FROM supplier
)"""

TAG_NAMES = """['amenity=pub', 'amenity=nightclub', 'amenity=restaurant', 'shop=clothes', 'shop=shoes', 'shop=mall',
  'shop=department_store', 'shop=supermarket', 'shop=chemist', 'shop=cosmetics', 'shop=electrical', 'shop=greengrocer',
  'railway=station', 'highway=bus_stop', 'amenity=bicycle_parking', 'amenity=parking_space', 'amenity=parking_entrance',
  'amenity=motorcycle_parking', 'shop=convenience', 'amenity=bar']"""

POI = f"""
poi AS (
  SELECT event_id AS poi_id, split_part(tag, '=', 1) AS key, split_part(tag, '=', 2) AS value,
         CASE WHEN event_id % 7 <> 0 THEN 'poi ' || event_id END AS name, x, y,
         -5.0::DOUBLE + x / 200.0::DOUBLE AS lon, 50.0::DOUBLE + (y % 800.0::DOUBLE) / 100.0::DOUBLE AS lat
  FROM (SELECT event_id, ({TAG_NAMES})[user_id % 20 + 1] AS tag,
               CAST(event_id // 2 * 37 % 8000 AS DOUBLE) / 8.0::DOUBLE AS x,
               CAST(event_id // 2 AS DOUBLE) / 32.0::DOUBLE AS y
        FROM events)
)"""

# Counts of the analysed areas: providers and NULL areas out, zero-fill per year, then excluded areas out.
PANEL = f"""{INCIDENTS}, {BOUNDARIES},
usable AS (
  SELECT * FROM incidents WHERE reported_by NOT IN ('NATION_3', 'NATION_7') AND area_code IS NOT NULL
),
cells AS (SELECT category, month, area_code, year, count(*) AS n FROM usable GROUP BY ALL),
excluded AS (
  SELECT geo_code FROM boundaries
  WHERE regexp_matches(geo_label, 'NATION_3 |NATION_7 ') OR geo_code LIKE '9%'
),
panel AS (
  SELECT k.category, m.month, a.area_code, a.year, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT year, area_code FROM usable) a
  JOIN (SELECT DISTINCT year, category FROM usable) k ON k.year = a.year
  JOIN (SELECT DISTINCT year, month FROM usable) m ON m.year = a.year
  LEFT JOIN cells c ON c.year = a.year AND c.month = m.month AND c.category = k.category AND c.area_code = a.area_code
  WHERE a.area_code NOT IN (SELECT geo_code FROM excluded)
)"""


def using(*views: str) -> str:
    return "WITH " + ",".join(v.strip() for v in views)


# Closed-form tests of the three polygon shapes; edges and hole rims belong to the polygon.
COVERED = """p.x BETWEEN b.x0 AND b.x0 + 10 AND p.y BETWEEN b.y0 AND b.y0 + 10
    AND CASE b.kind WHEN 1 THEN (p.x - b.x0) + (p.y - b.y0) <= 10
          WHEN 2 THEN NOT (p.x > b.x0 + 3 AND p.x < b.x0 + 7 AND p.y > b.y0 + 3 AND p.y < b.y0 + 7)
          ELSE true END"""

SPATIAL = f"""{BOUNDARIES}, {POI},
layer AS (
  SELECT * FROM boundaries WHERE left(geo_code, 1) IN ('E', 'W') AND NOT regexp_matches(geo_label, 'NATION_3 |NATION_7 ')
),
tags AS (
  SELECT unnest(['pubs', 'nightclubs', 'restaurants', 'clothes_shops', 'shoe_shops', 'malls_shops', 'deps_shops',
           'supermarks_shops', 'cosmetic_shops', 'electric_shops', 'chemist_shops', 'greengrocer_shops', 'trains', 'bus',
           'bikes', 'car_spaces', 'car_parkings', 'moto_parkings', 'conveniences']) AS facility,
         unnest(['pub', 'nightclub', 'restaurant', 'clothes', 'shoes', 'mall', 'department_store', 'supermarket', 'cosmetics',
           'electrical', 'chemist', 'greengrocer', 'station', 'bus_stop', 'bicycle_parking', 'parking_space',
           'parking_entrance', 'motorcycle_parking', 'convenience']) AS value
),
countable AS (
  SELECT t.facility, p.x, p.y FROM poi p JOIN tags t ON t.value = p.value
  WHERE p.name IS NOT NULL AND t.facility NOT IN ('bikes', 'car_spaces', 'car_parkings', 'moto_parkings', 'conveniences')
  UNION ALL
  SELECT DISTINCT t.facility, p.x, p.y FROM poi p JOIN tags t ON t.value = p.value
  WHERE t.facility IN ('bikes', 'car_spaces', 'car_parkings', 'moto_parkings', 'conveniences')
),
hits AS (SELECT b.geo_code, p.facility, count(*) AS n FROM layer b JOIN countable p ON {COVERED} GROUP BY ALL),
counts AS (
  SELECT b.geo_code, b.geo_label, t.facility, coalesce(h.n, 0) AS n
  FROM layer b CROSS JOIN tags t LEFT JOIN hits h ON h.geo_code = b.geo_code AND h.facility = t.facility
)"""

FACILITY_COLUMNS = (
    "pubs nightclubs restaurants clothes_shops shoe_shops malls_shops deps_shops supermarks_shops cosmetic_shops "
    "electric_shops chemist_shops greengrocer_shops trains bus bikes car_spaces car_parkings moto_parkings conveniences"
).split()

_PIVOT = ", ".join(f"max(CASE WHEN facility = '{c}' THEN n END) AS {c}" for c in FACILITY_COLUMNS)

FACILITIES = f"""{SPATIAL},
facilities AS (
  SELECT w.*, pubs + nightclubs + restaurants AS nightlife_total,
         clothes_shops + shoe_shops + malls_shops + deps_shops + supermarks_shops + electric_shops + chemist_shops
           + greengrocer_shops + conveniences AS shops_total,
         trains + bus AS transport_total, CASE WHEN trains > 0 THEN 1 ELSE 0 END AS train_bin,
         CASE WHEN bus > 0 THEN 1 ELSE 0 END AS bus_bin
  FROM (SELECT geo_code, geo_label, {_PIVOT} FROM counts GROUP BY geo_code, geo_label) w
)"""


# To come after POI: the points of each tag with the vertices of its shapes.
EXTRACT_POINTS = """
ways AS (SELECT poi_id AS id, key, value, UNNEST([poi_id, poi_id + 1, poi_id + 2, poi_id + 3, 7]) AS node FROM poi WHERE poi_id % 10 = 1 AND poi_id % 50 <> 1),
relations AS (SELECT poi_id AS id, key, value FROM poi WHERE poi_id % 100 = 5),
handed AS (
  SELECT key, value, node FROM ways
  UNION SELECT key, value, id + 1 FROM relations
  UNION SELECT r.key, r.value, w.node FROM relations r JOIN ways w ON w.id = r.id + 6
  UNION SELECT key, value, poi_id FROM poi WHERE poi_id % 3 = 0
),
extract_points AS (
  SELECT p.poi_id, h.key, h.value, p.name, p.lon, p.lat, p.poi_id % 3 = 0 AND p.key = h.key AND p.value = h.value AS own
  FROM handed h JOIN poi p ON p.poi_id = h.node
)"""
