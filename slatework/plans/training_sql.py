"""DuckDB SQL of the core training-data queries: plain rules over all pairs, without cells, fits or segments."""

USABLE = "latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0)"
METRES = "2 * 6371008.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(sin((radians(b.latitude) - radians(a.latitude)) / 2) ** 2 + cos(radians(a.latitude)) * cos(radians(b.latitude)) * sin(radians(b.longitude - a.longitude) / 2) ** 2)))"
# The latitude condition only spares the trigonometry of pairs that are farther apart than it says.
NEAR = f"""loc AS (SELECT record_id, latitude, longitude FROM building_metadata WHERE {USABLE}),
near AS (SELECT a.record_id AS id_a, b.record_id AS id_b, {METRES} AS m FROM loc a JOIN loc b ON a.record_id < b.record_id AND abs(a.latitude - b.latitude) < 0.0002 AND {METRES} <= 20)"""
BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}\x{00AD}\x{034F}]"

P1_FOUND = f"""WITH {NEAR}, rings AS (SELECT region_id, unnest(regexp_extract_all(wkt, '\\(([^()]+)\\)', 1)) AS ring FROM city_regions),
r AS (SELECT region_id, list_transform(string_split(ring, ','), lambda p: struct_pack(x := split_part(trim(p), ' ', 1)::DOUBLE, y := split_part(trim(p), ' ', 2)::DOUBLE)) AS p FROM rings),
e AS (SELECT region_id, p[i].x AS x1, p[i].y AS y1, p[i + 1].x AS x2, p[i + 1].y AS y2 FROM r, unnest(range(1, len(p))) AS t(i)),
b AS (SELECT record_id, latitude AS y, longitude AS x FROM building_metadata WHERE {USABLE} AND (city IS NULL OR regexp_full_match(city, '{BLANK}*')))
SELECT 'near' AS kind, id_a, id_b FROM near
UNION ALL SELECT 'region', record_id, region_id FROM b JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY record_id, region_id HAVING count(*) % 2 = 1"""

P1_NEIGHBOURS = f"""WITH {NEAR}, both_ways AS (SELECT id_a AS id, m FROM near UNION ALL SELECT id_b, m FROM near)
SELECT record_id, count(id) AS near, round(min(m) * 100)::BIGINT AS nearest_cm FROM loc LEFT JOIN both_ways ON id = record_id GROUP BY record_id"""

STANDIN = "('', '?', '??', '???', '-', '--', 'n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'nan', 'unknown', 'unk', 'missing', 'not measured', 'not seen', 'not recorded', 'not known', 'no data', 'tbd')"
# How a row counts storeys: by its own text, else by its source.
BASIS = r"""c AS (SELECT source, valid_from, valid_until, coalesce(lower(trim(height_unit)), CASE WHEN note LIKE '%hundredths of a metre%' THEN 'cm' END) AS unit,
  CASE WHEN note LIKE '%tenths of a storey%' THEN 'tenths' WHEN note LIKE '%street height is not counted%' THEN 'above' ELSE 'storeys' END AS basis FROM source_catalog),
j AS (SELECT b.*, c.unit, c.basis, CASE WHEN regexp_matches(lower(stories_text), '^(g|r|gf) ?\+ ?[0-9]|ground floor') THEN 'above' WHEN regexp_matches(lower(stories_text), '[0-9] ?(m|metres)\b') THEN 'metres' WHEN regexp_matches(lower(stories_text), 'total') THEN 'total' END AS form
  FROM building_metadata b LEFT JOIN c ON b.source = c.source AND (c.valid_from IS NULL OR captured_at >= c.valid_from) AND (c.valid_until IS NULL OR captured_at < c.valid_until)),
g AS (SELECT *, height IS NULL OR isnan(height) OR height <= 0 AS no_height, fpArea IS NULL OR isnan(fpArea) OR fpArea <= 0 AS no_area,
  numstories IS NULL OR isnan(numstories) OR numstories < 0 OR (numstories = 0 AND NOT coalesce(form = 'above' OR (form IS NULL AND basis = 'above'), false)) AS no_stories FROM j)"""

P2_FOUND = f"""WITH {BASIS} SELECT record_id, 'height' AS field FROM g WHERE no_height UNION ALL SELECT record_id, 'numstories' FROM g WHERE no_stories UNION ALL SELECT record_id, 'fpArea' FROM g WHERE no_area
UNION ALL SELECT record_id, 'roofshape' FROM g WHERE roofshape IS NULL OR lower(regexp_replace(roofshape, '^{BLANK}+|{BLANK}+$', '', 'g')) IN {STANDIN}"""

# Units of every row and its values in metres and storeys, missing ones null.
COMMON = rf"""{BASIS}, t AS (SELECT *, replace(lower(height_text), ',', '.') AS h FROM g),
n AS (SELECT *, regexp_extract(h, '([0-9]+(\.[0-9]+)?)', 1) AS num, CASE WHEN NOT regexp_matches(coalesce(h, ''), '[0-9]') THEN NULL WHEN regexp_matches(h, '[0-9] ?(ft|feet|pies)') OR regexp_matches(h, '[''′]') THEN 'ft' WHEN regexp_matches(h, '[0-9] ?(cm|centi)') THEN 'cm' WHEN regexp_matches(h, '[0-9] ?mm') THEN 'mm' WHEN regexp_matches(h, '[0-9] ?y') THEN 'yd' ELSE 'm' END AS own FROM t),
f AS (SELECT *, CASE own WHEN 'm' THEN num::DOUBLE WHEN 'ft' THEN num::DOUBLE * 0.3048::DOUBLE + coalesce(try_cast(nullif(regexp_extract(h, '[0-9] ?(ft|''|′) ?([0-9]+)', 2), '') AS DOUBLE) * 0.0254::DOUBLE, 0) WHEN 'cm' THEN num::DOUBLE * 0.01::DOUBLE WHEN 'mm' THEN num::DOUBLE * 0.001::DOUBLE WHEN 'yd' THEN num::DOUBLE * 0.9144::DOUBLE END AS stated,
  CASE coalesce(unit, 'm') WHEN 'm' THEN height WHEN 'ft' THEN height * 0.3048::DOUBLE ELSE height * 0.01::DOUBLE END AS sourced FROM n),
common AS (SELECT *, CASE WHEN no_height THEN NULL WHEN own IS NOT NULL THEN own WHEN sourced > 115.05 AND height * 0.01 <= 115.05 THEN 'cm' WHEN sourced > 115.05 THEN 'mm' ELSE coalesce(unit, 'm') END AS used,
  CASE WHEN no_height THEN NULL WHEN own IS NOT NULL THEN stated WHEN sourced > 115.05 AND height * 0.01 <= 115.05 THEN height * 0.01::DOUBLE WHEN sourced > 115.05 THEN height * 0.001::DOUBLE ELSE sourced END AS metres,
  CASE WHEN no_stories THEN NULL WHEN form IS NULL AND (basis IS NULL OR basis = 'storeys') THEN 'total' ELSE coalesce(form, basis) END AS counted,
  CASE WHEN no_stories THEN NULL WHEN coalesce(form, basis) = 'above' THEN numstories + 1 WHEN coalesce(form, basis) = 'tenths' THEN numstories / 10 WHEN form = 'metres' THEN regexp_extract(replace(stories_text, ',', '.'), '([0-9]+(\.[0-9]+)?)', 1)::DOUBLE / 3 ELSE numstories END AS storeys FROM f)"""

P6_FOUND = f"""WITH {COMMON} SELECT record_id, 'height' AS field, round(metres * 10)::BIGINT AS value_int FROM common WHERE used <> 'm'
UNION ALL SELECT record_id, 'numstories', round(storeys)::BIGINT FROM common WHERE counted <> 'total'"""

P6_COMMON = f"""WITH {COMMON} SELECT record_id, round(metres, 3) AS height_m, used AS height_unit_used, round(storeys, 3) AS stories_total, counted AS stories_basis_used FROM common"""

SQL = {"p1_found": P1_FOUND, "p1_neighbours": P1_NEIGHBOURS, "p2_found": P2_FOUND, "p6_found": P6_FOUND, "p6_common": P6_COMMON}
