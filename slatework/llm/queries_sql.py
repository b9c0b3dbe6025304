"""DuckDB SQL of the queries tagged llm that SQL can express."""

from slatework.llm.lookalike import BLANKS, INVISIBLE, LOOKALIKES, TRACES, _quoted, plainly
from slatework.plans.training_sql import METRES, USABLE

_PLAIN = f"({plainly('seen')})"
_SEEN = f"(SELECT *, regexp_replace(filename, '{INVISIBLE}', '', 'g') AS seen FROM building_metadata)"
_ALIKE = f"{_quoted(''.join(LOOKALIKES))}, {_quoted(''.join(LOOKALIKES.values()))}"
_FORM = f"trim(regexp_replace(nfc_normalize(translate({_PLAIN}, {_ALIKE})), '{BLANKS}', ' ', 'g'))"
_IMAGE = rf"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(nfc_normalize(translate(lower(nfc_normalize({_PLAIN})), {_ALIKE})), '{BLANKS}', ' ', 'g')), '^.*[/\\]', ''), '^copy of ', ''), '{TRACES}', '')"

P5_FORM = f"SELECT record_id, {_FORM} AS form FROM {_SEEN}"
P5_FOUND = f"""WITH k AS (SELECT filename, {_FORM} AS form FROM (SELECT filename, regexp_replace(filename, '{INVISIBLE}', '', 'g') AS seen FROM building_coordinates WHERE filename IS NOT NULL)), f AS (SELECT form, min(filename) AS registered FROM k GROUP BY form),
m AS (SELECT record_id, {_FORM} AS form FROM {_SEEN} WHERE filename IS NOT NULL AND filename NOT IN (SELECT filename FROM k))
SELECT record_id, registered AS filename FROM m JOIN f USING (form) WHERE form <> ''"""

_SPLIT = "lower(trim(split))"
_PARTS = f"""b AS (SELECT record_id, source, {_IMAGE} AS image, latitude, longitude, coalesce({USABLE}, false) AS usable, {_SPLIT} AS part FROM {_SEEN} WHERE {_SPLIT} IN ('train', 'val', 'holdout')),
a AS (SELECT * FROM b WHERE part <> 'train'), t AS (SELECT * FROM b WHERE part = 'train'),
pairs AS (SELECT a.record_id AS e, t.record_id AS r FROM a JOIN t ON a.image = t.image AND a.image <> ''
 UNION SELECT a.record_id, b.record_id FROM a JOIN t b ON a.usable AND b.usable AND abs(a.latitude - b.latitude) < 0.0001 AND {METRES} <= 3)"""
P4_FOUND = f"WITH {_PARTS} SELECT least(e, r) AS record_a, greatest(e, r) AS record_b FROM pairs"
P4_REPORT = f"""WITH {_PARTS}, n AS (SELECT e, count(*) AS n FROM pairs GROUP BY e)
SELECT part AS split, source, count(*) AS records, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs FROM a LEFT JOIN n ON n.e = a.record_id GROUP BY part, source"""

SQL = {"p4_found": P4_FOUND, "p4_report": P4_REPORT, "p5_form": P5_FORM, "p5_found": P5_FOUND}
