"""SQL that states the queries of the core independently; runs in DuckDB on the same tables."""

from kinweave.functions.address import NUMBER_OF
from kinweave.functions.cleaning import ADDRESS_TYPES, NAME_SUFFIXES


def _clean(x: str) -> str:
    for s in NAME_SUFFIXES:
        x = rf"regexp_replace({x}, '\b{s}\b', '', 'g')"
    return f"regexp_replace(trim(regexp_replace({x}, '[^A-Z ]', '', 'g')), ' +', ' ', 'g')"


def _up(c: str) -> str:
    return f"upper(trim(coalesce({c}, '')))"


LAST = "upper(trim(replace(replace(coalesce(lastname, ''), 'MC ', 'MC'), '-', ' ')))"
CLEAN_NAMES = f"SELECT row_id, {_clean(_up('firstname'))} AS first_name, {_clean(LAST)} AS last_name FROM raw_data"
SET_MISSING = f"""
WITH x AS (SELECT row_id, CASE WHEN {_up('firstname')} IN ('UNKNOWN', 'WITHHELD') THEN '' ELSE {_up('firstname')} END AS first_name,
  CASE WHEN {_up('lastname')} IN ('UNKNOWN', 'WITHHELD') THEN '' ELSE {_up('lastname')} END AS last_name FROM raw_data)
SELECT *, CAST(last_name IN ('NAME', 'GIRL') OR (first_name = 'TEST' AND last_name = 'ENTRY') OR (first_name = 'BABY' AND last_name = 'BOY') AS INT) AS drop_from_nm FROM x"""
DATE4 = r"CASE WHEN regexp_full_match(trim(birthdate), '\d{1,2}/\d{1,2}/\d{4}') THEN coalesce(strftime(try_strptime(trim(birthdate), '%m/%d/%Y'), '%Y-%m-%d'), '') ELSE '' END"
CHECKS = f"SELECT row_id, {DATE4} AS dob, coalesce(CAST(age_2021 AS VARCHAR), '') AS age, CASE WHEN gender IN ('m', 'f') THEN gender ELSE '' END AS gender FROM raw_data"
TWO_FIGURE_YEARS = r"""
WITH x AS (SELECT row_id, regexp_extract(trim(birthdate), '^(\d{1,2})/(\d{1,2})/(\d{2})$', ['m', 'd', 'y']) AS p FROM raw_data)
SELECT row_id, CASE WHEN coalesce(p.m, '') = '' THEN '' ELSE coalesce(strftime(try_strptime(p.m || '/' || p.d || '/' || CASE WHEN try_cast(p.y AS INT) >= 69 THEN '19' ELSE '20' END || p.y, '%m/%d/%Y'), '%Y-%m-%d'), '') END AS dob FROM x"""
GEO = "SELECT row_id, CASE WHEN contains(latlon, ',') THEN latlon ELSE '' END AS geo, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lat || ',' || lon ELSE '' END AS geo_pair FROM raw_data"
_NUMBERS = "MAP {" + ", ".join(f"'{w.lower()}': '{n}'" for w, n in NUMBER_OF.items()) + "}"
_TYPES = "MAP {" + ", ".join(f"'{s}': '{t}'" for s, t in {**ADDRESS_TYPES, **{t: t for t in ADDRESS_TYPES.values()}}.items()) + "}"
ADDRESSES = rf"""
WITH a AS (SELECT row_id, trim(regexp_replace(trim(regexp_replace(lower(trim(coalesce(address, ''))), '[.,#]+', ' ', 'g')), '\s+', ' ', 'g')) AS a FROM raw_data),
b AS (SELECT row_id, string_split(CASE WHEN a IN ('redacted', 'redact') THEN '' ELSE a END, ' ') AS w FROM a),
c AS (SELECT row_id, w, coalesce({_NUMBERS}[w[1]], regexp_extract(w[1], '^(\d+)[a-z]?$', 1)) AS number FROM b),
d AS (SELECT row_id, number, CASE WHEN number <> '' THEN w[2:] ELSE w END AS r FROM c),
e AS (SELECT row_id, number, r, CASE WHEN len(r) > 1 THEN coalesce({_TYPES}[r[-1]], '') ELSE '' END AS type FROM d)
SELECT row_id, number, array_to_string(CASE WHEN type <> '' THEN r[:-2] ELSE r END, ' ') AS name, type FROM e"""
KEYS = r"""
WITH b AS (SELECT DISTINCT record_id, coalesce(first_name, '') || '::' || coalesce(last_name, '') || '::' || coalesce(dob, '') AS blockstring FROM an)
SELECT *, regexp_replace(blockstring, '::[A-Z0-9\-]*$', '') AS nn_string, regexp_replace(blockstring, '[A-Z ]*::[A-Z ]*::', '', 'g') AS ed_string FROM b"""
STACKED = f"""
WITH x AS (SELECT 'intake__' || row_id AS record_id, 'new' AS file_type, 'intake' AS dataset, {_clean(_up('firstname'))} AS first_name, {_clean(LAST)} AS last_name, {DATE4} AS dob,
  upper(trim(CASE WHEN gender = 'u' THEN '' ELSE coalesce(gender, '') END)) AS gender, coalesce(CAST(age_2021 AS VARCHAR), '') AS age, coalesce(firstname, '') AS tmp_raw__first_name FROM raw_data)
SELECT record_id, file_type, dataset, first_name, last_name, dob, gender, age, CAST(last_name = 'NAME' OR (first_name IN ('JOHN', 'JANE') AND last_name = 'DOE') AS INT) AS drop_from_nm,
  first_name || '::' || last_name || '::' || dob AS blockstring, tmp_raw__first_name FROM x"""

PEOPLE = "people AS (SELECT DISTINCT record_id, coalesce(blockstring, '') AS blockstring, drop_from_nm, coalesce(file_type, '') AS file_type, coalesce(CAST(uid AS VARCHAR), '') AS uid FROM an)"
ORDERED = "(a.blockstring < b.blockstring OR (a.blockstring = b.blockstring AND a.record_id < b.record_id))"
SIDES = "a.record_id AS record_id_1, b.record_id AS record_id_2, a.blockstring AS blockstring_1, b.blockstring AS blockstring_2, a.drop_from_nm AS drop_from_nm_1, b.drop_from_nm AS drop_from_nm_2"
LINKS = f"links AS (SELECT {SIDES}, a.file_type AS f1, b.file_type AS f2 FROM people a JOIN people b ON a.uid = b.uid AND a.uid <> '' AND {ORDERED})"
MUST_LINKS = f"WITH {PEOPLE}, {LINKS} SELECT * EXCLUDE (f1, f2) FROM links"
MUST_LINKS_INCREMENTAL = f"WITH {PEOPLE}, {LINKS} SELECT * EXCLUDE (f1, f2) FROM links WHERE f1 = 'new' OR f2 = 'new'"
MUST_LINKS_TWO = rf"""
WITH p AS (SELECT DISTINCT record_id, coalesce(blockstring, '') AS blockstring, coalesce(CAST(uid AS VARCHAR), '') AS uid,
  CASE WHEN address_street_number IS NOT NULL AND regexp_matches(blockstring, '\d$') THEN blockstring || '|' || address_street_number ELSE '' END AS key2 FROM an)
SELECT DISTINCT a.record_id AS record_id_1, b.record_id AS record_id_2 FROM p a JOIN p b ON a.uid = b.uid AND a.uid <> '' AND {ORDERED}
UNION SELECT DISTINCT a.record_id, b.record_id FROM p a JOIN p b ON a.key2 = b.key2 AND a.key2 <> '' AND {ORDERED}"""

CLOSE = """one AS (SELECT record_id, max(first_name) AS first_name, max(last_name) AS last_name, max(dob) AS dob, max(gender) AS gender, max(age) AS age, max(uid) AS uid, max(address_street_number) AS num
  FROM an WHERE drop_from_nm = 0 AND address_street_number IS NOT NULL AND last_name <> '' GROUP BY record_id),
close AS (SELECT a.record_id AS record_id_1, b.record_id AS record_id_2, coalesce(a.first_name, '') AS fn1, coalesce(b.first_name, '') AS fn2, a.last_name AS ln1, b.last_name AS ln2, coalesce(a.dob, '') AS d1, coalesce(b.dob, '') AS d2,
  coalesce(a.gender, '') AS g1, coalesce(b.gender, '') AS g2, a.age AS a1, b.age AS a2, coalesce(CAST(a.uid AS VARCHAR), '') AS u1, coalesce(CAST(b.uid AS VARCHAR), '') AS u2
  FROM one a JOIN one b ON a.last_name = b.last_name AND a.num = b.num AND a.record_id < b.record_id)"""
LABELS = f"""
WITH {CLOSE}, f AS (SELECT *, u1 <> '' AND u2 <> '' AS ku, d1 <> '' AND d2 <> '' AS kd FROM close)
SELECT record_id_1, record_id_2, CASE WHEN NOT ku THEN '' WHEN u1 = u2 THEN '1' ELSE '0' END AS label,
  CASE WHEN NOT ku THEN '' WHEN u1 = u2 THEN '1' WHEN levenshtein(u1, u2) <= 1 THEN '' ELSE '0' END AS label_leven,
  CASE WHEN ((ku AND u1 = u2) OR (kd AND d1 = d2)) AND NOT ((ku AND u1 <> u2) OR (kd AND d1 <> d2)) THEN '1' WHEN ((ku AND u1 <> u2) OR (kd AND d1 <> d2)) AND NOT ((ku AND u1 = u2) OR (kd AND d1 = d2)) THEN '0' ELSE '' END AS label_two FROM f"""

NAMES = """names AS (SELECT record_id, coalesce(file_type, '') AS file_type, coalesce(first_name, '') AS first, coalesce(last_name, '') AS last, coalesce(first_name, '') || '::' || coalesce(last_name, '') AS nn_string,
  coalesce(dob, '') AS ed_string, CAST(age AS DOUBLE) AS absval FROM an WHERE drop_from_nm = 0)"""
SPLIT = r"""split AS (SELECT record_id, file_type, first, x.last AS last, ed_string, absval, nn_string AS nn_string_full, first || '::' || x.last AS nn_string FROM names n,
  unnest(CASE WHEN regexp_matches(n.last, '^.* \S+$') THEN list_distinct([n.last, regexp_extract(n.last, '^(.*) (\S+)$', 1), regexp_extract(n.last, '^(.*) (\S+)$', 2)]) ELSE [n.last] END) AS x(last))"""
EXPANDED = "expanded AS (SELECT DISTINCT nn_string, nn_string_full, ed_string, absval FROM split)"
COUNTS = "counts AS (SELECT nn_string, count(*) FILTER (file_type = 'new') AS n_new, count(*) FILTER (file_type = 'existing') AS n_existing, count(*) FILTER (file_type IN ('new', 'existing')) AS n_total FROM split GROUP BY nn_string)"
PENALTY = """cnt AS (SELECT last, count(*) AS n FROM names GROUP BY last), freq AS (SELECT last, n / (SELECT sum(n) FROM cnt) AS f FROM cnt),
edges AS (SELECT list_distinct(quantile_cont(f, [i / 1000.0 for i in range(1001)])) AS e FROM freq),
binned AS (SELECT last, greatest(len([x for x in e if x < f]), 1) AS bin FROM freq, edges),
levels AS (SELECT bin, row_number() OVER (ORDER BY bin DESC) AS r, count(*) OVER () AS k FROM (SELECT DISTINCT bin FROM binned)),
penalties AS (SELECT last, CASE WHEN k = 1 THEN 0.1 ELSE 0.1 * (1 - (r - 1) / (k - 1)) END AS penalty FROM binned JOIN levels USING (bin))"""
INFO = "info AS (SELECT nn_string, coalesce(penalty, 0.1) AS commonness_penalty, n_new, n_existing, n_total FROM (SELECT nn_string, any_value(last) AS last FROM split GROUP BY nn_string) JOIN counts USING (nn_string) LEFT JOIN penalties USING (last))"
SPLIT_NAMES = f"WITH {NAMES}, {SPLIT}, {EXPANDED} SELECT * FROM expanded"
NAME_COUNTS = f"WITH {NAMES}, {SPLIT}, {COUNTS} SELECT * FROM counts"
PENALTIES = f"WITH {NAMES}, {PENALTY} SELECT last, round(penalty, 9) AS penalty FROM penalties"
NAME_INFO = f"WITH {NAMES}, {SPLIT}, {COUNTS}, {PENALTY}, {INFO} SELECT nn_string, round(commonness_penalty, 9) AS commonness_penalty, n_new, n_existing, n_total FROM info"


def _shingles(source: str) -> str:
    """CTEs from distinct names in ``source``(nn_string) to unit vectors ``vec``(nn_string, shingle, x) and weights ``sh``."""
    part = "(SELECT nn_string, {n} AS part, '*' || split_part(nn_string, '::', {n}) || '*' AS s FROM " + source + ")"
    return f"""parts AS (SELECT * FROM {part.format(n=1)} UNION ALL SELECT * FROM {part.format(n=2)}),
grams AS (SELECT nn_string, part, substr(s, i, 2) AS g FROM parts, unnest(range(1, length(s))) AS r(i)),
valid AS (SELECT *, count(*) OVER (PARTITION BY nn_string, part) AS total FROM grams WHERE regexp_full_match(g, '[A-Z *]{{2}}') AND g NOT IN ('  ', '* ', ' *')),
sh AS (SELECT nn_string, g AS shingle, sum(CASE part WHEN 1 THEN 1.0 ELSE 1.4 END / pow(total, 0.1)) AS w FROM valid GROUP BY nn_string, g),
vec AS (SELECT nn_string, shingle, w / sqrt(sum(w * w) OVER (PARTITION BY nn_string)) AS x FROM sh)"""


VECTORS = f"{NAMES}, {SPLIT}, src AS (SELECT DISTINCT nn_string FROM split), {_shingles('src')}"
SHINGLES = f"WITH {VECTORS} SELECT nn_string, shingle, round(w, 9) AS w FROM sh"
SIM = """sim AS (SELECT a.nn_string AS nn_string_1, b.nn_string AS nn_string_2, 1 - sum(a.x * b.x) AS cos_dist FROM vec a JOIN vec b ON a.shingle = b.shingle AND a.nn_string || '::' < b.nn_string || '::'
  GROUP BY 1, 2 HAVING 1 - sum(a.x * b.x) <= {bar} + 1e-9)"""
SIMILAR = f"WITH {VECTORS}, {SIM.format(bar=0.4)} SELECT nn_string_1, nn_string_2, abs(round(cos_dist, 6)) AS cos_dist FROM sim"
NEAR = """near AS (SELECT nn_string_1, nn_string_2, min(cos_dist) AS cos_dist, coalesce(max(commonness_penalty_1), 0.1) AS commonness_penalty_1, coalesce(max(commonness_penalty_2), 0.1) AS commonness_penalty_2
  FROM near_neighbors_df WHERE nn_string_1 IS NOT NULL AND nn_string_2 IS NOT NULL AND cos_dist IS NOT NULL GROUP BY ALL)"""
COSINES = f"""
WITH {NEAR}, src AS (SELECT nn_string_1 AS nn_string FROM near UNION SELECT nn_string_2 FROM near), {_shingles('src')},
dots AS (SELECT n.nn_string_1, n.nn_string_2, sum(a.x * b.x) AS dot FROM near n JOIN vec a ON a.nn_string = n.nn_string_1 JOIN vec b ON b.nn_string = n.nn_string_2 AND a.shingle = b.shingle GROUP BY 1, 2)
SELECT nn_string_1, nn_string_2, abs(round(1 - coalesce(dot, 0), 6)) AS cos_dist FROM near LEFT JOIN dots USING (nn_string_1, nn_string_2)"""
NEAREST = f"WITH {NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY nn_string_1 ORDER BY cos_dist, nn_string_2) AS rank FROM near) SELECT nn_string_1, nn_string_2, cos_dist, rank FROM r WHERE rank <= 500"
ONE_DIRECTION = f"WITH {NEAR} SELECT nn_string_1, nn_string_2 FROM near WHERE nn_string_1 || '::' < nn_string_2 || '::'"
TALLIES = "tallies AS (SELECT nn_string, coalesce(max(commonness_penalty), 0.1) AS commonness_penalty, sum(n_new) AS n_new, sum(n_existing) AS n_existing, sum(n_total) AS n_total FROM nn_string_info WHERE nn_string IS NOT NULL GROUP BY nn_string)"
ONE_DIRECTION_INCREMENTAL = f"""WITH {NEAR}, {TALLIES} SELECT nn_string_1, nn_string_2 FROM near WHERE nn_string_1 || '::' < nn_string_2 || '::'
  OR (nn_string_1 || '::' > nn_string_2 || '::' AND nn_string_2 NOT IN (SELECT nn_string FROM tallies WHERE n_new > 0))"""
EXACT_NAMES = f"WITH {TALLIES} SELECT nn_string AS nn_string_1, nn_string AS nn_string_2, 0.0 AS cos_dist, commonness_penalty AS commonness_penalty_1 FROM tallies WHERE n_total > 1"


def _filtered(source: str, name: str, high: float, low: float, nodob: float, absval: int, same: bool = False) -> str:
    """CTE ``name``: blockstring pairs of name pairs in ``source`` that pass a bar."""
    where = "WHERE a.ed_string <= b.ed_string" if same else ""
    return f"""{name}_x AS (SELECT a.nn_string_full AS n1, b.nn_string_full AS n2, a.ed_string AS e1, b.ed_string AS e2, s.cos_dist, (s.commonness_penalty_1 + s.commonness_penalty_2) / 2 AS p, min(abs(a.absval - b.absval)) AS ad
  FROM {source} s JOIN expanded a ON a.nn_string = s.nn_string_1 JOIN expanded b ON b.nn_string = s.nn_string_2 {where} GROUP BY ALL),
{name}_y AS (SELECT *, CASE WHEN e1 = '' OR e2 = '' THEN -1 ELSE levenshtein(e1, e2) END AS ed FROM {name}_x),
{name} AS (SELECT CASE WHEN n1 || '::' <= n2 || '::' THEN n1 || '::' || e1 ELSE n2 || '::' || e2 END AS blockstring_1, CASE WHEN n1 || '::' <= n2 || '::' THEN n2 || '::' || e2 ELSE n1 || '::' || e1 END AS blockstring_2,
  min(cos_dist) AS cos_dist, min(ed) AS edit_dist FROM {name}_y
  WHERE (cos_dist <= {high} - p + 1e-9 AND ed BETWEEN 0 AND 2) OR (cos_dist <= {low} - p + 1e-9 AND ed BETWEEN 0 AND 1) OR (cos_dist <= {nodob} - p + 1e-9 AND ed = -1 AND (ad IS NULL OR ad <= {absval})) GROUP BY 1, 2)"""


FILTERED = f"""
WITH {NAMES}, {SPLIT}, {EXPANDED}, {NEAR}, one AS (SELECT * FROM near WHERE nn_string_1 || '::' < nn_string_2 || '::'), {_filtered('one', 'kept', 0.3, 0.4, 0.26, 3)}
SELECT blockstring_1, blockstring_2, round(cos_dist, 9) AS cos_dist, edit_dist, 1 AS covered_pair FROM kept"""
CANDIDATES = f"""
WITH {NAMES}, {SPLIT}, {EXPANDED}, {COUNTS}, {PENALTY}, {INFO}, {_shingles('info')}, {SIM.format(bar=0.4)},
ways AS (SELECT nn_string_1 AS x, nn_string_2 AS y, cos_dist FROM sim UNION ALL SELECT nn_string_2, nn_string_1, cos_dist FROM sim),
best AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY round(cos_dist, 9), y) AS rank FROM ways),
near AS (SELECT s.*, i.commonness_penalty AS commonness_penalty_1, j.commonness_penalty AS commonness_penalty_2 FROM sim s JOIN info i ON i.nn_string = s.nn_string_1 JOIN info j ON j.nn_string = s.nn_string_2
  WHERE (nn_string_1, nn_string_2) IN (SELECT (x, y) FROM best WHERE rank <= 500) OR (nn_string_2, nn_string_1) IN (SELECT (x, y) FROM best WHERE rank <= 500)),
same AS (SELECT nn_string AS nn_string_1, nn_string AS nn_string_2, 0.0 AS cos_dist, commonness_penalty AS commonness_penalty_1, commonness_penalty AS commonness_penalty_2 FROM info WHERE n_total > 1),
{_filtered('near', 'far', 0.3, 0.4, 0.26, 3)}, {_filtered('same', 'equal', 0.3, 0.4, 0.26, 3, True)}
SELECT blockstring_1, blockstring_2, abs(round(min(cos_dist), 6)) AS cos_dist, min(edit_dist) AS edit_dist FROM (SELECT * FROM far UNION ALL SELECT * FROM equal) GROUP BY 1, 2"""
TRUE = f"{PEOPLE}, {LINKS}, tp AS (SELECT DISTINCT blockstring_1, blockstring_2 FROM links WHERE drop_from_nm_1 = 0 AND drop_from_nm_2 = 0)"
TRUE_PAIRS = f"WITH {TRUE} SELECT * FROM tp"
STORED = r"""k AS (SELECT DISTINCT blockstring, regexp_extract(blockstring, '::(.*)$', 1) AS k FROM people WHERE drop_from_nm = 0 AND regexp_matches(blockstring, '\d$')),
cp AS (SELECT a.blockstring AS blockstring_1, b.blockstring AS blockstring_2 FROM k a JOIN k b USING (k) WHERE a.blockstring <= b.blockstring)"""
PARTS = r"regexp_replace({c}, '::[A-Z0-9\-]*$', '')"
UNCOVERED = rf"""
WITH {TRUE}, {STORED}, miss AS (SELECT *, {PARTS.format(c='blockstring_1')} AS n1, {PARTS.format(c='blockstring_2')} AS n2 FROM (SELECT * FROM tp WHERE blockstring_1 <> blockstring_2 EXCEPT SELECT * FROM cp)),
src AS (SELECT n1 AS nn_string FROM miss UNION SELECT n2 FROM miss), {_shingles('src')},
pairs AS (SELECT DISTINCT n1, n2 FROM miss), dots AS (SELECT p.n1, p.n2, sum(a.x * b.x) AS dot FROM pairs p JOIN vec a ON a.nn_string = p.n1 JOIN vec b ON b.nn_string = p.n2 AND a.shingle = b.shingle GROUP BY 1, 2)
SELECT blockstring_1, blockstring_2, abs(round(1 - coalesce(dot, 0), 6)) AS cos_dist,
  levenshtein(regexp_replace(blockstring_1, '[A-Z ]*::[A-Z ]*::', '', 'g'), regexp_replace(blockstring_2, '[A-Z ]*::[A-Z ]*::', '', 'g')) AS edit_dist, 0 AS covered_pair FROM miss LEFT JOIN dots USING (n1, n2)"""
COMPLETENESS = rf"""
WITH {TRUE}, {STORED}, t AS (SELECT *, {PARTS.format(c='blockstring_1')} AS n1, {PARTS.format(c='blockstring_2')} AS n2, (blockstring_1, blockstring_2) IN (SELECT (blockstring_1, blockstring_2) FROM cp) AS hit FROM tp),
cn AS (SELECT DISTINCT {PARTS.format(c='blockstring_1')} AS n1, {PARTS.format(c='blockstring_2')} AS n2, TRUE AS hn FROM cp),
x AS (SELECT t.*, hn FROM t LEFT JOIN cn USING (n1, n2)),
g AS (SELECT count(*) AS n, count(*) FILTER (blockstring_1 <> blockstring_2) AS neq, count(*) FILTER (blockstring_1 <> blockstring_2 AND NOT hit) AS miss, count(DISTINCT n1 || ' ' || n2) AS nn,
  count(DISTINCT n1 || ' ' || n2) FILTER (n1 <> n2) AS nn_neq, count(DISTINCT n1 || ' ' || n2) FILTER (hn IS NULL) AS nn_miss FROM x)
SELECT round_even(1 - nn_miss / nn, 3) AS pc_eq_cos, round_even(1 - miss / n, 3) AS pc_eq_cosed, round_even(1 - nn_miss / nn_neq, 3) AS pc_neq_cos, round_even(1 - miss / neq, 3) AS pc_neq_cosed, n AS n_true_pairs, miss AS n_uncovered FROM g"""

WHOLE = "whole AS (SELECT '*' || replace(coalesce(first_name, ''), ' ', '') || ' ' || replace(coalesce(last_name, ''), ' ', '') || '*' AS name FROM (SELECT DISTINCT record_id, first_name, last_name FROM an WHERE drop_from_nm = 0))"
PERCENTILES = f"WITH {WHOLE}, c AS (SELECT name, count(*) AS n FROM whole GROUP BY name) SELECT name, round_even(rank() OVER (ORDER BY n) / count(*) OVER (), 2) AS pctl FROM c"
GRAMS = """g AS (SELECT substr(name, i, 5) AS gram FROM whole, unnest(range(1, length(name) - 3)) AS r(i) WHERE length(name) >= 5
  UNION ALL SELECT substr(name, i, 4) FROM whole, unnest(range(1, length(name) - 3)) AS r(i) WHERE length(name) >= 5
  UNION ALL SELECT right(name, 4) FROM whole WHERE length(name) >= 5), gc AS (SELECT gram, count(*) AS n FROM g GROUP BY gram)"""
NGRAMS = f"WITH {WHOLE}, {GRAMS} SELECT gram, n FROM gc"
NAME_PROBS = f"""
WITH {WHOLE}, {GRAMS}, d AS (SELECT DISTINCT name FROM whole), s AS (SELECT name, substr(name, i, 5) AS f, substr(name, i, 4) AS h FROM d, unnest(range(1, length(name) - 3)) AS r(i) WHERE length(name) >= 5),
p AS (SELECT name, exp(sum(ln((coalesce(a.n, 0) + 0.001) / (coalesce(b.n, 0) + 0.001)))) AS prob FROM s LEFT JOIN gc a ON a.gram = s.f LEFT JOIN gc b ON b.gram = s.h GROUP BY name),
q AS (SELECT name, coalesce(prob, 0.0) AS prob FROM d LEFT JOIN p USING (name))
SELECT name, round(log10(prob + 1e-300), 5) AS log_prob, round(-log2(1.0 / (999 * prob + 1)), 5) AS surprisal FROM q"""
STRING_FEATURES = f"""
WITH {CLOSE}, f AS (SELECT *, fn1 = '' OR fn2 = '' AS m FROM close)
SELECT record_id_1, record_id_2, CAST(m AS INT) AS missing, CASE WHEN NOT m THEN levenshtein(fn1, fn2) END AS edit_dist, CASE WHEN NOT m THEN CAST(fn1 = fn2 AS INT) END AS exact_match,
  CASE WHEN NOT m THEN CAST(left(fn1, 1) = left(fn2, 1) AS INT) END AS exact_match_1st, CASE WHEN NOT m THEN CAST(left(fn1, 3) = left(fn2, 3) AS INT) END AS exact_match_1st2nd3rd FROM f"""
OTHER_FEATURES = f"""
WITH {CLOSE}, f AS (SELECT *, try_strptime(d1, '%Y-%m-%d') AS x1, try_strptime(d2, '%Y-%m-%d') AS x2 FROM close)
SELECT record_id_1, record_id_2, CAST(x1 IS NULL OR x2 IS NULL AS INT) AS dob_missing, CASE WHEN x1 IS NOT NULL AND x2 IS NOT NULL THEN levenshtein(d1, d2) END AS dob_edit_dist, abs(date_diff('day', x1, x2)) AS dob_day_diff,
  CAST(a1 IS NULL OR a2 IS NULL AS INT) AS age_missing, CAST(abs(a1 - a2) AS DOUBLE) AS age_num_diff, CAST(g1 = '' OR g2 = '' AS INT) AS gender_missing, CASE WHEN g1 <> '' AND g2 <> '' THEN CAST(g1 = g2 AS INT) END AS gender_exact_match FROM f"""
GEO_FEATURES = """
WITH r AS (SELECT uid, min(latlon) AS a, max(latlon) AS b FROM raw_data WHERE contains(latlon, ',') AND uid IS NOT NULL AND NOT isnan(uid) GROUP BY uid),
p AS (SELECT uid, try_cast(split_part(a, ',', 1) AS DOUBLE) - try_cast(split_part(b, ',', 1) AS DOUBLE) AS dx, try_cast(split_part(a, ',', 2) AS DOUBLE) - try_cast(split_part(b, ',', 2) AS DOUBLE) AS dy FROM r)
SELECT uid, CAST(dx IS NULL OR dy IS NULL AS INT) AS missing, round(sqrt(dx * dx + dy * dy), 6) AS geog_dist FROM p"""
EXACT = f"""
WITH {CLOSE}, f AS (SELECT *, fn1 = fn2 AND fn1 <> '' AND ln1 = ln2 AND d1 = d2 AND d1 <> '' AS e, g1 <> '' AND g2 <> '' AND g1 <> g2 AS n FROM close)
SELECT record_id_1, record_id_2, CAST(e AS INT) AS exactmatch, CAST(e AND NOT n AS INT) AS var_exact_match FROM f"""
SWAPS = """
WITH one AS (SELECT record_id, coalesce(max(first_name), '') AS f, coalesce(max(last_name), '') AS l, max(uid) AS uid FROM an WHERE drop_from_nm = 0 AND uid IS NOT NULL GROUP BY record_id),
p AS (SELECT a.record_id AS r1, b.record_id AS r2, a.f AS f1, a.l AS l1, b.f AS f2, b.l AS l2, levenshtein(a.l || a.f, b.f || b.l) < levenshtein(a.f || a.l, b.f || b.l) AS better, length(b.record_id) < length(a.record_id) AS second
  FROM one a JOIN one b ON a.uid = b.uid AND a.record_id < b.record_id)
SELECT r1 AS record_id_1, r2 AS record_id_2, CASE WHEN better AND NOT second THEN l1 ELSE f1 END AS first_name_1, CASE WHEN better AND second THEN l2 ELSE f2 END AS first_name_2,
  CASE WHEN better AND NOT second THEN f1 ELSE l1 END AS last_name_1, CASE WHEN better AND second THEN f2 ELSE l2 END AS last_name_2 FROM p"""
SIDE_BY_SIDE = f"""
WITH {PEOPLE}, {LINKS}, tp AS (SELECT DISTINCT blockstring_1, blockstring_2 FROM links WHERE drop_from_nm_1 = 0 AND drop_from_nm_2 = 0),
k AS (SELECT * FROM people WHERE drop_from_nm = 0)
SELECT a.record_id AS record_id_1, b.record_id AS record_id_2, a.uid AS uid_1, b.uid AS uid_2 FROM tp JOIN k a ON a.blockstring = tp.blockstring_1 JOIN k b ON b.blockstring = tp.blockstring_2
WHERE a.record_id <> b.record_id AND (tp.blockstring_1 <> tp.blockstring_2 OR a.record_id < b.record_id) AND (a.file_type = 'new' OR b.file_type = 'new') AND (a.uid <> '') = (b.uid <> '')"""
ELIGIBLE = f"""
WITH {CLOSE}, ds AS (SELECT record_id, max(dataset) IN ('intake', 'permits') AS ok FROM an GROUP BY record_id)
SELECT record_id_1, record_id_2, CAST(u1 <> '' AND u2 <> '' AND x.ok AND y.ok AND g1 IN ('m', 'M') AS INT) AS match_train_eligible FROM close JOIN ds x ON x.record_id = record_id_1 JOIN ds y ON y.record_id = record_id_2"""
MODEL_TO_USE = f"WITH {CLOSE} SELECT record_id_1, record_id_2, CASE WHEN a1 IS NULL OR a2 IS NULL THEN 'no_age' WHEN try_strptime(d1, '%Y-%m-%d') IS NULL OR try_strptime(d2, '%Y-%m-%d') IS NULL THEN 'no_dob' ELSE 'basic' END AS model_to_use FROM close"

SCORED = """scored AS (SELECT ((l_orderkey * 7 + l_linenumber * 131) % 1000) / 1000 AS phat, CAST(((l_orderkey * 7 + l_linenumber * 131) % 1000) + (l_partkey % 7) * 60 > 600 AS INT) AS outcome,
  CAST(1 + l_linenumber % 3 AS DOUBLE) AS weight, CAST(l_suppkey % 5 = 0 AS INT) AS exactmatch FROM lineitem)"""
SUMS = "coalesce(sum(weight) FILTER (phat >= {t} AND outcome = 1), 0) AS tp, coalesce(sum(weight) FILTER (phat >= {t} AND outcome = 0), 0) AS fp, coalesce(sum(weight) FILTER (phat < {t} AND outcome = 1), 0) AS fn, coalesce(sum(weight) FILTER (phat < {t} AND outcome = 0), 0) AS tn"
FROM_SUMS = """round((tp + fn) / (tp + fp + fn + tn), 9) AS baserate, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(fp / nullif(fp + tn, 0), 9) AS fpr,
  round(fn / nullif(tp + fn, 0), 9) AS fnr, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(1.25 * (tp / nullif(tp + fp, 0)) * (tp / (tp + fn)) / (0.25 * tp / (tp + fp) + tp / (tp + fn)), 9) AS fscore"""
METRICS = f"WITH {SCORED}, s AS (SELECT {SUMS.format(t=0.6)} FROM scored) SELECT {FROM_SUMS} FROM s"
BY_UNIVERSE = f"""
WITH {SCORED}, u AS (SELECT 'all pairs' AS universe, * FROM scored UNION ALL SELECT CASE exactmatch WHEN 1 THEN 'exactmatch pairs' ELSE 'non exactmatch pairs' END, * FROM scored),
s AS (SELECT universe, {SUMS.format(t=0.6)} FROM u GROUP BY universe) SELECT universe, {FROM_SUMS} FROM s"""
GRID = f"grid AS (SELECT i / 100 AS t FROM range(2, 100) r(i)), s AS (SELECT t, {SUMS.format(t='t')} FROM grid, scored GROUP BY t)"
THRESHOLDS = f"WITH {SCORED}, {GRID} SELECT t, {FROM_SUMS} FROM s"
BEST = f"WITH {SCORED}, {GRID}, f AS (SELECT t, {FROM_SUMS} FROM s) SELECT t AS threshold, fscore FROM f WHERE fscore IS NOT NULL ORDER BY fscore DESC, t DESC LIMIT 1"
AUC = f"""
WITH {SCORED}, c AS (SELECT phat, coalesce(sum(weight) FILTER (outcome = 1), 0) AS p, coalesce(sum(weight) FILTER (outcome = 0), 0) AS n FROM scored GROUP BY phat)
SELECT round(sum(a.p * (b.n * CASE WHEN b.phat < a.phat THEN 1 WHEN b.phat = a.phat THEN 0.5 ELSE 0 END)) / ((SELECT sum(p) FROM c) * (SELECT sum(n) FROM c)), 9) AS auc FROM c a, c b"""

COMPONENTS = f"""
WITH RECURSIVE {PEOPLE}, {LINKS}, e AS (SELECT record_id_1 AS a, record_id_2 AS b FROM links UNION SELECT record_id_2, record_id_1 FROM links),
r AS (SELECT DISTINCT record_id AS root, record_id AS v FROM an WHERE record_id IS NOT NULL UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.v)
SELECT v AS id, min(root) AS component FROM r GROUP BY v"""
INITIAL = f"WITH c AS ({COMPONENTS}) SELECT id AS record_id, dense_rank() OVER (ORDER BY component) - 1 AS cluster_id FROM c"
INITIAL_EXISTING = """
WITH u AS (SELECT record_id, max(uid) AS uid FROM an GROUP BY record_id)
SELECT record_id, uid AS cluster_id FROM u WHERE uid IS NOT NULL
UNION ALL SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 + (SELECT max(uid) + 1 FROM u) FROM u WHERE uid IS NULL"""
VALID = f"""
WITH {CLOSE}, f AS (SELECT *, u1 <> '' AND u2 <> '' AS ku, d1 <> '' AND d2 <> '' AS kd, g1 <> '' AND g2 <> '' AND g1 <> g2 AS ge FROM close)
SELECT record_id_1, record_id_2, 'one' AS rule FROM f WHERE NOT (ku AND u1 <> u2)
UNION ALL SELECT record_id_1, record_id_2, 'leven' FROM f WHERE NOT (ku AND levenshtein(u1, u2) > 1)
UNION ALL SELECT record_id_1, record_id_2, 'two' FROM f WHERE NOT ge AND NOT ((ku OR kd) AND NOT (ku AND u1 = u2) AND NOT (kd AND d1 = d2))"""
UIDS = "c AS (SELECT record_id, max(uid) AS entity, max(uid) // 14 AS cluster_id FROM an WHERE uid IS NOT NULL GROUP BY record_id)"
QUALITY = f"""
WITH {UIDS}, s AS (SELECT cluster_id, count(*) AS n FROM c GROUP BY 1), e AS (SELECT entity, count(*) AS n FROM c GROUP BY 1), b AS (SELECT cluster_id, entity, count(*) AS n FROM c GROUP BY 1, 2)
SELECT CAST((SELECT sum(n) FROM s) AS BIGINT) AS n_records, (SELECT count(*) FROM s) AS n_clusters, (SELECT count(*) FROM s WHERE n = 1) AS n_singletons, (SELECT max(n) FROM s) AS max_size,
  round((SELECT sum(n * (n - 1) / 2) FROM b) / (SELECT sum(n * (n - 1) / 2) FROM s), 9) AS precision, round((SELECT sum(n * (n - 1) / 2) FROM b) / (SELECT sum(n * (n - 1) / 2) FROM e), 9) AS recall"""
SHAPE = f"WITH {UIDS}, s AS (SELECT cluster_id, count(*) AS n FROM c GROUP BY 1) SELECT count(*) AS n_clusters, count(*) FILTER (n = 1) AS n_singleton_clusters, max(n) AS max_size FROM s"
OUTPUT = f"WITH {UIDS}, a AS (SELECT DISTINCT record_id, first_name, blockstring, drop_from_nm FROM an) SELECT a.record_id, lower(first_name) AS first_name, CAST(cluster_id AS VARCHAR) AS cluster_id FROM a LEFT JOIN c USING (record_id)"
