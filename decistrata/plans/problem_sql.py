"""ANSI SQL, run by DuckDB over the same tables, for the queries of problems 2, 4 and 5."""

from __future__ import annotations

DOMAIN_KEY = "regexp_replace(lower(regexp_replace({0}, '\\p{{Cf}}', '', 'g')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
WIDE, NARROW = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(chr(c) for c in range(0x21, 0x7F))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def narrow(x: str) -> str:
    return f"translate({x}, {_quoted(WIDE)}, {_quoted(NARROW)})"


def domain_key(x: str) -> str:
    return DOMAIN_KEY.format(x)


DOMAINS = f"dom AS (SELECT domain_id AS domain, {domain_key('domain_id')} AS dk FROM domains)"


def network_key(x: str) -> str:
    """Number and letters of a network's name, null for a string that names none."""
    pattern = "'(?:^|[^A-Z0-9])NW[^A-Z0-9]*([0-9O]+)[^A-Z0-9]*([A-Z]{2})[^A-Z0-9]*$'"
    up = f"upper({narrow(x)})"
    return f"CASE WHEN regexp_matches({up}, {pattern}) THEN ltrim(replace(regexp_extract({up}, {pattern}, 1), 'O', '0'), '0') || '-' || regexp_extract({up}, {pattern}, 2) END"


_COLUMNS = """c AS (
SELECT load_id, 'beta' AS column_name, beta AS num, NULL::VARCHAR AS txt FROM decision_states
UNION ALL SELECT load_id, 'Gamma', "Gamma", NULL FROM decision_states
UNION ALL SELECT load_id, 'lambda_R', lambda_R, NULL FROM decision_states
UNION ALL SELECT load_id, 'oracle_status', NULL, oracle_status FROM oracle_labels)"""

P2_EXACT = f"""WITH {_COLUMNS}
SELECT load_id, column_name, count(*) AS n_rows, count(*) FILTER (num IS NULL AND txt IS NULL) AS nulls,
       count(DISTINCT num) + count(DISTINCT txt) AS n_distinct, min(num) AS least, max(num) AS most
FROM c GROUP BY ALL"""

_P2 = f"""WITH {_COLUMNS},
lsize AS (SELECT column_name, load_id, count(*) AS size FROM c WHERE txt IS NOT NULL GROUP BY ALL),
tv AS (SELECT column_name, load_id, txt, count(*) AS n FROM c WHERE txt IS NOT NULL GROUP BY ALL),
nload AS (SELECT column_name, count(*) AS loads FROM lsize GROUP BY ALL),
usual AS (SELECT column_name, txt FROM tv JOIN lsize USING (column_name, load_id) JOIN nload USING (column_name) WHERE n >= 0.005 * size
          GROUP BY column_name, txt HAVING 2 * count(*) > max(loads)),
ends AS (SELECT column_name, load_id, min(num) AS lo, max(num) AS hi FROM c WHERE isfinite(num) GROUP BY ALL),
mid AS (SELECT column_name, median(lo) AS mlo, median(hi) AS mhi FROM ends GROUP BY ALL),
kept AS (SELECT column_name, quantile_cont(lo, 0.1) FILTER (lo >= mlo - 0.25 * (mhi - mlo)) AS low, quantile_cont(hi, 0.9) FILTER (hi <= mhi + 0.25 * (mhi - mlo)) AS high
         FROM ends JOIN mid USING (column_name) GROUP BY ALL),
d AS (SELECT c.*, low, high, u.txt IS NOT NULL AS is_usual, coalesce(isfinite(num), false) AS fine
      FROM c LEFT JOIN kept USING (column_name) LEFT JOIN usual u ON u.column_name = c.column_name AND u.txt = c.txt),
f AS (SELECT load_id, column_name, count(*) AS n, count(*) FILTER (num IS NULL AND txt IS NULL) AS nulls, count(DISTINCT num) + count(DISTINCT txt) AS n_distinct, count(num) + count(txt) AS given,
             min(num) FILTER (fine) AS least, max(num) FILTER (fine) AS most, count(*) FILTER ((num IS NOT NULL AND NOT fine) OR (txt IS NOT NULL AND NOT is_usual)) AS ill,
             max(low) AS low, max(high) AS high, count(*) FILTER (fine AND NOT num BETWEEN low AND high) AS outside,
             count(*) FILTER (fine AND (num < low - 0.25 * (high - low) OR num > high + 0.25 * (high - low))) AS far
      FROM d GROUP BY ALL),
k AS (SELECT load_id, column_name, CASE WHEN num BETWEEN low AND high THEN least(floor((num - low) / greatest(high - low, 1e-300) * 20), 19)::INT::VARCHAR WHEN is_usual THEN txt END AS cell FROM d),
own AS (SELECT load_id, column_name, cell, count(*) AS own FROM k WHERE cell IS NOT NULL GROUP BY ALL),
own_n AS (SELECT load_id, column_name, sum(own) AS own_n FROM own GROUP BY ALL),
every AS (SELECT column_name, cell, sum(own) AS every FROM own GROUP BY ALL),
all_n AS (SELECT column_name, sum(every) AS all_n, count(*) AS cells FROM every GROUP BY ALL),
grid AS (SELECT o.load_id, o.column_name, coalesce(own, 0) AS o, (coalesce(own, 0) + 0.5) / (own_n + 0.5 * cells) AS p, (every - coalesce(own, 0) + 0.5) / (all_n - own_n + 0.5 * cells) AS q, cells, own_n, all_n - own_n AS rest_n
         FROM own_n o JOIN all_n USING (column_name) JOIN every e USING (column_name) LEFT JOIN own ON own.load_id = o.load_id AND own.column_name = o.column_name AND own.cell = e.cell),
psi AS (SELECT load_id, column_name, CASE WHEN max(rest_n) > 0 THEN sum((p - q) * ln(p / q)) END AS psi, CASE WHEN max(rest_n) > 0 THEN sum((o - q * own_n) * (o - q * own_n) / (q * own_n)) END AS chi,
               max(cells) AS cells, max(own_n) AS own_n FROM grid GROUP BY ALL),
r AS (SELECT f.*, nulls / n AS nr, CASE WHEN low IS NULL AND given > 0 THEN ill / given END AS fr, CASE WHEN given > 0 THEN far / given END AS orate, CASE WHEN given > 0 THEN outside / given END AS erate,
             psi, chi, cells, own_n FROM f LEFT JOIN psi USING (load_id, column_name))"""

P2_FOUND = f"""{_P2},
m AS (SELECT column_name, median(nr) AS mnr, median(fr) AS mfr, median(orate) AS mor, median(erate) AS mer, median(psi) AS mpsi, count(*) AS loads FROM r GROUP BY ALL),
x AS (SELECT *, coalesce(psi > 0.2 + 4 * (cells - 1) / greatest(own_n, 1) OR (psi > 0.1 + 4 * (cells - 1) / greatest(own_n, 1) AND psi > 5 * mpsi), false) AS spread
      FROM r JOIN m USING (column_name) WHERE loads > 1)
SELECT load_id, column_name, 'null_rate' AS issue FROM x WHERE abs(nr - mnr) > 0.08 + 4 * sqrt(greatest((mnr + 1 / (n + 1)) * (1 - mnr), 0) / greatest(n, 1))
UNION ALL SELECT load_id, column_name, 'written_form' FROM x WHERE abs(fr - mfr) > 0.08 + 4 * sqrt(greatest((mfr + 1 / (given + 1)) * (1 - mfr), 0) / greatest(given, 1))
UNION ALL SELECT load_id, column_name, 'range' FROM x WHERE abs(orate - mor) > 0.03 + 4 * sqrt(greatest((mor + 1 / (given + 1)) * (1 - mor), 0) / greatest(given, 1))
          OR (NOT spread AND abs(erate - mer) > 0.03 + 4 * sqrt(greatest((mer + 1 / (given + 1)) * (1 - mer), 0) / greatest(given, 1)))
UNION ALL SELECT load_id, column_name, 'distribution' FROM x WHERE spread"""

P2_PROFILE = f"""{_P2}
SELECT load_id, column_name, n AS rows, nulls, n_distinct AS "distinct", least, most, ill AS ill_formed, low, high, outside, far AS far_outside,
       round(psi, 6) AS psi, round(chi, 3) AS chi_square, cells, own_n::BIGINT AS comparable, nr AS null_rate FROM r"""

P2_DRIFT = f"""{_P2}
SELECT load_id, column_name, nr AS null_rate, lag(nr) OVER w AS null_rate_before, n_distinct AS "distinct", lag(n_distinct) OVER w AS distinct_before, least, lag(least) OVER w AS least_before,
       most, lag(most) OVER w AS most_before, round(psi, 6) AS psi, round(lag(psi) OVER w, 6) AS psi_before
FROM r WINDOW w AS (PARTITION BY column_name ORDER BY load_id NULLS FIRST)"""

_P4 = f"""WITH {DOMAINS},
s AS (SELECT state_id, domain, {network_key('network_id')} AS net, demand_features, inventory_features FROM decision_states LEFT JOIN dom ON dk = {domain_key('domain_id')} WHERE state_id IS NOT NULL),
cat AS (SELECT domain, feature_group || '.' || feature_name AS field, feature_group AS g, feature_name AS f FROM feature_catalog JOIN dom ON dk = {domain_key('domain_id')} WHERE feature_group IN ('demand_features', 'inventory_features')),
e AS (SELECT state_id, field, v FROM (
        SELECT state_id, 'demand_features.' || e.key AS field, e.value AS v FROM (SELECT state_id, unnest(map_entries(demand_features)) AS e FROM s)
        UNION ALL SELECT state_id, 'inventory_features.' || e.key, e.value FROM (SELECT state_id, unnest(map_entries(inventory_features)) AS e FROM s))
      WHERE v IS NOT NULL AND isfinite(v) AND field IN (SELECT field FROM cat)),
size AS (SELECT field, exp(avg(ln(abs(v)))) AS size FROM e WHERE v <> 0 GROUP BY field),
odd AS (SELECT field, v, abs(v) > 1e3 * size AS far, abs(v) <= 1e9 * size AS near, count(*) AS n FROM e JOIN size USING (field) WHERE v < 0 OR abs(v) > 1e3 * size GROUP BY ALL),
codes AS (SELECT v FROM odd WHERE far GROUP BY v HAVING count(*) > 1),
below AS (SELECT field, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, v) AS r FROM odd WHERE v < 0 AND near AND v NOT IN (SELECT v FROM codes)),
signed AS (SELECT field FROM below GROUP BY field HAVING 2 * sum(n) FILTER (r <= 5) < sum(n)),
usable AS (SELECT DISTINCT state_id, field FROM e LEFT JOIN size USING (field)
           WHERE (v = 0 OR abs(v) <= 1e9 * size) AND v NOT IN (SELECT v FROM codes) AND (v >= 0 OR field IN (SELECT field FROM signed))),
one AS (SELECT state_id, max(domain) AS domain, max(net) AS net FROM s GROUP BY state_id),
lack AS (SELECT state_id, domain, 'network_id' AS field FROM one WHERE net IS NULL
UNION ALL
SELECT state_id, domain, field FROM (SELECT DISTINCT state_id, domain, field FROM one JOIN cat USING (domain)) w WHERE NOT EXISTS (SELECT 1 FROM usable u WHERE u.state_id = w.state_id AND u.field = w.field))"""

P4_FOUND = f"""{_P4} SELECT state_id, field FROM lack"""

#: Every field is filled of which any state of the domain has a value.
P4_CHECK = f"""{_P4},
has AS (SELECT domain, field FROM usable JOIN one USING (state_id) GROUP BY ALL UNION ALL SELECT domain, 'network_id' FROM one WHERE net IS NOT NULL AND domain IS NOT NULL GROUP BY domain)
SELECT lack.field, count(*) AS missing, count(has.field) FILTER (lack.field <> 'network_id') AS "values", count(has.field) FILTER (lack.field = 'network_id') AS labels, count(has.field) AS marked
FROM lack LEFT JOIN has ON has.domain = lack.domain AND has.field = lack.field GROUP BY lack.field"""

_TIDY = f"trim(regexp_replace(regexp_replace(lower(regexp_replace({narrow('raw_value')}, '\\p{{Cf}}', '', 'g')), '[−–]', '-', 'g'), '[\\s\\x{{00A0}}\\x{{2007}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g'))"

#: The catalog's features and their types, for the SQL of the wide tables: a SELECT
#: can't take its columns from a table, so they are written out here. Fixed values.
FEATURES = {
    "cost_features": "budget_left:double fx_hedged:boolean holding_rate:double penalty_unit:double setup_fixed:double transfer_unit:double",
    "demand_features": "cv:double mean_weekly:double order_lines:long peak_ratio:double promo_uplift:double season_strength:double trend:double zero_share:double",
    "inventory_features": "aged_share:double days_cover:double in_transit:double on_hand:double safety_stock:double stockout_days:long turn_rate:double",
    "network_features": "arcs:long depth:long dual_sourced:boolean hub_share:double lead_days:double nodes:long",
}

_P5_VALUES = f"""WITH {DOMAINS},
cat AS (SELECT domain, feature_group || '.' || feature_name AS feature, value_type, lower(unit) AS unit, {domain_key("feature_group || feature_name")} AS k1,
               {domain_key("regexp_replace(feature_group, '_features$', '') || feature_name")} AS k2 FROM feature_catalog JOIN dom ON dk = {domain_key('domain_id')}),
raw AS (SELECT entity_id, domain, {domain_key(narrow('attr_name'))} AS k, {_TIDY} AS t, loaded_at FROM feature_rows JOIN dom ON dk = {domain_key(narrow('domain_id'))} WHERE entity_id IS NOT NULL),
j AS (SELECT entity_id, feature, value_type, t, loaded_at, CASE WHEN unit IS NOT NULL AND unit <> '' AND ends_with(t, unit) THEN rtrim(left(t, length(t) - length(unit))) ELSE t END AS b
      FROM raw JOIN cat ON raw.domain = cat.domain AND (k = k1 OR k = k2)),
n AS (SELECT *, ends_with(b, '%') AS pct, CASE WHEN ends_with(b, '%') THEN rtrim(left(b, length(b) - 1)) ELSE b END AS x FROM j),
y AS (SELECT *, CASE
        WHEN regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') THEN x
        WHEN regexp_full_match(x, '[+-]?[1-9][0-9]{{0,2}}(,[0-9]{{3}})+(\\.[0-9]+)?') THEN replace(x, ',', '')
        WHEN regexp_full_match(x, '[+-]?[0-9]+,[0-9]+') THEN replace(x, ',', '.')
        WHEN regexp_full_match(x, '[+-]?[1-9][0-9]{{0,2}}(\\.[0-9]{{3}})+,[0-9]+') THEN replace(replace(x, '.', ''), ',', '.')
        WHEN regexp_full_match(x, '[+-]?[1-9][0-9]{{0,2}}([ ''’][0-9]{{3}})+([.,][0-9]+)?') THEN replace(replace(replace(replace(x, ' ', ''), '''', ''), '’', ''), ',', '.') END AS x2 FROM n),
v AS (SELECT *, TRY_CAST(x2 AS DOUBLE) AS num, TRY_CAST(TRY_CAST(CASE WHEN pct THEN x2 || 'e-2' ELSE x2 END AS DECIMAL(38,10)) AS BIGINT) AS whole FROM y),
z AS (SELECT *, num / (CASE WHEN pct THEN 100 ELSE 1 END) = floor(num / (CASE WHEN pct THEN 100 ELSE 1 END)) AND whole IS NOT NULL AS is_whole FROM v),
w AS (SELECT entity_id, feature, loaded_at, CASE WHEN value_type = 'long' AND is_whole THEN whole END AS whole, CASE value_type
        WHEN 'boolean' THEN CASE WHEN t IN ('true', 't', 'yes', 'y', 'on', '1') THEN 1.0 WHEN t IN ('false', 'f', 'no', 'n', 'off', '0') THEN 0.0 END
        WHEN 'long' THEN CASE WHEN is_whole THEN whole::DOUBLE END
        ELSE CASE WHEN pct THEN round(num / 100, 12) ELSE num END END AS value FROM z)
"""
_CLEAR = "coalesce(min(whole) = max(whole), max(value) - min(value) <= 1e-9 * greatest(1.0, abs(max(value))))"

P5_FOUND = f"""{_P5_VALUES}SELECT entity_id, feature AS feature_name, CASE WHEN count(value) = 0 THEN 'no_value' ELSE 'conflict' END AS outcome
FROM w GROUP BY entity_id, feature HAVING count(value) = 0 OR NOT {_CLEAR}"""


def _p5_column(group: str, name: str, kind: str) -> str:
    of = lambda x: f"max(CASE WHEN feature = '{group}.{name}' THEN {x} END)"
    typed = {"boolean": f"{of('v')} <> 0", "long": f"coalesce({of('n')}, {of('v')}::BIGINT)", "double": of("v")}[kind]
    return f"{typed} AS {group}__{name}"


_P5_COLUMNS = ",\n".join(_p5_column(g, *f.split(":")) for g, fs in FEATURES.items() for f in fs.split())
_P5_ENTITIES = f"""ent AS (SELECT entity_id, max(domain) AS domain_id FROM feature_rows LEFT JOIN dom ON dk = {domain_key(narrow('domain_id'))} WHERE entity_id IS NOT NULL GROUP BY entity_id)
SELECT entity_id, domain_id, {_P5_COLUMNS}
FROM ent LEFT JOIN picked USING (entity_id) GROUP BY entity_id, domain_id"""

P5_WIDE = f"""{_P5_VALUES}, picked AS (SELECT entity_id, feature, max(value) AS v, max(whole) AS n FROM w WHERE value IS NOT NULL GROUP BY ALL HAVING {_CLEAR}), {_P5_ENTITIES}"""

P5_LATEST = f"""{_P5_VALUES}, last AS (SELECT *, row_number() OVER (PARTITION BY entity_id, feature ORDER BY loaded_at DESC NULLS LAST, value DESC) AS k FROM w WHERE value IS NOT NULL),
picked AS (SELECT entity_id, feature, value AS v, whole AS n FROM last WHERE k = 1), {_P5_ENTITIES}"""
