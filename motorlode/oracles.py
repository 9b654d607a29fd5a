"""DuckDB SQL for the registered queries: one chain of common tables, a SELECT for each query."""

from __future__ import annotations

from motorlode import policy as P
from motorlode.plans import specimens as S

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MAY = "(market IS NULL OR len(markets) = 0 OR list_contains(markets, market)) AND (model_year IS NULL OR model_year BETWEEN coalesce(from_year, 1886) AND coalesce(to_year, 9999))"
_SURE = "((len(markets) = 0 OR market IS NOT NULL) AND ((from_year IS NULL AND to_year IS NULL) OR model_year IS NOT NULL))"


def _resolved(field: str) -> str:
    return f"CASE WHEN n_{field} > 1 THEN 'AMBIGUOUS' WHEN miss_{field} THEN 'UNKNOWN' WHEN unsure THEN 'NEEDS_CONTEXT' ELSE 'KNOWN' END AS {field}_status, CASE WHEN n_{field} = 1 AND NOT miss_{field} AND NOT unsure THEN one_{field} END AS {field}"


_FIELDS = ("brand", "manufacturer", "category", "country")

_TABLES = ("manufacturers", "assignments", "types", "elements", "rich_wmis", "schemas", "patterns", "engines", "models", "conversions", "rules", "rule_claims", "approvals", "make_aliases", "model_aliases", "sources", "masks", "targets", "wmi_rows", "wmi_makes", "makes", "dump_manufacturers", "vehicle_types")

# name: (tables it reads besides those before it, SQL)
_CHAIN: list[tuple[str, str]] = [
    ("req", S.REQUESTS_SQL),
    ("codes_in", S.CODES_SQL),
    *[(f"t_{t}", S.values_sql(t)) for t in _TABLES],
    ("prep0", f"SELECT *, translate(trim(supplied, ' '), '{_LOWER}', '{_UPPER}') AS normalized FROM req"),
    ("prep", "SELECT *, CASE WHEN length(normalized) <> 17 THEN 'UNSUPPORTED_LENGTH' WHEN regexp_full_match(normalized, '[A-HJ-NPR-Z0-9]{17}') THEN 'MODERN_FORMAT' ELSE 'INVALID_CHARACTERS' END AS structure FROM prep0"),
    ("keyed", "SELECT *, CASE WHEN structure = 'UNSUPPORTED_LENGTH' THEN NULL WHEN substr(normalized, 1, 3) IN (SELECT substr(wmi, 1, 3) FROM t_assignments WHERE length(wmi) = 6) THEN substr(normalized, 1, 3) || substr(normalized, 12, 3) ELSE substr(normalized, 1, 3) END AS wmi FROM prep"),
    ("found", f"SELECT k.req_id, k.structure, k.model_year, k.market, a.id AS assignment_id, a.brand, a.category, m.name AS manufacturer, m.country, CASE WHEN a.id IS NOT NULL THEN {_SURE} END AS established FROM keyed k LEFT JOIN t_assignments a ON k.wmi = a.wmi AND {_MAY} LEFT JOIN t_manufacturers m ON a.manufacturer_id = m.id"),
    ("found_g", "SELECT req_id, any_value(structure) AS structure, count(assignment_id) AS n_candidates, coalesce(bool_or(NOT established), false) AS unsure, " + ", ".join(f"count(DISTINCT {f}) AS n_{f}, bool_or({f} IS NULL) AS miss_{f}, min({f}) AS one_{f}" for f in _FIELDS) + " FROM found GROUP BY req_id"),
    ("brand_list", "SELECT req_id, string_agg(brand, '|' ORDER BY first_id) AS brands FROM (SELECT req_id, brand, min(assignment_id) AS first_id FROM found WHERE brand IS NOT NULL GROUP BY ALL) GROUP BY req_id"),
    ("resolution", "SELECT g.req_id, n_candidates, CASE WHEN structure = 'UNSUPPORTED_LENGTH' THEN 'UNSUPPORTED_FORMAT' WHEN n_candidates = 0 THEN 'UNKNOWN' WHEN n_candidates > 1 THEN 'AMBIGUOUS' WHEN unsure THEN 'NEEDS_CONTEXT' ELSE 'RECOGNIZED' END AS status, coalesce(b.brands, '') AS brand_possibilities, " + ", ".join(_resolved(f) for f in _FIELDS) + " FROM found_g g LEFT JOIN brand_list b ON g.req_id = b.req_id"),
    ("codes_p", f"SELECT req_id, translate(trim(hsn, ' '), '{_LOWER}', '{_UPPER}') AS norm_hsn, translate(trim(tsn, ' '), '{_LOWER}', '{_UPPER}') AS norm_tsn FROM codes_in"),
    ("codes_v", "SELECT *, CASE WHEN NOT regexp_full_match(norm_hsn, '[0-9]{4}') THEN CASE WHEN NOT regexp_full_match(norm_tsn, '[A-Z0-9]{3}') THEN 'INVALID_HSN_AND_TSN' ELSE 'INVALID_HSN' END WHEN NOT regexp_full_match(norm_tsn, '[A-Z0-9]{3}') THEN 'INVALID_TSN' ELSE 'VALID' END AS input_status FROM codes_p"),
    ("codes_f", "SELECT c.*, t.manufacturer, t.trade_name, t.source_object_id FROM codes_v c LEFT JOIN t_types t ON c.input_status = 'VALID' AND c.norm_hsn = t.hsn AND c.norm_tsn = t.tsn"),
    ("codes_g", "SELECT req_id, any_value(input_status) AS input_status, count(source_object_id) AS n_candidates, max(trade_name) AS one FROM codes_f GROUP BY req_id"),
    ("richkey", "SELECT *, CASE WHEN substr(normalized, 3, 1) = '9' THEN substr(normalized, 1, 3) || substr(normalized, 12, 3) ELSE substr(normalized, 1, 3) END AS wmi, substr(normalized, 4, 5) || '|' || substr(normalized, 10, 8) AS key FROM prep WHERE structure = 'MODERN_FORMAT'"),
    ("rich", f"SELECT k.*, w.vehicle_type, w.truck_type, strpos('{P.YEAR_CODES}', substr(normalized, 10, 1)) AS code FROM richkey k JOIN t_rich_wmis w ON k.wmi = w.wmi"),
    ("base", "SELECT *, 1979 + code AS base FROM rich WHERE code > 0"),
    ("cycles", "SELECT *, model_year AS year FROM base WHERE model_year >= 1980 AND (model_year - base) % 30 = 0 UNION ALL SELECT * FROM (SELECT *, unnest(generate_series(base, 2028, 30)) AS year FROM base WHERE model_year IS NULL) WHERE NOT (vehicle_type IN (2, 7) OR (vehicle_type = 3 AND coalesce(truck_type, '') = '1')) OR (year < 2010) = regexp_full_match(substr(normalized, 7, 1), '[0-9]')"),
    ("years", "SELECT req_id, normalized, model_year, market, wmi, key, year::INTEGER AS year FROM cycles"),
    ("direct", "SELECT y.req_id, y.year, p.element_id, CASE WHEN p.capture >= 0 THEN substr(key, p.capture + 1, p.capture_length) ELSE p.value END AS value, CASE WHEN p.capture >= 0 THEN substr(key, p.capture + 1, p.capture_length) ELSE p.attribute_id END AS attribute_id, CASE WHEN p.capture >= 0 THEN 'NUMERIC_PATTERN' ELSE 'PATTERN' END AS kind, p.pattern_id::VARCHAR AS rule_id, s.schema_id, p.keys, CASE WHEN p.capture >= 0 THEN 100 ELSE s.year_from END AS priority, nullif(p.changed, '') AS changed, p.pattern_id FROM years y JOIN t_schemas s ON y.wmi = s.wmi AND y.year BETWEEN s.year_from AND coalesce(s.year_to, 2999) JOIN t_patterns p ON s.schema_id = p.schema_id AND regexp_matches(y.key, p.regex)"),
    ("parent", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id, year ORDER BY priority DESC, changed DESC NULLS FIRST, pattern_id DESC) AS n FROM direct WHERE element_id = 18) WHERE n = 1"),
    ("engine", "SELECT p.req_id, p.year, e.element_id, e.value, e.attribute_id, 'ENGINE_MODEL' AS kind, p.rule_id || '/engine:' || e.id AS rule_id, p.schema_id, p.keys, 50 AS priority, nullif(e.changed, '') AS changed, e.id AS pattern_id FROM parent p JOIN t_engines e ON lower(trim(p.attribute_id)) = e.engine_key"),
    ("matched", "SELECT * FROM direct UNION ALL SELECT * FROM engine"),
    ("ranked_direct", "SELECT *, row_number() OVER (PARTITION BY req_id, year, element_id ORDER BY priority DESC, changed DESC NULLS FIRST, length(replace(keys, '*', '')), replace(replace(keys, '[', ''), ']', ''), pattern_id) AS place FROM direct"),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY req_id, year, element_id ORDER BY priority DESC, changed DESC NULLS FIRST, length(replace(keys, '*', '')), replace(replace(keys, '[', ''), ']', ''), pattern_id) AS place FROM matched"),
    *[(name, f"SELECT req_id, year, element_id, value, attribute_id, kind, rule_id, schema_id, keys, min(place) AS place FROM {of} WHERE place = 1 OR element_id IN {P.MULTIPLE_ELEMENTS} GROUP BY ALL") for name, of in (("chosen_direct", "ranked_direct"), ("chosen", "ranked"))],
    *[(f"made{x}", f"SELECT c.req_id, c.year, 26 AS element_id, m.make_name AS value, m.make_id AS attribute_id, 'MODEL_MAKE' AS kind, c.rule_id || '/make:' || m.make_id AS rule_id, c.schema_id, c.keys, 1 AS place FROM chosen{x} c JOIN t_models m ON c.attribute_id = m.model_id WHERE c.element_id = 28 AND c.place = 1 UNION ALL SELECT * FROM chosen{x} c WHERE NOT (c.element_id = 26 AND EXISTS (SELECT 1 FROM chosen{x} d JOIN t_models m ON d.attribute_id = m.model_id WHERE d.element_id = 28 AND d.place = 1 AND d.req_id = c.req_id AND d.year = c.year))") for x in ("_direct", "")],
    ("single", "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY req_id, year, element_id) AS n FROM made) s WHERE n = 1 AND EXISTS (SELECT 1 FROM matched m WHERE m.req_id = s.req_id AND m.year = s.year AND m.element_id = s.element_id)"),
    ("numbers", "SELECT s.req_id, s.year, c.to_element AS element_id, c.id, s.rule_id, s.schema_id, s.keys, round(try_cast(s.value AS DECIMAL(20, 9)) * c.factor, 6) AS number FROM single s JOIN t_conversions c ON s.element_id = c.from_element WHERE regexp_full_match(s.value, '[0-9.]+') AND try_cast(s.value AS DECIMAL(20, 9)) IS NOT NULL"),
    ("converted", r"SELECT req_id, year, element_id, regexp_replace(regexp_replace(number::DECIMAL(20, 6)::VARCHAR, '0+$', ''), '\.$', '') AS value, rule_id || '/conversion:' || id AS rule_id, schema_id, keys FROM numbers n WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.req_id = n.req_id AND m.year = n.year AND m.element_id = n.element_id) QUALIFY row_number() OVER (PARTITION BY req_id, year, element_id ORDER BY id) = 1"),
    ("enriched", "SELECT req_id, year, element_id, value, attribute_id, kind, rule_id, schema_id, keys, place FROM made UNION ALL SELECT req_id, year, element_id, value, value, 'UNIT_CONVERSION', rule_id, schema_id, keys, 1 FROM converted"),
    ("facts", "SELECT * FROM enriched WHERE element_id <> 29 UNION ALL SELECT y.req_id, y.year, 29, y.year::VARCHAR, y.year::VARCHAR, CASE WHEN y.model_year IS NOT NULL THEN 'CALLER_CONTEXT' ELSE 'VIN_YEAR' END, 'model-year', NULL, substr(y.normalized, 10, 1), 1 FROM years y WHERE EXISTS (SELECT 1 FROM enriched e WHERE e.req_id = y.req_id AND e.year = y.year)"),
    ("n_years", "SELECT req_id, count(DISTINCT year) AS n, any_value(market) AS market FROM years GROUP BY req_id"),
    ("first_seen", "SELECT req_id, element_id, value, min(year * 1000 + place) AS seen FROM facts GROUP BY ALL"),
    ("in_years", "SELECT req_id, element_id, count(DISTINCT year) AS n FROM facts GROUP BY ALL"),
    ("pfields", "SELECT f.req_id, f.element_id, CASE WHEN count(*) > 1 THEN 'AMBIGUOUS' WHEN any_value(i.n) < any_value(y.n) THEN 'UNKNOWN' WHEN any_value(y.market) IS DISTINCT FROM 'US' THEN 'NEEDS_CONTEXT' ELSE 'KNOWN' END AS status, string_agg(f.value, '|' ORDER BY f.seen) AS possibilities, list(f.value ORDER BY f.seen) AS vals FROM first_seen f JOIN in_years i ON f.req_id = i.req_id AND f.element_id = i.element_id JOIN n_years y ON f.req_id = y.req_id GROUP BY f.req_id, f.element_id"),
    ("lit", "SELECT p.req_id, r.id AS rule, r.scope, r.model_year AS rule_year, p.normalized, (len(r.markets) > 0 AND NOT coalesce(list_contains(r.markets, p.market), false)) AS foreign_, coalesce(r.model_year <> p.model_year, false) AS conflict FROM prep p JOIN t_rules r ON p.structure = 'MODERN_FORMAT' AND regexp_full_match(p.normalized, r.pattern) AND (r.exclude IS NULL OR NOT regexp_full_match(p.normalized, r.exclude))"),
    ("lit_ok", "SELECT * FROM lit WHERE NOT (foreign_ AND conflict)"),
    ("held", "SELECT DISTINCT l.req_id, l.rule, l.foreign_, l.conflict, c.code, c.value, c.source_id FROM lit_ok l JOIN t_rule_claims c ON l.rule = c.rule_id AND (c.position < 0 OR strpos(c.characters, substr(l.normalized, c.position + 1, 1)) > 0)"),
    ("lfields", "SELECT req_id, rule, code, CASE WHEN count(DISTINCT value) > 1 THEN 'AMBIGUOUS' WHEN bool_or(foreign_) THEN 'NEEDS_CONTEXT' ELSE 'KNOWN' END AS status, list(DISTINCT value ORDER BY value) AS vals FROM held WHERE NOT conflict GROUP BY req_id, rule, code"),
    ("allfields", "SELECT req_id, 'patterns' AS rule, code, status, vals FROM pfields JOIN t_elements USING (element_id) UNION ALL SELECT * FROM lfields"),
    ("results", "SELECT req_id, rule, scope, CASE WHEN conflict THEN 'CONTEXT_CONFLICT' WHEN foreign_ THEN 'NEEDS_CONTEXT' ELSE 'DECODED' END AS status, TRUE AS meaningful FROM lit_ok UNION ALL SELECT r.req_id, 'patterns', 'US', CASE WHEN NOT EXISTS (SELECT 1 FROM years y WHERE y.req_id = r.req_id) THEN CASE WHEN r.model_year IS NOT NULL THEN 'CONTEXT_CONFLICT' ELSE 'UNKNOWN' END WHEN NOT EXISTS (SELECT 1 FROM pfields f WHERE f.req_id = r.req_id) THEN 'UNKNOWN' WHEN r.market IS NOT DISTINCT FROM 'US' THEN 'DECODED' ELSE 'NEEDS_CONTEXT' END, EXISTS (SELECT 1 FROM years y WHERE y.req_id = r.req_id) FROM rich r"),
    ("marked", "SELECT r.*, (r.status = 'CONTEXT_CONFLICT' AND (r.scope <> 'US' OR p.market IS NOT DISTINCT FROM 'US')) AS conflicting FROM results r JOIN prep p ON r.req_id = p.req_id"),
    ("head", "SELECT req_id, bool_or(conflicting) AS conflict, count(*) FILTER (meaningful) AS n_results, list(DISTINCT scope ORDER BY scope) FILTER (meaningful) AS scopes, min_by(scope, (rule = 'patterns')::INT::VARCHAR || rule) FILTER (conflicting) AS conflict_scope, any_value(status) FILTER (meaningful) AS one_status, max(status) FILTER (rule = 'patterns') AS pattern_status FROM marked GROUP BY req_id"),
    ("texts", f"SELECT l.req_id, l.rule, [r.stage] AS stages, [CASE WHEN l.conflict THEN r.conflict_warning ELSE r.warning END] AS warnings FROM lit_ok l JOIN t_rules r ON l.rule = r.id UNION ALL SELECT r.req_id, 'patterns', {list(P.STAGES)!r}, list_filter([CASE WHEN n.n IS NULL THEN '{P.YEAR_CONFLICT_WARNING}' END, CASE WHEN r.market IS DISTINCT FROM 'US' AND EXISTS (SELECT 1 FROM pfields f WHERE f.req_id = r.req_id) THEN CASE WHEN r.market IS NULL THEN '{P.UNKNOWN_MARKET_WARNING}' ELSE replace(replace('{P.FALLBACK_MESSAGE}', '{{sourceMarket}}', 'US'), '{{requestedMarket}}', r.market) END END, CASE WHEN n.n > 1 THEN '" + P.YEAR_ALTERNATIVES_WARNING.replace("'", "''") + "' END], lambda x: x IS NOT NULL) FROM rich r LEFT JOIN n_years n ON r.req_id = n.req_id"),
    ("spoken", "SELECT m.req_id, h.conflict, h.n_results, x.stages, x.warnings, (m.rule = 'patterns')::INT::VARCHAR || m.rule AS k, CASE WHEN h.conflict THEN m.conflicting AND (m.rule = 'patterns')::INT::VARCHAR || m.rule = min(CASE WHEN m.conflicting THEN (m.rule = 'patterns')::INT::VARCHAR || m.rule END) OVER (PARTITION BY m.req_id) WHEN h.n_results = 0 THEN m.rule = 'patterns' ELSE m.meaningful END AS picked FROM marked m JOIN head h ON m.req_id = h.req_id JOIN texts x ON m.req_id = x.req_id AND m.rule = x.rule"),
    ("spoken_all", "SELECT req_id, count(*) AS n, flatten(list(stages ORDER BY k)) AS stages, flatten(list(warnings ORDER BY k)) AS warnings FROM spoken WHERE picked GROUP BY req_id"),
    ("cand_fields", "SELECT f.*, m.scope, h.n_results, (f.status <> 'NEEDS_CONTEXT' AND m.status <> 'NEEDS_CONTEXT') AS applicable FROM allfields f JOIN marked m ON f.req_id = m.req_id AND f.rule = m.rule JOIN head h ON f.req_id = h.req_id WHERE NOT h.conflict"),
    ("chosen_fields", "SELECT * FROM (SELECT *, bool_or(applicable) OVER (PARTITION BY req_id, code) AS any_applicable FROM cand_fields) WHERE applicable OR NOT any_applicable"),
    ("merged0", "SELECT req_id, code, list_sort(list_distinct(flatten(list(vals)))) AS sorted, any_value(vals) AS own, bool_or(status = 'UNKNOWN') AS unknown, bool_or(any_applicable) AS applicable, max(n_results) AS n_results, any_value(status) AS one_status FROM chosen_fields GROUP BY req_id, code"),
    ("merged", "SELECT req_id, code, CASE WHEN n_results = 1 THEN one_status WHEN len(sorted) > 1 THEN 'AMBIGUOUS' WHEN unknown THEN 'UNKNOWN' WHEN applicable THEN 'KNOWN' ELSE 'NEEDS_CONTEXT' END AS status, CASE WHEN n_results = 1 THEN own ELSE sorted END AS vals FROM merged0"),
    ("details", "SELECT h.req_id, CASE WHEN h.conflict THEN 'CONTEXT_CONFLICT' WHEN n_results = 0 THEN coalesce(pattern_status, 'UNKNOWN') WHEN n_results = 1 THEN one_status WHEN EXISTS (SELECT 1 FROM merged m WHERE m.req_id = h.req_id AND m.status = 'KNOWN') THEN 'DECODED' ELSE 'NEEDS_CONTEXT' END AS status, CASE WHEN h.conflict THEN conflict_scope WHEN len(scopes) > 1 THEN 'MULTIPLE' ELSE coalesce(scopes[1], 'US') END AS scope FROM head h"),
    ("appr", "SELECT p.req_id, a.approval_id, a.source_row, a.fields FROM prep p JOIN t_approvals a ON p.structure = 'MODERN_FORMAT' AND substr(p.normalized, 1, 3) = a.wmi AND len(list_filter(a.masks, lambda m: regexp_full_match(p.normalized, m))) > 0"),
    ("appr_fields", "SELECT req_id, unnest(map_keys(fields)) AS code, unnest(map_values(fields)) AS value FROM appr"),
    ("parts", r"SELECT row, category, list_transform(string_split(template, ' / '), lambda m: trim(m, ' ')) AS parts FROM t_masks"),
    ("ok_masks", "SELECT row, category, CASE WHEN len(list_filter(parts, lambda m: NOT regexp_full_match(m, '[A-HJ-NPR-Z0-9]{3}[A-HJ-NPR-Z0-9.]{14}') OR length(replace(m, '.', '')) < 4)) = 0 THEN list_sort(list_distinct(parts)) END AS masks FROM parts"),
    ("marques", f"SELECT f.req_id, a.make_id FROM found f LEFT JOIN t_make_aliases a ON a.alias = translate(trim(coalesce(f.brand, '')), '{_LOWER}', '{_UPPER}') WHERE f.assignment_id IS NOT NULL"),
    ("marks", "SELECT req_id, coalesce(string_agg(DISTINCT make_id, '|' ORDER BY make_id), '') AS ids, count(DISTINCT make_id) AS n, bool_or(make_id IS NULL) AS unmapped, count(*) AS labels FROM marques GROUP BY req_id"),
    ("export", "SELECT *, concat_ws('|', CASE WHEN NOT regexp_full_match(wmi, '[A-HJ-NPR-Z0-9]{3}([A-HJ-NPR-Z0-9]{3})?') THEN 'INVALID_WMI' END, CASE WHEN try_cast(substr(available, 1, 10) AS DATE) IS NULL THEN 'NO_AVAILABILITY_DATE' END, CASE WHEN try_cast(substr(available, 1, 10) AS DATE) > DATE '2026-09-30' THEN 'FUTURE_AVAILABILITY_DATE' END) AS reasons FROM t_wmi_rows"),
    ("dir_c", "SELECT c_custkey % 1000 AS wmi, 'NATION ' || c_nationkey AS name FROM customer"),
    ("dir_s", "SELECT s_suppkey % 1000 AS wmi, 'NATION ' || s_nationkey AS name FROM supplier"),
    ("dir_n", "SELECT * FROM (SELECT wmi, string_agg(DISTINCT name, '|' ORDER BY name) AS listed FROM dir_c GROUP BY wmi) FULL JOIN (SELECT wmi, string_agg(DISTINCT name, '|' ORDER BY name) AS assigned FROM dir_s GROUP BY wmi) USING (wmi)"),
    ("o_prefix", "SELECT *, '1H' || CASE WHEN k % 9 = 0 THEN '9' WHEN k % 50 = 1 THEN 'I' ELSE 'G' END || 'AAAA' || lpad(k::VARCHAR, 3, '0') AS prefix FROM (SELECT *, o_custkey % 500 AS k FROM orders)"),
    ("probes0", "SELECT prefix, k, o_orderkey, o_orderpriority, CASE WHEN k % 5 = 0 AND o_orderkey % 11 = 0 THEN 'UNKNOWN' WHEN k % 5 = 1 THEN 'AMBIGUOUS' ELSE 'KNOWN' END AS status FROM o_prefix WHERE k % 9 <> 0 AND k % 50 <> 1"),
    ("probes", "SELECT prefix, status, CASE WHEN status = 'KNOWN' AND k % 7 <> 3 THEN CASE WHEN k % 3 = 0 THEN upper(o_orderpriority) ELSE 'GOLF' END END AS value FROM probes0"),
    ("consensus", "SELECT prefix, CASE WHEN count(DISTINCT value) > 1 THEN 'PROBE_DISAGREEMENT' WHEN count(DISTINCT status) > 1 THEN 'PROBE_INCOMPLETE' WHEN min(status) <> 'KNOWN' THEN min(status) WHEN count(value) > 0 THEN 'KNOWN' ELSE 'PROBE_INCOMPLETE' END AS status, min(value) AS v FROM probes GROUP BY prefix"),
    ("labels_", "SELECT prefix, k % 4 AS m, count(*) AS weight, list(DISTINCT CASE WHEN k % 4 = 0 THEN o_orderstatus WHEN k % 4 = 1 THEN 'GOLF' ELSE 'GOLF VII' END) AS labels FROM o_prefix GROUP BY ALL"),
    ("judged", "SELECT l.*, CASE WHEN len(labels) <> 1 THEN 'SOURCE_CONFLICT' ELSE coalesce(c.status, 'UNSUPPORTED_PREFIX') END AS status, c.v FROM labels_ l LEFT JOIN consensus c USING (prefix)"),
    ("judged_m", "SELECT *, coalesce(status = 'KNOWN' AND v = labels[1], FALSE) AS exact_match, coalesce(status = 'KNOWN' AND (v = labels[1] OR m = 2 AND labels[1] = 'GOLF VII' AND v = 'GOLF'), FALSE) AS alias_match FROM judged"),
    ("directory", "SELECT c_custkey // 50 AS page, c_custkey % 50 + 1 AS row, upper(substr(md5(c_custkey::VARCHAR), 1, 2)) || CASE WHEN c_custkey % 6 = 0 THEN '9' WHEN c_custkey % 7 = 0 THEN 'O' ELSE 'A' END AS part1, CASE WHEN c_custkey % 12 = 0 THEN upper(substr(md5(c_name), 1, 3)) ELSE '' END AS part2, c_name AS name FROM customer"),
]


def _status(n: str, missing: str, known: str) -> str:
    return f"CASE WHEN {n} > 1 THEN 'AMBIGUOUS' WHEN {missing} OR {n} = 0 OR {known} = 'UNKNOWN' THEN 'UNKNOWN' WHEN {known} = 'KNOWN' THEN 'RESOLVED' WHEN {known} = 'NEEDS_CONTEXT' THEN 'SUGGESTED' ELSE {known} END"


def _why(missing: str, status: str, reason: str) -> str:
    return f"CASE WHEN {missing} THEN 'UNMAPPED_IDENTITY' WHEN {status} = 'AMBIGUOUS' THEN 'COMPETING_IDENTITIES' ELSE '{reason}' END"


def _key(label: str) -> str:
    return f"translate(trim(coalesce({label}, '')), '{_LOWER}', '{_UPPER}')"


def _changed(name: str, when: str, status: str, identity: str, value: str, reason: str) -> str:
    """The four columns of a primary field, new where `when` holds."""
    new = {f"{name}_status": status, f"{name}_id": identity, name: value, f"{name}_reason": reason}
    return "* REPLACE (" + ", ".join(f"CASE WHEN {when} THEN {v} ELSE {c} END AS {c}" for c, v in new.items()) + ")"


def _group(of: str, identity: str) -> str:
    return f"count(DISTINCT {of}.{identity}) AS n, bool_or({of}.{identity} IS NULL) AS un, min({of}.{identity}) AS id, min({of}.name) AS nm"


def _taken(name: str, when: str, g: str, known: str, reason: str) -> str:
    s = _status(f"{g}n", f"{g}un", known)
    held = f"({s}) IN ('RESOLVED', 'SUGGESTED')"
    return _changed(name, f"({when})", s, f"CASE WHEN {held} THEN {g}id END", f"CASE WHEN {held} THEN {g}nm END", _why(f"{g}un" if name in ("make", "model") else "false", f"({s})", reason))


_SUGGESTED = {n: f"CASE WHEN {n}_status = 'SUGGESTED' AND {n}_reason = 'SCOPED_VIN_RULE' THEN '{n}' END" for n in P.PRIMARY}
_RULED = f"list_filter([{', '.join(_SUGGESTED.values())}], lambda x: x IS NOT NULL)"

_CHAIN += [
    ("code_makes", f"SELECT f.req_id, {_group('a', 'make_id')} FROM codes_f f LEFT JOIN t_make_aliases a ON a.alias = {_key('f.manufacturer')} WHERE f.source_object_id IS NOT NULL GROUP BY f.req_id"),
    ("code_models", f"SELECT f.req_id, {_group('a', 'model_id')} FROM codes_f f JOIN code_makes k ON f.req_id = k.req_id AND k.n = 1 AND NOT k.un LEFT JOIN t_model_aliases a ON a.make_id = k.id AND a.alias = {_key('f.trade_name')} WHERE f.source_object_id IS NOT NULL GROUP BY f.req_id"),
    ("said", "SELECT req_id, code, status, unnest(vals) AS v FROM merged"),
    ("rich_make", f"SELECT s.req_id, s.status AS k, {_group('a', 'make_id')} FROM said s LEFT JOIN t_make_aliases a ON a.alias = {_key('s.v')} WHERE s.code = 'Make' GROUP BY s.req_id, s.status"),
    *[(f"rich_{t}", f"SELECT req_id, status AS k, count(DISTINCT try_cast(v AS INTEGER)) AS n, bool_or(try_cast(v AS INTEGER) IS NULL) AS un, NULL::VARCHAR AS id, min(try_cast(v AS INTEGER))::VARCHAR AS nm FROM said WHERE code = '{c}' GROUP BY req_id, status") for t, c in (("year", "ModelYear"), ("built", "ProductionYear"))],
    ("wmi_make", "SELECT m.req_id, count(DISTINCT m.make_id) AS n, bool_or(m.make_id IS NULL) AS un, min(m.make_id) AS id, min(a.name) AS nm FROM marques m LEFT JOIN (SELECT DISTINCT make_id, name FROM t_make_aliases) a ON m.make_id = a.make_id GROUP BY m.req_id"),
    ("appr_make", f"SELECT p.req_id, {_group('a', 'make_id')} FROM appr p LEFT JOIN t_make_aliases a ON a.alias = {_key("map_extract(p.fields, 'make')[1]")} GROUP BY p.req_id"),
    ("start_", "SELECT p.req_id, p.structure, p.model_year, p.market, t.status AS rich_status, t.scope, r.brand_status, " + ", ".join(f"g{i}.k AS {n}_k, g{i}.n AS {n}_n, g{i}.un AS {n}_un, g{i}.id AS {n}_gid, g{i}.nm AS {n}_nm" for i, n in ((0, "mk"), (2, "yr"), (3, "pr"))) + ", w.n AS w_n, w.un AS w_un, w.id AS w_id, w.nm AS w_nm, m.n AS a_n, m.un AS a_un, m.id AS a_id, m.nm AS a_nm, " + ", ".join(f"'UNKNOWN' AS {n}_status, NULL::VARCHAR AS {n}_id, NULL::VARCHAR AS {n}, 'NO_EVIDENCE' AS {n}_reason" for n in P.PRIMARY) + " FROM prep p LEFT JOIN details t ON p.req_id = t.req_id LEFT JOIN resolution r ON p.req_id = r.req_id LEFT JOIN rich_make g0 ON p.req_id = g0.req_id LEFT JOIN rich_year g2 ON p.req_id = g2.req_id LEFT JOIN rich_built g3 ON p.req_id = g3.req_id LEFT JOIN wmi_make w ON p.req_id = w.req_id LEFT JOIN appr_make m ON p.req_id = m.req_id"),
    *[(f"d_{i}", "SELECT " + _taken(n, f"structure = 'MODERN_FORMAT' AND {g}_k IS NOT NULL", f"{g}_", f"{g}_k", "SCOPED_VIN_RULE").replace(f"{g}_id", f"{g}_gid") + f" FROM {of}") for i, n, g, of in (("make", "make", "mk", "start_"), ("year", "modelYear", "yr", "d_make"), ("built", "productionYear", "pr", "d_year"))],
    ("rich_model", f"SELECT s.req_id, s.status AS k, {_group('a', 'model_id')} FROM said s JOIN d_make d ON s.req_id = d.req_id LEFT JOIN t_model_aliases a ON a.make_id = d.make_id AND a.alias = {_key('s.v')} WHERE s.code = 'Model' GROUP BY s.req_id, s.status"),
    ("d_model", "SELECT " + _taken("model", "structure = 'MODERN_FORMAT' AND mo_k IS NOT NULL", "mo_", "mo_k", "SCOPED_VIN_RULE").replace("mo_id", "mo_gid") + " FROM (SELECT d.*, g.k AS mo_k, g.n AS mo_n, g.un AS mo_un, g.id AS mo_gid, g.nm AS mo_nm FROM d_built d LEFT JOIN rich_model g ON d.req_id = g.req_id)"),
    ("d_wmi", "SELECT " + _taken("make", "structure = 'MODERN_FORMAT' AND make_status <> 'RESOLVED' AND w_n IS NOT NULL AND (mk_k IS NULL OR (make_status = 'UNKNOWN' AND brand_status = 'KNOWN'))", "w_", "brand_status", "WMI_ASSIGNMENT") + " FROM d_model"),
    ("d_agreed", "SELECT " + _taken("make", "make_status = 'SUGGESTED' AND brand_status = 'KNOWN' AND w_n = 1 AND NOT w_un AND w_id = make_id", "w_", "'KNOWN'", "WMI_ASSIGNMENT") + " FROM d_wmi"),
    ("d_conflict", "SELECT *, (make_status = 'SUGGESTED' AND NOT (" + " OR ".join(f"({n}_status = 'SUGGESTED' AND {g}_k IS NOT NULL)" for n, g in zip(P.PRIMARY, ("mk", "mo", "yr", "pr"))) + ")) AS unconfirmed, coalesce(structure = 'MODERN_FORMAT' AND rich_status = 'CONTEXT_CONFLICT' AND (scope <> 'US' OR market IS NOT DISTINCT FROM 'US'), false) AS conflict FROM d_agreed"),
    *[(f"d_c{i}", "SELECT " + _changed(n, "conflict", "'CONFLICT'", "NULL", "NULL", "'CALLER_CONTEXT_CONFLICT'") + f" FROM {of}") for i, n, of in ((1, "model", "d_conflict"), (2, "modelYear", "d_c1"))],
    ("d_am0", "SELECT " + _changed("make", "(make_status = 'SUGGESTED' AND a_n IS NOT NULL AND NOT a_un AND (a_n > 1 OR a_id <> make_id))", "'AMBIGUOUS'", "NULL", "NULL", "'COMPETING_CONDITIONAL_SOURCES'") + " FROM (SELECT *, make_status AS was_make FROM d_c2)"),
    ("d_am", "SELECT *, (was_make = 'UNKNOWN' AND a_n IS NOT NULL AND make_status = 'SUGGESTED') AS cat_make, (a_n = 1 AND NOT a_un AND a_id = make_id AND NOT conflict) AS may FROM (SELECT " + _taken("make", "was_make = 'UNKNOWN' AND a_n IS NOT NULL", "a_", "'NEEDS_CONTEXT'", "CATALOGUE_CONSENSUS") + " FROM d_am0)"),
    ("appr_model", f"SELECT p.req_id, {_group('a', 'model_id')} FROM appr p JOIN d_am d ON p.req_id = d.req_id LEFT JOIN t_model_aliases a ON a.make_id = d.make_id AND a.alias = {_key("map_extract(p.fields, 'type')[1]")} GROUP BY p.req_id"),
    ("d_ao0", "SELECT " + _changed("model", "(coalesce(may, false) AND model_status = 'SUGGESTED' AND NOT b_un AND (b_n > 1 OR b_gid <> model_id))", "'AMBIGUOUS'", "NULL", "NULL", "'COMPETING_CONDITIONAL_SOURCES'") + " FROM (SELECT d.*, d.model_status AS was_model, g.n AS b_n, g.un AS b_un, g.id AS b_gid, g.nm AS b_nm FROM d_am d LEFT JOIN appr_model g ON d.req_id = g.req_id)"),
    ("d_ao", "SELECT *, (coalesce(may, false) AND was_model = 'UNKNOWN' AND model_status = 'SUGGESTED') AS cat_model FROM (SELECT " + _taken("model", "coalesce(may, false) AND was_model = 'UNKNOWN'", "b_", "'NEEDS_CONTEXT'", "CATALOGUE_CONSENSUS").replace("b_id", "b_gid") + " FROM d_ao0)"),
    ("d_8", "SELECT " + _changed("model", "(make_id IS NULL AND model_id IS NOT NULL)", "'AMBIGUOUS'", "NULL", "NULL", "'PRIMARY_MAKE_UNRESOLVED'") + " FROM d_ao"),
    ("d_9", "SELECT " + _changed("modelYear", "(model_status IN ('AMBIGUOUS', 'CONFLICT') AND modelYear_status = 'SUGGESTED')", "'UNKNOWN'", "NULL", "NULL", "'IDENTITY_APPLICABILITY_UNRESOLVED'") + " FROM d_8"),
    ("d_given", "SELECT *, (structure = 'MODERN_FORMAT' AND model_year IS NOT NULL AND NOT conflict) AS given, coalesce(structure = 'MODERN_FORMAT' AND model_year IS NOT NULL AND NOT conflict AND modelYear <> model_year::VARCHAR, false) AS clash FROM d_9"),
    ("d_10", "SELECT " + _changed("modelYear", "clash", "'CONFLICT'", "NULL", "NULL", "'CALLER_CONTEXT_CONFLICT'") + " FROM d_given"),
    ("d_11", "SELECT " + _changed("modelYear", "(given AND NOT clash)", "'PROVIDED'", "NULL", "model_year::VARCHAR", "'CALLER_CONTEXT'") + " FROM d_10"),
    ("decided", f"SELECT *, {_RULED} AS ruled, list_filter([CASE WHEN cat_make AND make_status = 'SUGGESTED' THEN 'make' END, CASE WHEN cat_model AND model_status = 'SUGGESTED' THEN 'model' END], lambda x: x IS NOT NULL) AS catalogued FROM d_11"),
    ("used", "SELECT DISTINCT u.req_id, m.field, u.source_id FROM (SELECT f.req_id, e.code, 'patterns' AS source_id FROM facts f JOIN t_elements e ON f.element_id = e.element_id UNION ALL SELECT req_id, code, source_id FROM held WHERE NOT conflict) u JOIN (VALUES " + ", ".join(f"('{c}', '{n}')" for n, c in P.PRIMARY.items()) + ") m(code, field) ON u.code = m.code"),
    ("paths", "SELECT req_id, source_id, unnest(CASE WHEN v IS NULL THEN ['/fieldStatus/' || field] WHEN field IN ('make', 'model') THEN ['/vehicle/' || field, '/vehicle/' || field || 'Id'] ELSE ['/vehicle/' || field] END) AS path FROM (SELECT u.*, CASE field " + " ".join(f"WHEN '{n}' THEN d.{n}" for n in P.PRIMARY) + " END AS v FROM used u JOIN decided d ON u.req_id = d.req_id)"),
]


def _summary(by: str, weight: str) -> str:
    some = lambda c: f"coalesce(sum({weight}) FILTER ({c}), 0)::BIGINT"
    e, k, x, a = some("status NOT IN ('SOURCE_CONFLICT', 'UNSUPPORTED_PREFIX')"), some("status = 'KNOWN'"), some("exact_match"), some("alias_match")
    share = lambda n, d: f"round({n}::DOUBLE / nullif({d}, 0), 6)"
    return f"SELECT {by}, sum({weight})::BIGINT AS total, {e} AS eligible, {k} AS known, {x} AS exact_matches, {a} AS alias_matches, {share(k, e)} AS coverage, {share(x, k)} AS exact_precision, {share(a, k)} AS alias_precision FROM judged_m GROUP BY 1"


_SELECTS: dict[str, str] = {
    "vin_normalize_structure": "SELECT req_id, normalized, structure FROM prep",
    "type_code_validity": "SELECT req_id, norm_hsn, norm_tsn, input_status FROM codes_v",
    "wmi_key_lookup_path": "SELECT req_id, wmi FROM keyed",
    "wmi_key_rich_path": "SELECT req_id, wmi, key AS pattern_key FROM richkey",
    "wmi_candidates": "SELECT req_id, assignment_id, manufacturer, country, established FROM found WHERE assignment_id IS NOT NULL",
    "wmi_resolution": "SELECT req_id, n_candidates, status, brand_status, brand, brand_possibilities, manufacturer_status, manufacturer, category_status, category, country_status, country FROM resolution",
    "type_code_lookup": "SELECT req_id, input_status, n_candidates, CASE WHEN input_status <> 'VALID' THEN 'INVALID_INPUT' WHEN n_candidates = 0 THEN 'UNKNOWN' WHEN n_candidates = 1 THEN 'RECOGNIZED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n_candidates = 1 THEN one END AS trade_name FROM codes_g",
    "year_candidates": "SELECT req_id, wmi, year FROM years",
    "pattern_matches": "SELECT req_id, year, element_id, pattern_id, priority, kind, value FROM direct",
    "pattern_top1": "SELECT req_id, year, element_id, value, rule_id, place FROM chosen_direct",
    "pattern_fields": "SELECT req_id, element_id, status, possibilities, CASE WHEN status = 'KNOWN' THEN vals[1] END AS value FROM pfields",
    "formula_capture": "SELECT req_id, year, element_id, rule_id, value FROM direct WHERE kind = 'NUMERIC_PATTERN'",
    "engine_relation": "SELECT req_id, year, element_id, value, rule_id, priority FROM engine",
    "model_make": "SELECT req_id, year, value, attribute_id, kind, rule_id FROM made_direct WHERE element_id = 26",
    "unit_conversion": "SELECT req_id, year, element_id, value, rule_id FROM facts WHERE kind = 'UNIT_CONVERSION'",
    "literal_rules": "SELECT req_id, rule, scope, status FROM results WHERE rule <> 'patterns'",
    "literal_fields": "SELECT req_id, rule, code, status, array_to_string(vals, '|') AS possibilities, CASE WHEN status = 'KNOWN' THEN vals[1] END AS value FROM lfields",
    "merged_fields": "SELECT req_id, code, status, array_to_string(vals, '|') AS possibilities, CASE WHEN status = 'KNOWN' THEN vals[1] END AS value FROM merged",
    "details_status": "SELECT req_id, status, scope FROM details",
    "approval_masks": "SELECT req_id, approval_id, source_row FROM appr",
    "approval_fields": "SELECT req_id, code, string_agg(DISTINCT value, '|' ORDER BY value) AS possibilities FROM appr_fields WHERE value <> '' AND code <> 'remarks' GROUP BY req_id, code",
    "approval_status": "SELECT p.req_id, CASE WHEN any_value(p.structure) <> 'MODERN_FORMAT' THEN 'INVALID_INPUT' WHEN count(a.approval_id) > 0 THEN 'CANDIDATES' ELSE 'NO_MATCH' END AS status, count(a.approval_id) AS n_candidates FROM prep p LEFT JOIN appr a ON p.req_id = a.req_id GROUP BY p.req_id",
    "template_validation": "SELECT row, array_to_string(masks, '|') AS masks, (coalesce(category IN ('M1', 'M1G'), false) AND masks IS NOT NULL) AS accepted FROM ok_masks",
    "identity_consensus": "SELECT req_id, ids, unmapped, labels, CASE WHEN n > 1 THEN 'AMBIGUOUS' WHEN unmapped OR n = 0 THEN 'UNKNOWN' ELSE 'RESOLVED' END AS status FROM marks",
    "decision_status": "SELECT req_id, make_status, make, make_reason, make_id, model_status, model, model_reason, model_id, modelYear_status, modelYear, modelYear_reason, productionYear_status, productionYear, concat_ws('|', CASE WHEN unconfirmed AND make_status = 'SUGGESTED' THEN 'MATCH_CONSTRAINTS_UNCONFIRMED:make' END, CASE WHEN len(catalogued) > 0 THEN 'CATALOGUE_MEMBERSHIP_UNCONFIRMED:' || array_to_string(catalogued, ',') END, CASE WHEN len(ruled) > 0 THEN CASE WHEN market IS NULL AND k.markets = ['US'] THEN 'US_MARKET_ASSUMED:' ELSE 'CROSS_MARKET_MATCH[' || array_to_string(k.markets, ',') || ']:' END || array_to_string(ruled, ',') END) AS assumptions FROM decided LEFT JOIN (SELECT d.req_id AS k_req, list_sort(list(DISTINCT c.scope)) AS markets FROM decided d JOIN chosen_fields c ON c.req_id = d.req_id JOIN (VALUES " + ", ".join(f"('{c}', '{n}')" for n, c in P.PRIMARY.items()) + ") m(code, name) ON m.code = c.code WHERE list_contains(d.ruled, m.name) GROUP BY 1) k ON k.k_req = decided.req_id",
    "source_credits": "SELECT p.req_id, p.source_id, string_agg(DISTINCT p.path, '|' ORDER BY p.path) AS paths, any_value(coalesce(s.terms_url, s.license_url, s.reuse_url)) AS terms FROM paths p LEFT JOIN t_sources s ON p.source_id = s.id GROUP BY p.req_id, p.source_id",
    "code_decision": "SELECT g.req_id, g.input_status, " + _status("coalesce(k.n, 0)", "coalesce(k.un, true)", "'KNOWN'") + " AS make_status, CASE WHEN k.n = 1 AND NOT k.un THEN k.nm END AS make, CASE WHEN k.n = 1 AND NOT k.un THEN k.id END AS make_id, CASE WHEN k.n IS NULL THEN CASE WHEN g.input_status = 'VALID' THEN 'NO_TYPE_CODE_MATCH' ELSE 'NO_EVIDENCE' END WHEN k.un THEN 'UNMAPPED_IDENTITY' WHEN k.n > 1 THEN 'COMPETING_IDENTITIES' ELSE 'TYPE_CODE_LOOKUP' END AS make_reason, " + _status("coalesce(m.n, 0)", "coalesce(m.un, true)", "'KNOWN'") + " AS model_status, CASE WHEN m.n = 1 AND NOT m.un THEN m.nm END AS model, CASE WHEN m.n = 1 AND NOT m.un THEN m.id END AS model_id, CASE WHEN m.n IS NULL THEN CASE WHEN g.input_status = 'VALID' AND g.n_candidates = 0 THEN 'NO_TYPE_CODE_MATCH' ELSE 'NO_EVIDENCE' END WHEN m.un THEN 'UNMAPPED_IDENTITY' WHEN m.n > 1 THEN 'COMPETING_IDENTITIES' ELSE 'TYPE_CODE_LOOKUP' END AS model_reason FROM codes_g g LEFT JOIN code_makes k ON g.req_id = k.req_id LEFT JOIN code_models m ON g.req_id = m.req_id",
    "constraint_overlaps": "SELECT a.wmi, a.id AS id_a, b.id AS id_b FROM t_assignments a JOIN t_assignments b ON a.wmi = b.wmi AND a.id < b.id AND greatest(coalesce(a.from_year, 1886), coalesce(b.from_year, 1886)) <= least(coalesce(a.to_year, 9999), coalesce(b.to_year, 9999)) AND (len(a.markets) = 0 OR len(b.markets) = 0 OR list_has_any(a.markets, b.markets)) AND coalesce(a.ambiguity_group <> b.ambiguity_group, true)",
    "orphan_references": "SELECT 'order' AS reference, count(*) AS n, count(DISTINCT l_orderkey) AS n_keys FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) HAVING count(*) > 0 UNION ALL SELECT 'part', count(*), count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) HAVING count(*) > 0",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "wmi_export_filter": "SELECT wmi, reasons FROM export",
    "assignment_etl": "SELECT w.wmi, m.manufacturer_name AS manufacturer, upper(trim(regexp_replace(k.make_name, '\\s+', ' ', 'g'))) AS brand, v.type_name AS category FROM export w JOIN t_dump_manufacturers m ON w.manufacturer_id = m.manufacturer_id LEFT JOIN t_vehicle_types v ON w.type_id = v.type_id LEFT JOIN t_wmi_makes x ON w.wmi_id = x.wmi_id LEFT JOIN t_makes k ON x.make_id = k.make_id WHERE w.reasons = ''",
    "directory_comparison": "SELECT wmi, CASE WHEN assigned IS NULL THEN 'DIRECTORY_ONLY' WHEN listed IS NULL THEN 'ASSIGNED_ONLY' WHEN listed = assigned THEN 'SAME' ELSE 'DIFFERENT_NAMES' END AS relation, coalesce(listed, assigned) AS names FROM dir_n",
    "directory_counts": "SELECT count(*) AS wmis, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (h > 1) AS multi_hsn, count(*) FILTER (m > 1) AS multi_name FROM (SELECT c_custkey % 1000, count(*) AS n, count(DISTINCT c_mktsegment) AS h, count(DISTINCT c_nationkey) AS m FROM customer GROUP BY 1)",
    "inventory_difference": "SELECT wmi, CASE WHEN assigned IS NULL THEN 'a' ELSE 'b' END AS side FROM dir_n WHERE listed IS NULL OR assigned IS NULL",
    "probe_consensus": "SELECT prefix, status, CASE WHEN status = 'KNOWN' THEN v END AS value FROM consensus",
    "coverage_summary": _summary("'label' AS field", "1"),
    "coverage_weighted": _summary("CASE WHEN len(labels) = 1 THEN labels[1] ELSE 'SOURCE_CONFLICT' END AS make", "weight"),
    "top_mismatches": f"SELECT * FROM (SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= {P.MISMATCHES}",
    "systematic_sample": "SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS nth FROM orders) WHERE nth % 31 = 0",
    "details_messages": "SELECT req_id, array_to_string(list_filter(stages, lambda x, i: list_position(stages, x) = i), '|') AS stages, array_to_string(list_filter(warnings, lambda x, i: list_position(warnings, x) = i AND (n = 1 OR x <> '')), '|') AS warnings FROM spoken_all",
    "dump_table": "SELECT p_partkey::VARCHAR AS id, p_name || chr(9) || chr(92) AS name, CASE WHEN p_size > 9 THEN p_brand END AS brand FROM part",
    "dump_inventory": "SELECT 'part' AS table, 3 AS n_columns, count(*) AS n_rows FROM part UNION ALL SELECT 'nation', 2, count(*) FROM nation",
    "null_marked_text": "SELECT p_partkey::VARCHAR AS p_partkey, p_name, CASE WHEN p_size > 9 THEN p_brand END AS p_brand, '' AS empty FROM part",
    "pattern_shards": "SELECT (p_partkey % 256)::INT AS schema_bucket, p_partkey::INT AS schema_id, p_size::INT AS pattern_id FROM part",
    "approval_shards": "SELECT DISTINCT substr(m, 1, 3) AS wmi, approval_id, source_row FROM (SELECT unnest(masks) AS m, approval_id, source_row FROM t_approvals)",
    "folder_manifest": "SELECT 'b' AS folder, 'UNEXPECTED' AS problem UNION ALL SELECT 'c', 'MISSING'",
    "set_relations": "SELECT count(*) FILTER (a AND b) AS n_both, count(*) FILTER (NOT b) AS only_a, count(*) FILTER (NOT a) AS only_b, count(*) FILTER (NOT a OR NOT b) = 0 AS equal, count(*) FILTER (NOT b) = 0 AS a_within_b FROM (SELECT x.k IS NOT NULL AS a, y.k IS NOT NULL AS b FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) x FULL JOIN (SELECT DISTINCT p_partkey AS k FROM part) y ON x.k = y.k)",
    "ordered_types": "SELECT hsn, tsn, source_object_id, row_number() OVER (ORDER BY hsn, tsn, source_object_id) - 1 AS place FROM t_types",
    "first_prefixes": "SELECT prefix, sum(weight)::BIGINT AS weight FROM labels_ GROUP BY prefix ORDER BY prefix LIMIT 20",
    "model_alias_precedence": "SELECT p_brand AS make_id, upper(trim(substr(p_name, 1, 4))) AS alias, min('m' || lpad(p_partkey::VARCHAR, 8, '0')) AS model_id FROM part GROUP BY 1, 2",
    "drift_guard": "SELECT o.n AS old_rows, w.n AS new_rows, round(w.n / o.n, 6) AS ratio, round(w.x - o.x, 6) AS exclusion_change, (w.n / o.n BETWEEN 0.95 AND 1.5 AND w.x - o.x <= 0.01) AS ok FROM (SELECT count(*) AS n, avg((c_acctbal < 0)::INT::DOUBLE) AS x FROM customer) o, (SELECT count(*) AS n, avg((s_acctbal < 0)::INT::DOUBLE) AS x FROM supplier) w",
    "coverage_matches": "SELECT prefix, weight, status, exact_match, alias_match FROM judged_m",
    "target_coverage": "SELECT t.target, count(p.id) AS approvals, count(p.id) > 0 AS covered, coalesce(array_to_string(list_slice(list(p.id ORDER BY p.id) FILTER (p.id IS NOT NULL), 1, 3), '|'), '') AS examples FROM t_targets t LEFT JOIN (SELECT 'p' || lpad(p_partkey::VARCHAR, 8, '0') AS id, p_brand, p_name FROM part) p ON list_contains(t.makes, p.p_brand) AND CASE WHEN t.case_sensitive THEN regexp_matches(p.p_name, t.include) ELSE regexp_matches(p.p_name, t.include, 'i') END AND NOT coalesce(t.exclude <> '' AND regexp_matches(p.p_name, t.exclude, 'i'), FALSE) GROUP BY t.target",
    "directory_rules": "SELECT printf('sv31-p%03d-r%03d', page, row) AS rule_id, part1 || part2 AS identifier, CASE WHEN part2 = '' THEN part1 || '.{14}' ELSE part1 || '.{8}' || part2 || '.{3}' END AS pattern, name FROM directory WHERE regexp_full_match(part1, '[A-HJ-NPR-Z0-9]{3}') AND (part1[3] = '9') = (part2 <> '')",
    "directory_pages": "SELECT page, count(*) AS n_rows, 0::BIGINT AS n_gaps FROM directory GROUP BY page",
    "latest_editions": "SELECT source, edition::VARCHAR AS edition, max(o_orderkey) AS locator FROM (SELECT o_orderpriority AS source, max(o_orderdate::DATE) AS edition FROM orders GROUP BY 1) JOIN orders ON o_orderpriority = source AND o_orderdate::DATE = edition GROUP BY 1, 2",
    "public_schemas": f"SELECT s_name AS wmi, l_partkey AS schema_id, count(*) AS n, min(year(l_shipdate))::INT AS year_from, max(CASE WHEN l_returnflag <> 'N' THEN year(l_shipdate) + 1 ELSE {P.OPEN_END} END)::INT AS year_to FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_acctbal >= 0 AND p_size >= 10 GROUP BY 1, 2",
    "resolved_values": "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN s_name ELSE l_quantity::BIGINT::VARCHAR END AS value FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey * 2",
    "preferences": "SELECT n_nationkey AS wmi, CASE WHEN n_regionkey = 1 THEN 'x ' ELSE 's ' END || n_nationkey AS name, n_name AS brand, (n_regionkey <> 1 AND n_nationkey IN (SELECT s_nationkey FROM supplier) AND coalesce(n = 1, FALSE)) AS ok FROM nation LEFT JOIN (SELECT c_custkey % 400 AS k, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1) ON k = n_nationkey AND k >= 5",
    "document_urls": r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), 'https?://[^\s<>"'')\]]+'), lambda u: regexp_replace(u, '[.,;:]+$', '')), ' ') AS urls FROM documents""",
    "encoded_cells": "SELECT p_partkey, base64(encode(p_name)) AS cell, p_name AS name FROM part",
}


def sql(select: str) -> str:
    """A query after the part of the chain that it needs."""
    import re

    needed: set[str] = set()
    parts = dict(_CHAIN)

    def need(text: str) -> None:
        for word in set(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in parts and word not in needed:
                needed.add(word)
                need(parts[word])

    need(select)
    chain = ",\n".join(f"{name} AS {'MATERIALIZED ' if not name.startswith('t_') else ''}({text})" for name, text in _CHAIN if name in needed)
    return f"WITH {chain}\n{select}" if needed else select


ORACLES = {name: sql(select) for name, select in _SELECTS.items()}
