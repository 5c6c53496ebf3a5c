"""DuckDB SQL for the registered entity-resolution queries, over the same tables."""

from __future__ import annotations

from kinforge.functions.text import ANALYSIS_SUFFIXES, MULTI_WORD_SUFFIXES, NAME_STOPWORDS, SUFFIXES
from kinforge.operators.blocking import GENERIC_ADDRESS, PASSES, STAGES
from kinforge.operators.errors import DIAGNOSTIC_GENERIC, GENERIC_NAMES
from kinforge.operators.evaluate import THRESHOLDS
from kinforge.operators.features import FEATURES


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(words) -> str:
    return "(" + "|".join(words) + ")"


def _std(c: str) -> str:
    folded = rf"regexp_replace(strip_accents({c}), '[^\x00-\x7F]', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace(replace(lower({folded}), '&', ' and '), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _distinct(x: str) -> str:
    """Distinct members in the order in which they first occur."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def _grams(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) WHEN length({x}) <= 3 THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3))) END"


WITH = {}


def _digit(h: str, i: int) -> str:
    return f"(strpos('0123456789abcdef', substr({h}, {i}, 1)) - 1)"


def _word(h: str, start: int, n: int) -> str:
    return f"translate(substr({h}, {start}, {n}), '0123456789abcdef', 'aeioubcdfglmnrst')"


WITH["biz"] = f"""SELECT c_custkey AS k, b, lower(n_name) AS home, {_word('b', 1, 6)} AS w1,
  {_word("md5('w' || CASE WHEN lot < 6 THEN '0' ELSE CAST(c_custkey % 2048 AS VARCHAR) END)", 1, 5)} AS w2,
  CASE WHEN lot BETWEEN 58 AND 63 THEN 'harbour' ELSE {_word('b', 9, 6)} END AS street,
  CASE WHEN lot BETWEEN 58 AND 63 THEN 'quayside' ELSE {_word("md5('l' || CAST(c_custkey % 211 AS VARCHAR))", 1, 7)} END AS place,
  CASE WHEN lot BETWEEN 58 AND 63 THEN 100 ELSE c_custkey * 37 % 900 + 100 END AS num, ' ' || CAST(10000 + c_custkey * 13 % 89999 AS VARCHAR) AS tail
  FROM (SELECT *, 16 * {_digit('b', 20)} + {_digit('b', 21)} AS lot FROM (SELECT *, md5(CAST(c_custkey AS VARCHAR)) AS b FROM customer)) JOIN nation ON n_nationkey = CASE WHEN lot < 64 THEN 0 ELSE c_nationkey END"""
WITH["rec"] = f"""SELECT biz.*, s, c, md5(k || ':' || s || ':' || c) AS h, num || ' ' || street || ' Street, ' || place || tail AS whole
  FROM biz, (VALUES (1, 0), (2, 0), (2, 1), (3, 0), (3, 1)) v(s, c)
  WHERE s = 1 OR ({_digit("md5(k || ':' || s)", 1)} >= 2 AND c = 0) OR {_digit("md5(k || ':' || s)", 1)} = 15"""
WITH["ent"] = f"""SELECT 'S' || s || '-' || (2 * k + c) AS entity_id, k AS business,
  CASE WHEN s = 1 THEN w1 || ' ' || w2 ELSE CASE {_digit('h', 1)} WHEN 8 THEN w1 WHEN 9 THEN w2 || ' ' || w1 WHEN 10 THEN w1[1:2] || w1[4:] || ' ' || w2 WHEN 11 THEN upper(w1) || '  ' || w2
    WHEN 12 THEN '-- ' || w1 || ' ' || w2 WHEN 13 THEN replace(w1, 'e', 'é') || ' ' || w2 WHEN 14 THEN w1[1:3] || ' ' || w2 WHEN 15 THEN w1 || w2 ELSE w1 || ' ' || w2 END END
    || [' Inc.', ' LLC', ' Pvt. Ltd.', ' & Co', ''][CASE WHEN s = 1 OR {_digit('h', 2)} < 10 THEN {_digit('b', 23)} ELSE {_digit('h', 2)} END % 5 + 1] AS business_name,
  CASE WHEN s = 1 THEN whole ELSE CASE {_digit('h', 3)} WHEN 0 THEN '' WHEN 9 THEN num || ' ' || street || ' St ' || place || tail WHEN 10 THEN num || ' ' || street || ' Street, ' || place
    WHEN 11 THEN (num + 1) || ' ' || street || ' Street, ' || place || tail WHEN 12 THEN 'Unit 4, ' || whole WHEN 13 THEN place || tail WHEN 14 THEN upper(whole)
    WHEN 15 THEN num || ' ' || street[1:1] || street[3:] || ' Street, ' || place || tail ELSE whole END END AS business_address,
  CASE WHEN s <> 1 AND {_digit('h', 4)} % 4 = 0 THEN ' ' || upper(home) ELSE home END AS country FROM rec"""
WITH["s0"] = f"SELECT entity_id, business_name AS raw_name, business_address AS raw_address, lower(trim(country)) AS country, {_std('business_name')} AS n0, {_std('business_address')} AS norm_address FROM ent"
WITH["s1m"] = f"SELECT *, coalesce(list_filter({_list(MULTI_WORD_SUFFIXES)}, lambda m: ends_with(n0, ' ' || m))[1], '') AS tail FROM s0"
WITH["s1w"] = f"SELECT *, string_split(CASE WHEN tail = '' THEN n0 ELSE left(n0, length(n0) - length(tail) - 1) END, ' ') AS w FROM s1m"
WITH["s1i"] = f"SELECT *, list_transform(w, lambda t: NOT list_contains({_list(SUFFIXES)}, t)) AS own FROM s1w"
WITH["s1h"] = "SELECT *, list_slice(w, CASE WHEN list_contains(own, true) THEN list_position(own, true) ELSE len(w) END, len(w)) AS head FROM s1i"
WITH["s1n"] = f"SELECT *, array_to_string(list_slice(head, 1, greatest(1, coalesce(list_max(list_filter(range(1, len(head) + 1), lambda i: NOT list_contains({_list(SUFFIXES)}, head[i]))), 1))), ' ') AS n1 FROM s1h"
WITH["s2n"] = f"SELECT *, CASE WHEN len(string_split(n1, ' ')) > 2 THEN array_to_string(list_filter(string_split(n1, ' '), lambda t: NOT list_contains({_list(SUFFIXES)}, t)), ' ') ELSE n1 END AS norm_name FROM s1n"
WITH["nrm"] = f"""SELECT entity_id, raw_name, raw_address, country, norm_name, norm_address,
  list_filter(string_split(norm_name, ' '), lambda t: length(t) >= 2) AS name_tokens, list_filter(string_split(norm_address, ' '), lambda t: length(t) >= 2) AS addr_tokens,
  {_grams('norm_name')} AS name_3grams, {_grams('norm_address')} AS addr_3grams FROM s2n"""
_NUM = "(regexp_matches(t, '^[0-9]+$') OR (regexp_matches(t, '[0-9]') AND regexp_matches(t, '[a-z]')))"
WITH["tok"] = f"""SELECT entity_id, substr(entity_id, 1, 2) AS source, country AS c, norm_name, norm_address,
  list_filter(name_tokens, lambda t: NOT list_contains({_list(NAME_STOPWORDS)}, t)) AS nt,
  list_filter(addr_tokens, lambda t: length(t) >= 4) AS a4, list_filter(addr_tokens, lambda t: {_NUM}) AS nums,
  list_filter(addr_tokens, lambda t: length(t) >= 3 AND NOT {_NUM} AND NOT list_contains({_list(GENERIC_ADDRESS)}, t)) AS loc,
  list_filter(addr_tokens, lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT list_contains({_list(GENERIC_ADDRESS)}, t)) AS dis FROM nrm"""
WITH["tok2"] = f"SELECT *, ({_distinct('nums')})[1:2] AS num2, ({_distinct('loc')})[1:3] AS loc3, ({_distinct('dis')})[1:4] AS dis4 FROM tok"
WITH["kall"] = """SELECT entity_id, source, 0 AS pass, norm_name || '___' || c AS key FROM tok2 WHERE norm_name <> ''
  UNION ALL SELECT entity_id, source, 1, unnest(list_distinct(list_transform(list_filter(nt, lambda t: length(t) >= 3), lambda t: 'tok_' || t || '___' || c))) FROM tok2
  UNION ALL SELECT entity_id, source, 2, 'pref_' || substr(norm_name, 1, 4) || '___' || c FROM tok2 WHERE length(norm_name) >= 4
  UNION ALL SELECT entity_id, source, 3, unnest(list_distinct(flatten(list_transform(nt[1:2], lambda n: list_transform(a4[1:3], lambda a: 'na_' || n || '___' || a))))) FROM tok2
  UNION ALL SELECT entity_id, source, 4, unnest(list_distinct(flatten(list_transform(num2, lambda n: list_transform(loc3, lambda a: 'b5_num_' || n || '_' || a || '___' || c))))) FROM tok2
  UNION ALL SELECT entity_id, source, 5, unnest(list_distinct(flatten(list_transform(dis4, lambda x: list_transform(list_filter(dis4, lambda y: y > x), lambda y: 'b5_pair_' || x || '_' || y || '___' || c))))) FROM tok2"""
WITH["post"] = "SELECT * FROM kall WHERE source <> 'S1'"
WITH["kc"] = "SELECT source, pass, key, count(*) AS n FROM post GROUP BY ALL"
for _name, _b2, _b5 in (("", 5000, 500), ("_low", 20, 20)):
    WITH[f"gone{_name}"] = f"SELECT source, pass, key, n FROM kc WHERE (pass = 1 AND n > {_b2}) OR (pass >= 4 AND n > {_b5})"
    WITH[f"kept{_name}"] = f"SELECT p.* FROM post p ANTI JOIN gone{_name} USING (source, pass, key)"
    WITH[f"pairs{_name}"] = f"SELECT q.entity_id AS s1_id, p.entity_id AS cand_id, p.source, bit_or(1 << p.pass) AS pass_mask FROM kall q JOIN kept{_name} p USING (pass, key) WHERE q.source = 'S1' GROUP BY ALL"
WITH["links"] = "SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM ent a JOIN ent b USING (business) WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%'"
WITH["ids"] = "SELECT DISTINCT entity_id AS s1_id FROM ent WHERE entity_id LIKE 'S1-%'"
WITH["split"] = "SELECT s1_id, CASE WHEN row_number() OVER (ORDER BY md5(s1_id || ':42')) <= floor((SELECT count(*) FROM ids) * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM ids"
WITH["duo"] = "SELECT p.s1_id, p.cand_id, x, y FROM pairs p JOIN nrm x ON x.entity_id = p.s1_id JOIN nrm y ON y.entity_id = p.cand_id"


def _ratio(a, b, value):
    return f"CASE WHEN {a} = 0 AND {b} = 0 THEN 1.0::DOUBLE WHEN {a} = 0 OR {b} = 0 THEN 0.0::DOUBLE ELSE {value} END"


def _jac(x, y):
    both = f"len(list_intersect({x}, {y}))"
    return _ratio(f"len({x})", f"len({y})", f"{both}::DOUBLE / (len({x}) + len({y}) - {both})")


def _jac0(x, y):
    both = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN len({x}) + len({y}) - {both} = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / (len({x}) + len({y}) - {both}) END"


def _dice(x, y):
    return _ratio(f"len({x})", f"len({y})", f"2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y}))")


def _over(x, y):
    return _ratio(f"len({x})", f"len({y})", f"len(list_intersect({x}, {y}))::DOUBLE / least(len({x}), len({y}))")


def _flag(c):
    return f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _d(side, f):
    return f"list_distinct({side}.{f})"


def _numbers(side):
    return f"list_distinct(list_filter({side}.addr_tokens, lambda t: regexp_matches(t, '^[0-9]+$')))"


_LEV = _ratio("length(x.norm_name)", "length(y.norm_name)", "1.0::DOUBLE - levenshtein(x.norm_name, y.norm_name)::DOUBLE / greatest(length(x.norm_name), length(y.norm_name))")
_WORDS, _PLACES = (_d("x", "name_tokens"), _d("y", "name_tokens")), (_d("x", "addr_tokens"), _d("y", "addr_tokens"))
_EXACT, _ADDR = "x.norm_name <> '' AND x.norm_name = y.norm_name", "x.norm_address <> '' AND x.norm_address = y.norm_address"
_COUNTRY = "x.country <> '' AND x.country = y.country"


def _jaro_winkler(a, b):
    """Greedy matches within the window, first free place first; half transpositions; up to four letters of common prefix."""
    window = f"greatest(greatest(length({a}), length({b})) // 2 - 1, 0)"
    free = f"list_filter(range(greatest(e.p - {window}, 1), least(e.p + {window}, length({b})) + 1), lambda j: substr({b}, j, 1) = e.c AND NOT list_contains(m.t, j))"
    letters = f"list_transform(range(1, length({a}) + 1), lambda i: {{'c': substr({a}, i, 1), 'p': i, 't': CAST([] AS BIGINT[])}})"
    matched = f"list_reduce({letters}, lambda m, e: CASE WHEN len({free}) = 0 THEN m ELSE {{'c': m.c || e.c, 'p': e.p, 't': list_append(m.t, ({free})[1])}} END, {{'c': '', 'p': CAST(0 AS BIGINT), 't': CAST([] AS BIGINT[])}})"
    k, moved = "length(g.c)", f"len(list_filter(range(1, length(g.c) + 1), lambda i: substr(g.c, i, 1) <> substr({b}, list_sort(g.t)[i], 1))) / 2.0::DOUBLE"
    jaro = f"(({k}::DOUBLE / length({a}) + {k}::DOUBLE / length({b}) + ({k} - {moved}) / {k}) / 3.0::DOUBLE)"
    same = " + ".join(f"CASE WHEN length({a}) >= {i} AND length({b}) >= {i} AND substr({a}, 1, {i}) = substr({b}, 1, {i}) THEN 1 ELSE 0 END" for i in range(1, 5))
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE list_transform([{matched}], lambda g: CASE WHEN {k} = 0 THEN 0.0::DOUBLE ELSE {jaro} + ({same}) * 0.1::DOUBLE * (1.0::DOUBLE - {jaro}) END)[1] END"


_JW = _jaro_winkler("x.norm_name", "y.norm_name")
FEATURE_SQL = dict(
    zip(
        FEATURES,
        (
            _flag(_EXACT), _jac(*_WORDS), _dice(*_WORDS), _over(*_WORDS), _jac("x.name_3grams", "y.name_3grams"), _JW, _LEV, _flag("coalesce(x.name_tokens[1], '') <> '' AND x.name_tokens[1] = y.name_tokens[1]"),
            "CASE WHEN greatest(length(x.norm_name), length(y.norm_name)) > 0 THEN least(length(x.norm_name), length(y.norm_name))::DOUBLE / greatest(length(x.norm_name), length(y.norm_name)) ELSE 1.0::DOUBLE END", "abs(length(x.norm_name) - length(y.norm_name))::DOUBLE",
            _flag("x.norm_name = ''"), _flag("y.norm_name = ''"), _flag(_ADDR), _jac(*_PLACES), _over(*_PLACES), _jac("x.addr_3grams", "y.addr_3grams"), _over(_numbers("x"), _numbers("y")), "abs(length(x.norm_address) - length(y.norm_address))::DOUBLE",
            _flag("x.norm_address = ''"), _flag("y.norm_address = ''"), _flag("x.norm_address = '' AND y.norm_address = ''"), _flag(f"({_EXACT}) AND ({_ADDR})"), _flag(_COUNTRY), _flag("y.entity_id LIKE 'S2-%'"), _flag("y.entity_id LIKE 'S3-%'"),
        ),
        strict=True,
    )
)
WITH["scored"] = f"""SELECT p.s1_id, p.cand_id, p.source, CASE WHEN l.s1_id IS NULL THEN 0 ELSE 1 END AS label,
  CASE WHEN {_EXACT} AND {_COUNTRY} THEN 1.0::DOUBLE WHEN NOT ({_EXACT}) AND {_jac(*_WORDS)} >= 0.80 AND {_COUNTRY} THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM pairs p JOIN nrm x ON x.entity_id = p.s1_id JOIN nrm y ON y.entity_id = p.cand_id LEFT JOIN links l ON l.s1_id = p.s1_id AND l.cand_id = p.cand_id"""
WITH["sweep"] = f"""SELECT threshold, s1_id, count(*) FILTER (score >= threshold AND t) AS tp, count(*) FILTER (score >= threshold AND NOT t) AS fp, count(*) FILTER (NOT coalesce(score >= threshold, false) AND t) AS fn
  FROM (SELECT coalesce(s.s1_id, l.s1_id) AS s1_id, score, l.s1_id IS NOT NULL AS t FROM scored s FULL JOIN links l ON s.s1_id = l.s1_id AND s.cand_id = l.cand_id), (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in sorted({*THRESHOLDS, 0.5}))}]) AS threshold) GROUP BY ALL"""
WITH["swept"] = """SELECT threshold, sum(tp) AS s1_tp, sum(fp) AS s1_fp, sum(fn) AS s1_fn, count(*) FILTER (fp > 0 OR fn > 0) AS wrong FROM sweep GROUP BY threshold"""
_P, _R = "(CASE WHEN s1_tp + s1_fp = 0 THEN 0.0::DOUBLE ELSE s1_tp::DOUBLE / (s1_tp + s1_fp) END)", "(CASE WHEN s1_tp + s1_fn = 0 THEN 0.0::DOUBLE ELSE s1_tp::DOUBLE / (s1_tp + s1_fn) END)"


def _f(p, r, k):
    return f"CASE WHEN {k[1]}::DOUBLE * {p} + {r} = 0 THEN 0.0::DOUBLE ELSE {k[0]}::DOUBLE * {p} * {r} / ({k[1]}::DOUBLE * {p} + {r}) END"


WITH["metrics"] = f"""SELECT threshold, total_s1, CAST(s1_tp AS BIGINT) AS s1_tp, CAST(s1_fp AS BIGINT) AS s1_fp, CAST(s1_fn AS BIGINT) AS s1_fn, total_s1 - wrong AS exact, (total_s1 - wrong) * 100.0::DOUBLE / total_s1 AS exact_pct,
  {_P} AS s1_precision, {_R} AS s1_recall, {_f(_P, _R, ('1.25', '0.25'))} AS s1_f05, {_f(_P, _R, ('2.0', '1.0'))} AS s1_f1 FROM swept, (SELECT count(*) AS total_s1 FROM ids)"""
WITH["missed1"] = "SELECT l.* FROM links l ANTI JOIN (SELECT * FROM pairs WHERE pass_mask & 1 <> 0) p USING (s1_id, cand_id)"
WITH["stages"] = "SELECT unnest([" + ", ".join(f"{{'stage': '{s}', 'm': {m}}}" for s, m in ({p: 1 << i for i, p in enumerate(PASSES)} | STAGES).items()) + "]) AS st"
WITH["stg"] = "SELECT st.stage AS stage, st.m AS m FROM stages"
_ERR = f"""CASE WHEN x.norm_address = '' OR y.norm_address = '' THEN 'missing_address' WHEN x.raw_name <> y.raw_name AND x.norm_name = y.norm_name THEN 'transliteration'
  WHEN len({_WORDS[0]}) > 0 AND len({_WORDS[1]}) > 0 AND (list_has_all({_WORDS[0]}, {_WORDS[1]}) OR list_has_all({_WORDS[1]}, {_WORDS[0]})) THEN 'legal_suffix'
  WHEN len({_WORDS[0]}) > 0 AND len({_WORDS[1]}) > 0 AND (starts_with(x.name_tokens[1], y.name_tokens[1]) OR starts_with(y.name_tokens[1], x.name_tokens[1])) AND x.name_tokens[1] <> y.name_tokens[1] THEN 'abbreviation'
  WHEN {_jac0('x.name_3grams', 'y.name_3grams')} >= 0.70 AND {_jac0(*_PLACES)} < 0.20 THEN 'address_conflict' WHEN {_jac0('x.name_3grams', 'y.name_3grams')} >= 0.75 THEN 'spelling_typo'
  WHEN length(x.norm_name) < 12 OR length(y.norm_name) < 12 THEN 'generic_name' ELSE 'uncategorized' END"""
_INITIALS = "array_to_string(list_transform({}.name_tokens, lambda w: substr(w, 1, 1)), '')"
_LONG = [f"list_distinct(list_filter({s}.addr_tokens, lambda t: length(t) >= 3))" for s in "xy"]
_MISS = f"""CASE WHEN x.country <> y.country THEN 'country-related issue' WHEN x.raw_name <> y.raw_name AND x.norm_name = y.norm_name THEN 'transliteration'
  WHEN len({_WORDS[0]}) > 0 AND list_has_all({_WORDS[0]}, {_WORDS[1]}) AND list_has_all({_WORDS[1]}, {_WORDS[0]}) AND x.name_tokens <> y.name_tokens THEN 'word-order variation'
  WHEN len({_WORDS[0]}) > 0 AND len({_WORDS[1]}) > 0 AND (((starts_with(x.name_tokens[1], y.name_tokens[1]) OR starts_with(y.name_tokens[1], x.name_tokens[1])) AND x.name_tokens[1] <> y.name_tokens[1])
    OR list_contains(y.name_tokens, {_INITIALS.format('x')}) OR list_contains(x.name_tokens, {_INITIALS.format('y')})) THEN 'abbreviation'
  WHEN {_jac0('x.name_3grams', 'y.name_3grams')} >= 0.65 THEN 'typo' WHEN len(list_intersect({_WORDS[0]}, {_list(GENERIC_NAMES)})) > 0 AND (len({_WORDS[0]}) <= 2 OR len({_WORDS[1]}) <= 2) THEN 'generic name'
  WHEN x.norm_address = '' OR y.norm_address = '' THEN 'missing address' WHEN {_jac0(*_LONG)} >= 0.40 THEN 'address variation' WHEN len(list_intersect({_WORDS[0]}, {_WORDS[1]})) = 0 THEN 'exact/name normalization failure' ELSE 'unknown' END"""
WITH["wrong"] = f"""SELECT s.s1_id, s.cand_id, s.score, CASE WHEN s.score >= 0.5 THEN 'fp' ELSE 'fn' END AS kind, {_ERR} AS category
  FROM scored s JOIN nrm x ON x.entity_id = s.s1_id JOIN nrm y ON y.entity_id = s.cand_id WHERE (s.score >= 0.5) <> (s.label = 1)"""
WITH["df"] = "SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(addr_tokens)) AS token FROM nrm WHERE entity_id NOT LIKE 'S1-%') GROUP BY token"
WITH["shared"] = f"""SELECT s1_id, cand_id, token, coalesce(df, 0) AS df, regexp_matches(token, '^[0-9]+$') AND length(token) IN (5, 6) AS postal, regexp_matches(token, '^[0-9]+$') AND length(token) NOT IN (5, 6) AS building,
  length(token) >= 3 AND NOT list_contains({_list(DIAGNOSTIC_GENERIC)}, token) AS distinctive, length(token) >= 3 AND NOT list_contains({_list(DIAGNOSTIC_GENERIC)}, token) AND coalesce(df, 0) <= 100 AS rare
  FROM (SELECT m.s1_id, m.cand_id, unnest(list_intersect(x.addr_tokens, y.addr_tokens)) AS token FROM missed1 m JOIN nrm x ON x.entity_id = m.s1_id JOIN nrm y ON y.entity_id = m.cand_id) LEFT JOIN df USING (token)"""
_AP = "(^| )(pvt ltd|private limited)$"
WITH["an"] = f"SELECT entity_id, country, business_name, CASE WHEN regexp_matches(n0, '{_AP}') THEN regexp_replace(n0, '{_AP}', '') ELSE regexp_replace(n0, '(^| ){_any(ANALYSIS_SUFFIXES)}$', '') END AS norm, n0 FROM ent JOIN (SELECT entity_id, n0 FROM s0) USING (entity_id)"
WITH["lc"] = "SELECT i.s1_id, count(l.cand_id) AS k, count(*) FILTER (cand_id LIKE 'S2-%') AS s2_links, count(*) FILTER (cand_id LIKE 'S3-%') AS s3_links FROM ids i LEFT JOIN links l USING (s1_id) GROUP BY ALL"


def sql(body: str) -> str:
    """The body with all the common tables that it needs, directly or not."""
    import re

    needed, todo = set(), [body]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in WITH:
            if name in words and name not in needed:
                needed.add(name)
                todo.append(WITH[name])
    head = ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in WITH.items() if n in needed)
    return f"WITH {head}\n{body}"


def _blocks(key, name, table="an"):
    return f"""SELECT '{name}' AS strategy, count(*) AS blocks, min(size) AS min_size, max(size) AS max_size, round(avg(size), 2) AS mean_size, median(size) AS median_size,
  list_sort(list(size))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95_size, list_sort(list(size))[CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99_size,
  count(*) FILTER (size > 100) AS over_100, count(*) FILTER (size > 500) AS over_500, count(*) FILTER (size > 1000) AS over_1000 FROM (SELECT {key} AS key, count(*) AS size FROM {table} GROUP BY 1)"""


def _tokens(words):
    return f"""SELECT token, n, round(n * 100.0::DOUBLE / total, 2) AS pct FROM (SELECT token, count(*) AS n FROM (SELECT unnest({words}) AS token FROM ent JOIN s0 USING (entity_id)) WHERE length(token) > 2 GROUP BY token ORDER BY n DESC, token LIMIT 10), (SELECT count(*) AS total FROM ent)"""


_PASS = "[" + ", ".join(f"'{p}'" for p in PASSES) + "][pass + 1]"
_WORDSET = f"list_distinct(list_filter(string_split(n0, ' '), lambda t: length(t) >= 2 AND NOT list_contains({_list(ANALYSIS_SUFFIXES)}, t)))"
_LENGTHS = ", ".join(f"min(length(trim({c}))) AS {n}_min, max(length(trim({c}))) AS {n}_max, round(avg(length(trim({c}))), 2) AS {n}_mean, median(length(trim({c}))) AS {n}_median" for c, n in (("business_name", "name"), ("business_address", "addr")))
_PP = ("(CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END)", "(CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END)")

_BODIES = {
    "entity_view": "SELECT entity_id, business_name, business_address, country FROM ent",
    "norm_names": "SELECT entity_id, norm_name FROM nrm",
    "norm_addresses": "SELECT entity_id, norm_address, country FROM nrm",
    "name_tokens": "SELECT entity_id, generate_subscripts(name_tokens, 1) - 1 AS pos, unnest(name_tokens) AS token FROM nrm",
    "name_tokens_without_stopwords": "SELECT entity_id, unnest(list_filter(nt, lambda t: length(t) >= 3)) AS token FROM tok",
    "addr_tokens": "SELECT entity_id, generate_subscripts(addr_tokens, 1) - 1 AS pos, unnest(addr_tokens) AS token FROM nrm",
    "postal_codes": f"SELECT entity_id, coalesce(list_filter(string_split({_std(chr(39) + chr(39) + ' || business_address || ' + chr(39) + ' ' + chr(39) + ' || string_split(entity_id, ' + chr(39) + '-' + chr(39) + ')[2] || ' + chr(39) + '0000' + chr(39))}, ' '), lambda t: regexp_matches(t, '^([0-9]{{5}}|[0-9]{{6}})$'))[1], '') AS postal FROM ent",
    "analysis_norm": "SELECT entity_id, norm FROM an",
    "entity_profile": f"""SELECT count(*) AS rows, count(*) FILTER (trim(entity_id) = '') AS missing_entity_id, count(*) FILTER (trim(business_name) = '') AS missing_business_name, count(*) FILTER (trim(business_address) = '') AS missing_business_address, count(*) FILTER (trim(country) = '') AS missing_country,
      count(DISTINCT entity_id) AS unique_ids, count(DISTINCT lower(trim(business_name))) AS unique_names, count(DISTINCT trim(country)) AS countries, {_LENGTHS}, count(*) - count(DISTINCT entity_id) AS duplicate_ids, count(*) - count(DISTINCT lower(trim(business_name))) AS duplicate_names FROM ent""",
    "name_top5": "SELECT lower(trim(business_name)) AS name, count(*) AS n FROM ent GROUP BY 1 ORDER BY n DESC, name LIMIT 5",
    "country_dist": "SELECT trim(country) AS country, count(*) AS n FROM ent GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "gt_links": "SELECT s1_id, cand_id FROM links",
    "gt_profile": "SELECT count(*) AS entities, count(*) FILTER (k = 0) AS zero, count(*) FILTER (k = 1) AS single, count(*) FILTER (k > 1) AS multi, round(count(*) FILTER (k = 0) * 100.0::DOUBLE / count(*), 2) AS zero_pct, round(count(*) FILTER (k = 1) * 100.0::DOUBLE / count(*), 2) AS single_pct, round(count(*) FILTER (k > 1) * 100.0::DOUBLE / count(*), 2) AS multi_pct, CAST(sum(s2_links) AS BIGINT) AS s2_links, CAST(sum(s3_links) AS BIGINT) AS s3_links, min(k) AS least, max(k) AS most, round(avg(k), 2) AS mean, median(k) AS median FROM lc",
    "match_distribution": "SELECT k, count(*) AS entities FROM lc GROUP BY k",
    "block_stats": " UNION ALL ".join((_blocks("lower(business_name)", "raw"), _blocks("norm", "norm"), _blocks("norm || '___' || lower(country)", "norm_country"))),
    "high_freq_name_tokens": _tokens(f"list_filter(string_split(n0, ' '), lambda t: NOT list_contains({_list(ANALYSIS_SUFFIXES)}, t))"),
    "high_freq_addr_tokens": _tokens("string_split(norm_address, ' ')"),
    "gt_key_alignment": f"""SELECT count(*) AS pairs, count(*) FILTER (xc = yc) AS same_country, count(*) FILTER (xr = yr) AS same_raw, count(*) FILTER (xn = yn AND xn <> '') AS same_norm, count(*) FILTER (xn = yn AND xn <> '' AND xc = yc) AS same_norm_country,
      count(*) FILTER (len(list_intersect(xw, yw)) >= 1) AS one_word, count(*) FILTER (len(list_intersect(xw, yw)) >= 2 OR (len(xw) = 1 AND len(list_intersect(xw, yw)) = 1)) AS two_words
      FROM (SELECT s1_id, cand_id, lower(trim(x.country)) AS xc, lower(trim(y.country)) AS yc, lower(trim(x.business_name)) AS xr, lower(trim(y.business_name)) AS yr, x.norm AS xn, y.norm AS yn, {_WORDSET.replace('n0', 'x.n0')} AS xw, {_WORDSET.replace('n0', 'y.n0')} AS yw FROM links JOIN an x ON x.entity_id = s1_id JOIN an y ON y.entity_id = cand_id)""",
    **{f"keys_{p}": f"SELECT entity_id, key FROM kall WHERE pass = {i}" for i, p in enumerate(PASSES)},
    **{f"cand_{p}": f"SELECT s1_id, cand_id, source FROM pairs WHERE pass_mask & {1 << i} <> 0" for i, p in enumerate(PASSES)},
    **{f"top_keys_{p}": f"SELECT source, key, n FROM kc WHERE pass = {PASSES.index(p)} QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, key) <= 10" for p in ("b3", "b4", "b5a", "b5b")},
    "postings_pruned": f"SELECT source, {_PASS} AS pass, key, entity_id FROM kept_low",
    "pruned_keys": "SELECT source, key, n FROM gone_low",
    "index_stats": "SELECT * FROM (SELECT substr(entity_id, 1, 2) AS source, count(*) AS total_indexed, count(*) FILTER (norm_address = '') AS missing_addresses, round(count(*) FILTER (norm_address = '') * 100.0::DOUBLE / count(*), 2) AS missing_address_pct FROM nrm WHERE entity_id NOT LIKE 'S1-%' GROUP BY 1) JOIN (SELECT source, "
    + ", ".join([f"count(*) FILTER (pass = {i} AND NOT g) AS {p}_unique_keys" for i, p in enumerate(PASSES)] + [f"count(*) FILTER (pass = {PASSES.index(p)} AND g) AS {p}_pruned_keys" for p in ("b2", "b5a", "b5b")] + [f"CAST(coalesce(sum(n) FILTER (pass = {PASSES.index(p)} AND NOT g), 0) AS BIGINT) AS {p}_total_postings" for p in ("b4", "b5a", "b5b")])
    + " FROM (SELECT kc.*, gone_low.key IS NOT NULL AS g FROM kc LEFT JOIN gone_low USING (source, pass, key)) GROUP BY source) USING (source)",
    "cand_cumulative": "SELECT s1_id, cand_id, source, pass_mask FROM pairs",
    "cand_pruned": "SELECT s1_id, cand_id, source, pass_mask FROM pairs_low",
    "pair_labels": "SELECT source, label, count(*) AS pairs FROM scored GROUP BY ALL",
    "recall_by_stage": """SELECT stage, total_s1, true_s2, found_s2, true_s3, found_s3, true_s2 + true_s3 AS true_all, found_s2 + found_s3 AS found_all, total_s1 - incomplete AS complete_s1,
      CASE WHEN true_s2 = 0 THEN 1.0::DOUBLE ELSE found_s2::DOUBLE / true_s2 END AS recall_s2, CASE WHEN true_s3 = 0 THEN 1.0::DOUBLE ELSE found_s3::DOUBLE / true_s3 END AS recall_s3,
      CASE WHEN true_s2 + true_s3 = 0 THEN 1.0::DOUBLE ELSE (found_s2 + found_s3)::DOUBLE / (true_s2 + true_s3) END AS recall_all, (total_s1 - incomplete) * 100.0::DOUBLE / total_s1 AS coverage_pct
      FROM (SELECT stage, count(*) FILTER (cand_id LIKE 'S2-%') AS true_s2, count(*) FILTER (cand_id LIKE 'S3-%') AS true_s3, count(*) FILTER (cand_id LIKE 'S2-%' AND hit) AS found_s2, count(*) FILTER (cand_id LIKE 'S3-%' AND hit) AS found_s3, count(DISTINCT s1_id) FILTER (NOT hit) AS incomplete
        FROM (SELECT stage, s1_id, cand_id, coalesce(pass_mask & m <> 0, false) AS hit FROM links CROSS JOIN stg LEFT JOIN pairs USING (s1_id, cand_id)) GROUP BY stage), (SELECT count(*) AS total_s1 FROM ids)""",
    "candidate_distribution": """SELECT stage, count(*) AS n, round(avg(k), 2) AS mean, median(k) AS median, min(k) AS min, max(k) AS max, list_sort(list(k))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95, list_sort(list(k))[CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99,
      round(count(*) FILTER (k = 0) * 100.0::DOUBLE / count(*), 2) AS zero_pct, round(count(*) FILTER (k > 100) * 100.0::DOUBLE / count(*), 2) AS gt_100_pct
      FROM (SELECT stage, s1_id, count(*) FILTER (pass_mask & m <> 0) AS k FROM ids CROSS JOIN stg LEFT JOIN pairs USING (s1_id) GROUP BY ALL) GROUP BY stage""",
    "missed_links": "SELECT l.* FROM links l ANTI JOIN (SELECT * FROM pairs WHERE pass_mask & 7 <> 0) p USING (s1_id, cand_id)",
    "incremental_links": "SELECT st.pass AS pass, count(p.s1_id) AS new_candidates, count(p.s1_id) FILTER (t) AS new_links FROM (SELECT unnest([" + ", ".join(f"{{'pass': '{p}', 'm': {1 << i}}}" for i, p in enumerate(PASSES)) + "]) AS st) LEFT JOIN (SELECT pairs.*, l.s1_id IS NOT NULL AS t FROM pairs LEFT JOIN links l USING (s1_id, cand_id)) p ON p.pass_mask & -p.pass_mask = st.m GROUP BY ALL",
    "sim_levenshtein": f"SELECT s1_id, cand_id, levenshtein(x.norm_name, y.norm_name) AS distance, {_LEV} AS similarity FROM duo",
    "sim_jaccard3": f"SELECT s1_id, cand_id, {_jac('x.name_3grams', 'y.name_3grams')} AS name, {_jac('x.addr_3grams', 'y.addr_3grams')} AS address FROM duo",
    "sim_dice_overlap": f"SELECT s1_id, cand_id, {_jac(*_WORDS)} AS jaccard, {_dice(*_WORDS)} AS dice, {_over(*_WORDS)} AS overlap FROM duo",
    "sim_numeric": f"SELECT s1_id, cand_id, {_over(_numbers('x'), _numbers('y'))} AS overlap FROM duo",
    "pair_features": "SELECT s1_id, cand_id, " + ", ".join(f"{q} AS {n}" for n, q in FEATURE_SQL.items() if n != "name_jaro_winkler") + " FROM duo",
    "pair_features_full": "SELECT s1_id, cand_id, " + ", ".join(f"{q} AS {n}" for n, q in FEATURE_SQL.items()) + " FROM duo",
    "sim_jaro_winkler": f"SELECT s1_id, cand_id, {_JW} AS jaro_winkler FROM duo",
    "negative_sample": "SELECT s1_id, cand_id, label FROM scored WHERE label = 1 UNION ALL SELECT s1_id, cand_id, label FROM (SELECT * FROM scored WHERE label = 0 ORDER BY md5('42:' || s1_id || ':' || cand_id) LIMIT 500)",
    "split_hash": "SELECT s1_id, split FROM split",
    "split_id_files": "SELECT s1_id AS entity_id, split FROM split",
    "split_truth": "SELECT l.* FROM links l JOIN split USING (s1_id) WHERE split = 'val'",
    "rule_best_threshold_rounded": "SELECT threshold, s1_tp, s1_fp, s1_fn FROM metrics ORDER BY round(s1_f05, 4) DESC, threshold LIMIT 1",
    "recall_percent": """SELECT stage, s2 + s3 AS true_all, f2 + f3 AS found_all, round(CASE WHEN s2 = 0 THEN 0.0::DOUBLE ELSE f2 * 100.0::DOUBLE / s2 END, 2) AS recall_s2_pct, round(CASE WHEN s3 = 0 THEN 0.0::DOUBLE ELSE f3 * 100.0::DOUBLE / s3 END, 2) AS recall_s3_pct,
      round(CASE WHEN s2 + s3 = 0 THEN 0.0::DOUBLE ELSE (f2 + f3) * 100.0::DOUBLE / (s2 + s3) END, 2) AS recall_all_pct, round((n - lost) * 100.0::DOUBLE / n, 2) AS coverage_pct
      FROM (SELECT stage, count(*) FILTER (cand_id LIKE 'S2-%') AS s2, count(*) FILTER (cand_id LIKE 'S3-%') AS s3, count(*) FILTER (cand_id LIKE 'S2-%' AND hit) AS f2, count(*) FILTER (cand_id LIKE 'S3-%' AND hit) AS f3, count(DISTINCT s1_id) FILTER (NOT hit) AS lost
        FROM (SELECT stage, s1_id, cand_id, coalesce(pass_mask & m <> 0, false) AS hit FROM links CROSS JOIN stg LEFT JOIN pairs USING (s1_id, cand_id)) GROUP BY stage), (SELECT count(*) AS n FROM ids)""",
    "normalised_store": "SELECT entity_id, norm_name, norm_address, name_tokens, addr_tokens FROM nrm WHERE entity_id IN (SELECT cand_id FROM links)",
    "raw_lookup": "SELECT p.s1_id, p.cand_id, e.business_name, e.business_address FROM pairs p JOIN ent e ON e.entity_id = p.cand_id WHERE pass_mask & 1 <> 0",
    "frequent_postal_codes": f"SELECT postal, count(*) AS n FROM (SELECT list_filter(string_split({_std('business_address')}, ' '), lambda t: regexp_matches(t, '^([0-9]{{5}}|[0-9]{{6}})$'))[1] AS postal FROM ent) WHERE postal IS NOT NULL GROUP BY postal ORDER BY n DESC, postal LIMIT 10",
    "tsv_entities": "SELECT entity_id, trim(business_name) AS business_name, trim(business_address) AS business_address, trim(country) AS country FROM ent",
    "tsv_entities_raw": "SELECT entity_id, CASE WHEN business_name LIKE '%\"%' THEN '\"' || replace(trim(business_name), '\"', '\"\"') || '\"' ELSE trim(business_name) END AS business_name, CASE WHEN business_address = '' THEN '\"\"' ELSE trim(business_address) END AS business_address, trim(country) AS country FROM ent WHERE entity_id IN (SELECT cand_id FROM links)",
    "tsv_ground_truth": "SELECT s1_id, cand_id FROM links",
    "matches_by_source": "SELECT s1_id, CAST(s2_links AS INTEGER) AS s2_links, CAST(s3_links AS INTEGER) AS s3_links FROM lc",
    "entity_tables": "SELECT source, c AS column, count(*) AS rows, count(*) FILTER (v = '') AS blank, round(count(*) FILTER (v = '') * 100.0::DOUBLE / count(*), 2) AS blank_pct, count(DISTINCT v) FILTER (v <> '') AS distinct_values, CAST(max(length(v)) AS INTEGER) AS longest FROM (SELECT substr(entity_id, 1, 2) AS source, unnest(['business_name', 'business_address', 'country']) AS c, trim(unnest([business_name, business_address, country])) AS v FROM ent) GROUP BY ALL",
    "rule_scores": "SELECT s1_id, cand_id, score FROM scored WHERE score > 0",
    "rule_pairwise_metrics": f"SELECT tp, fp, fn, tn, {_PP[0]} AS precision, {_PP[1]} AS recall, {_f(*_PP, ('1.25', '0.25'))} AS f05, {_f(*_PP, ('2.0', '1.0'))} AS f1 FROM (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM scored)",
    "rule_threshold_sweep": "SELECT * FROM metrics",
    "rule_s1_metrics": "SELECT * FROM metrics WHERE threshold = 0.5",
    "rule_best_threshold": "SELECT threshold, s1_tp, s1_fp, s1_fn FROM metrics ORDER BY s1_f05 DESC, threshold LIMIT 1",
    "cardinality_breakdown": "SELECT g AS group, entities, exact, round(CASE WHEN entities = 0 THEN 0.0::DOUBLE ELSE exact * 100.0::DOUBLE / entities END, 2) AS exact_pct FROM (SELECT g, count(s1_id) AS entities, count(s1_id) FILTER (fp = 0 AND fn = 0) AS exact FROM (SELECT unnest(['zero', 'single', 'multi']) AS g) LEFT JOIN (SELECT i.s1_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM ids i LEFT JOIN (SELECT * FROM sweep WHERE threshold = 0.5) USING (s1_id)) e ON g = CASE WHEN tp + fn = 0 THEN 'zero' WHEN tp + fn = 1 THEN 'single' ELSE 'multi' END GROUP BY g)",
    "error_taxonomy": "SELECT * FROM wrong",
    "topk_errors_per_category": "SELECT *, row_number() OVER (PARTITION BY kind, category ORDER BY CASE WHEN kind = 'fp' THEN -score ELSE score END, s1_id, cand_id) AS rank FROM wrong QUALIFY rank <= 3",
    "missed_taxonomy": f"SELECT s1_id, cand_id, {_MISS} AS category FROM missed1 m JOIN nrm x ON x.entity_id = m.s1_id JOIN nrm y ON y.entity_id = m.cand_id",
    "addr_overlap_diagnostic": "SELECT count(*) AS missed_links, count(*) FILTER (p) AS shared_postal, count(*) FILTER (b) AS shared_building, count(*) FILTER (r) AS shared_rare, count(*) FILTER (a AND NOT (p OR b OR r)) AS only_common, count(*) FILTER (NOT a) AS no_overlap FROM (SELECT m.s1_id, m.cand_id, coalesce(bool_or(postal), false) AS p, coalesce(bool_or(building), false) AS b, coalesce(bool_or(rare), false) AS r, count(token) > 0 AS a FROM missed1 m LEFT JOIN shared USING (s1_id, cand_id) GROUP BY ALL)",
    "missed_address_tokens": "SELECT * FROM shared",
    "useful_signals": "SELECT signal, count(*) AS links FROM (SELECT token AS signal FROM shared WHERE distinctive UNION ALL SELECT 'POSTAL:' || token FROM shared WHERE postal UNION ALL SELECT 'NUM:' || token FROM shared WHERE building) GROUP BY signal ORDER BY links DESC, signal LIMIT 50",
    "split_checks": "SELECT *, overlap = 0 AND uncovered = 0 AND uncovered_truth = 0 AND train + val = total AS ok FROM (SELECT (SELECT count(*) FROM ids) AS total, (SELECT count(DISTINCT s1_id) FROM split WHERE split = 'train') AS train, (SELECT count(DISTINCT s1_id) FROM split WHERE split = 'val') AS val, (SELECT count(*) FROM (SELECT s1_id FROM split GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS overlap, (SELECT count(*) FROM ids ANTI JOIN split USING (s1_id)) AS uncovered, (SELECT count(DISTINCT s1_id) FROM links ANTI JOIN split USING (s1_id)) AS uncovered_truth)",
    "target_checks": "SELECT missing_targets, repeated_ids, missing_targets = 0 AND repeated_ids = 0 AS ok FROM (SELECT count(*) AS missing_targets FROM links WHERE cand_id NOT IN (SELECT entity_id FROM ent)), (SELECT count(*) AS repeated_ids FROM (SELECT entity_id FROM ent GROUP BY 1 HAVING count(*) > 1))",
    "smoke_ids": "SELECT s1_id FROM ids ORDER BY s1_id LIMIT 50",
    "target_subset": "SELECT entity_id, o AS ordinal FROM (SELECT *, greatest(60, (SELECT count(DISTINCT cand_id) FROM links WHERE cand_id LIKE 'S2-%')) AS target, count(*) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT entity_id, CAST(string_split(entity_id, '-')[2] AS BIGINT) AS o, entity_id IN (SELECT cand_id FROM links) AS r FROM ent WHERE entity_id LIKE 'S2-%')) WHERE r OR before < target",
    "sample_in_order": "SELECT entity_id, CAST(string_split(entity_id, '-')[2] AS BIGINT) AS ordinal FROM ent WHERE entity_id IN (SELECT s1_id FROM links) ORDER BY ordinal LIMIT 10",
}
_BODIES["index_stats_default"] = _BODIES["index_stats"].replace("gone_low", "gone")
ORACLE_SQL = {name: sql(body) for name, body in _BODIES.items()}
