"""SQL equivalents of the catalog's queries, for DuckDB on the same tables."""

from __future__ import annotations

from ..config import MU
from ..functions.chinese import MORE_SURNAMES, SURNAMES
from ..operators.scoring import log_ratio
from .adapter import ARTICLE, AUTHOR, CHINESE, MENTION

M = f"WITH {MENTION}"
MA = f"WITH {MENTION}, {AUTHOR}"
_PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_filter(string_split({_squeeze(x)}, ' '), lambda w: w <> '')"


def _join(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = '' THEN {a} ELSE {a} || '_' || {b} END)"


def _initials(words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda w: left(w, 1)), '')"


NAME_KEYS = f"""{M},
forms AS (SELECT firstname, lastname, unnest([firstname || '  ' || lastname, upper(lastname) || ', ' || firstname || '-Q Z', lastname, firstname || '-x. ' || lastname || '''s', ' ']) AS raw FROM (SELECT DISTINCT firstname, lastname FROM mention)),
parts AS (SELECT *, {_squeeze('lower(raw)')} AS plain, {_tokens('raw')} AS tok FROM forms),
more AS (SELECT *, string_split(plain, ',') AS comma, string_split(plain, ' ') AS w FROM parts)
SELECT DISTINCT raw, firstname, lastname, {_squeeze(f"translate(lower(raw), {_PUNCT}, '')")} AS norm, plain, coalesce(tok[-1], '') AS surname,
  CASE WHEN len(tok) = 0 THEN '' WHEN len(tok) = 1 THEN lower(tok[1]) ELSE lower(tok[-1]) || '_' || lower(left(tok[1], 1)) END AS surname_initial,
  CASE WHEN plain = '' THEN '' WHEN contains(plain, ',') THEN {_join("trim(comma[1])", "left(trim(coalesce(comma[2], '')), 1)")} WHEN len(w) = 1 THEN w[1] ELSE {_join('w[-1]', 'left(w[1], 1)')} END AS fini,
  CASE WHEN plain = '' THEN '' WHEN contains(plain, ',') THEN {_join("trim(comma[1])", _initials(_tokens("replace(coalesce(comma[2], ''), '-', ' ')")))} WHEN len(w) = 1 THEN w[1] ELSE {_join('w[-1]', _initials('w[1:len(w)-1]'))} END AS aini,
  trim(coalesce(lower(tok[-1]), '') || '_' || CASE WHEN len(tok) > 1 THEN left(lower(tok[1]), 1) ELSE '' END, '_') AS heuristic,
  lastname || '_' || left(firstname, 1) AS fini_parsed, lastname || '_' || left(firstname, 1) AS aini_parsed
FROM more"""

TITLES = f"WITH {ARTICLE} SELECT seq, doi, title FROM article"

_AFF = "regexp_replace(regexp_replace(regexp_replace(lower(raw), '\\buniversity\\b', 'univ', 'g'), '\\binstitute\\b', 'inst', 'g'), '\\bdepartment\\b', 'dept', 'g')"
AFFILIATIONS = f"""WITH forms AS (SELECT unnest(['University of ' || n_name, 'Department of Physics, ' || n_name || ' Institute', ' The  ' || n_name]) AS raw FROM nation)
SELECT raw, {_squeeze(f"regexp_replace({_AFF}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')")} AS norm, substr(replace(lower(raw), ' ', '_'), 1, 30) AS block,
  array_to_string(list_sort(list_distinct(list_filter(string_split({_squeeze("regexp_replace(lower(raw), '[^\\p{L}\\p{N}_\\s]', '', 'g')")}, ' '), lambda w: length(w) > 2))), ' ') AS words,
  substr(sha256(raw || '||s'), 1, 16) AS hash FROM forms"""

IDENTIFIERS = """SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS orcid, '10.1/A' || c_custkey AS doi,
  substr(md5((CASE WHEN c_custkey % 2 = 0 THEN 'https://doi.org/' ELSE 'http://dx.doi.org/' END) || '10.1/A' || c_custkey || '_' || c_custkey || '_x'), 1, 12) AS mention_id,
  CASE WHEN c_custkey % 6 = 0 THEN 'Ann Lee' WHEN c_custkey % 2 = 0 THEN 'Ann' WHEN c_custkey % 3 = 0 THEN 'Lee' ELSE 'Unknown Author' END AS full_name
FROM customer"""

SCRIPTS = f"""WITH words AS (SELECT DISTINCT unnest({_tokens("text")}) AS w FROM documents),
n AS (SELECT w, length(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS l, length(regexp_replace(w, '[^А-Яа-я]', '', 'g')) AS c, length(regexp_replace(w, '[^一-鿿]', '', 'g')) AS j FROM words)
SELECT w, CASE WHEN l + c + j = 0 THEN 'other' WHEN l / (l + c + j) > 0.7 THEN 'latin' WHEN c / (l + c + j) > 0.7 THEN 'cyrillic' WHEN j / (l + c + j) > 0.7 THEN 'cjk' ELSE 'mixed' END AS script,
  substr(sha256(w || '||salt'), 1, 16) AS hash, 1 AS tokens, length(w) AS length, regexp_matches(w, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z]\\.$') AS has_initial FROM n"""

_IN = lambda names: "(" + ",".join(f"'{x}'" for x in names) + ")"
CN_PREDICATES = f"""WITH {CHINESE},
t AS (SELECT mention_id, raw_name, {_tokens("regexp_replace(lower(raw_name), '[,.\\-''\"()]', ' ', 'g')")} AS a, {_tokens("regexp_replace(lower(raw_name), '[,.]', ' ', 'g')")} AS b, {_tokens('raw_name')} AS r FROM cn_mention),
u AS (SELECT *, a[1] IN {_IN(SURNAMES + MORE_SURNAMES)} OR a[-1] IN {_IN(SURNAMES + MORE_SURNAMES)} AS wide FROM t)
SELECT mention_id, raw_name, wide, wide AND (regexp_matches(raw_name, '\\w+-\\w+') OR (len(a) = 2 AND length(a[1]) BETWEEN 2 AND 8 AND length(a[2]) BETWEEN 2 AND 8)) AS strict,
  b[1] IN {_IN(SURNAMES)} OR b[-1] IN {_IN(SURNAMES)} AS narrow, 'cn:' || r[1] || '_' || left(r[2], 3) AS key1,
  CASE WHEN length(r[2]) < 2 THEN 'cn:' || r[2] || '_' || r[1] ELSE 'cn:' || r[2] || '_' || left(r[1], 3) END AS key2 FROM u"""

_LEV = lambda a, b: f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))) END)"


def _jaccard(a: str, b: str, empty: str) -> str:
    return f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {empty}::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"


_NAME_PAIRS = f"{M}, n AS (SELECT DISTINCT raw_name, firstname FROM mention), p AS (SELECT x.raw_name AS a, y.raw_name AS b FROM n x JOIN n y USING (firstname) WHERE x.raw_name < y.raw_name)"
NAME_SIMILARITY = f"{_NAME_PAIRS} SELECT a, b, round({_LEV('a', 'b')}, 6) AS similarity, round({_jaccard("string_split(a, ' ')", "string_split(b, ' ')", '1.0')}, 6) AS token_ratio FROM p"
JACCARD = f"{MA} SELECT mention_id, round({_jaccard('m.coauthors', 'a.coauthors', '1.0')}, 6) AS jaccard FROM mention m JOIN author a ON a.seq = m.person"

_FINI = "'fini:' || lastname || '_' || left(firstname, 1)"
_SIZES = "SELECT cluster_id, count(*) AS n, min(mention_id) AS first FROM c GROUP BY cluster_id"
FINI = f"{M}, c AS (SELECT {_FINI} AS cluster_id, mention_id FROM mention) {_SIZES}"
AINI = f"{M}, c AS (SELECT 'aini:' || lastname || '_' || left(firstname, 1) AS cluster_id, mention_id FROM mention) {_SIZES}"
_ORACLE = "c AS (SELECT CASE WHEN orcid = '' THEN 'unlabeled:' || mention_id ELSE 'orcid:' || orcid END AS cluster_id, mention_id FROM mention)"
ORACLE = f"{M}, {_ORACLE} {_SIZES}"
SUMMARY = f"{M}, c AS (SELECT {_FINI} AS cluster_id, mention_id FROM mention), s AS ({_SIZES}) SELECT count(*) AS num_clusters, sum(n)::BIGINT AS num_mentions, round(avg(n), 6) AS avg_size, count(*) FILTER (n = 1) AS singletons, max(n) AS max_size FROM s"
HEURISTIC = f"{M}, c AS (SELECT 'old_heuristic:' || min(mention_id) OVER (PARTITION BY lastname, left(firstname, 1), affiliation) AS cluster_id, mention_id FROM mention) {_SIZES}"
_GOLD = "gold AS (SELECT orcid AS cluster_id, mention_id FROM mention WHERE orcid <> '' QUALIFY count(*) OVER (PARTITION BY orcid) >= 2)"
GOLD = f"{M}, {_GOLD}, c AS (SELECT * FROM gold) {_SIZES}"
SIZE_DISTRIBUTION = f"{M}, {_ORACLE}, s AS ({_SIZES}) SELECT CASE WHEN n <= 5 THEN CAST(n AS VARCHAR) WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '21+' END AS bucket, count(*) AS clusters, sum(n)::BIGINT AS mentions FROM s GROUP BY 1"
GOLD_ROLLUP = f"{M} SELECT orcid, count(*) AS mention_count, count(DISTINCT raw_name) AS names, count(DISTINCT affiliation) AS affiliations, count(DISTINCT venue) AS venues FROM mention WHERE orcid <> '' GROUP BY orcid HAVING count(*) >= 2"
ORCID_COUNTS = f"{M} SELECT count(*) AS total, count(nullif(orcid, '')) AS with_orcid, count(DISTINCT nullif(orcid, '')) AS unique_orcids FROM mention"
SPLITS = f"{M}, o AS (SELECT DISTINCT orcid, md5(orcid || 'split') AS h FROM mention WHERE orcid <> '') SELECT orcid, CASE WHEN row_number() OVER (ORDER BY h, orcid) <= floor(count(*) OVER () * 0.3::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM o"
INIT_EVAL = f"{M} SELECT mention_id, orcid, CASE WHEN row_number() OVER (PARTITION BY orcid ORDER BY md5(mention_id), mention_id) <= greatest(1, floor(count(*) OVER (PARTITION BY orcid) * 0.5)) THEN 'init' ELSE 'eval' END AS part FROM mention WHERE orcid <> ''"

_GP = f"{M}, {_GOLD}, pred AS (SELECT {_FINI} AS cluster_id, mention_id FROM mention), g AS (SELECT cluster_id AS g, mention_id FROM gold), p AS (SELECT cluster_id AS p, mention_id FROM pred)"
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END"


def _b3(v: str) -> str:
    kind = "LEFT JOIN" if v == "v2" else "JOIN"
    pop = "j" if v == "v3" else None
    return f"""(WITH j AS (SELECT mention_id, g, p FROM g {kind} p USING (mention_id)),
  cell AS (SELECT g, p, count(*) AS both_n FROM j GROUP BY g, p),
  gs AS (SELECT g, count(*) AS n_g FROM {pop or 'g'} GROUP BY g), ps AS (SELECT p, count(*) AS n_p FROM {pop or 'p'} GROUP BY p)
  SELECT '{v}' AS variant, sum(both_n)::BIGINT AS mentions, sum(both_n * CASE WHEN p IS NULL THEN 1.0 ELSE both_n::DOUBLE / n_p END) / sum(both_n) AS precision, sum(both_n * CASE WHEN p IS NULL THEN 0.0 ELSE both_n::DOUBLE / n_g END) / sum(both_n) AS recall
  FROM cell JOIN gs USING (g) LEFT JOIN ps USING (p))"""


B_CUBED = f"{_GP} SELECT variant, mentions, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f1 FROM ({_b3('v1')} UNION ALL {_b3('v2')} UNION ALL {_b3('v3')})"


def _pairs(v: str, gold: str = "g", pred: str = "p") -> str:
    of = lambda t: "j" if v == "v3" else t
    return f"""(WITH j AS (SELECT mention_id, g, p FROM {gold} JOIN {pred} USING (mention_id))
  SELECT '{v}' AS variant, (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT FROM (SELECT count(*) AS n FROM j GROUP BY g, p)) AS tp,
    (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT FROM (SELECT count(*) AS n FROM {of(pred)} GROUP BY p)) AS pp, (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT FROM (SELECT count(*) AS n FROM {of(gold)} GROUP BY g)) AS gp)"""


_PAIR_OUT = "tp, pp - tp AS fp, gp - tp AS fn, CASE WHEN pp > 0 THEN tp::DOUBLE / pp ELSE 0 END AS precision, CASE WHEN gp > 0 THEN tp::DOUBLE / gp ELSE 0 END AS recall"
PAIRWISE = f"{_GP} SELECT variant, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f1 FROM (SELECT variant, {_PAIR_OUT} FROM ({_pairs('v1')} UNION ALL {_pairs('v2')} UNION ALL {_pairs('v3')}))"
CONFLICTS = f"{_GP}, s AS (SELECT p, count(*) AS n, count(DISTINCT g) AS k FROM p LEFT JOIN g USING (mention_id) GROUP BY p HAVING count(*) >= 2) SELECT count(*) FILTER (k > 1) AS conflicts, count(*) AS eligible, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (k > 1) / count(*) ELSE 0 END, 6) AS rate FROM s"
SUBSET = f"{_GP}, ids AS (SELECT mention_id FROM mention WHERE venue IN ('Brand#1', 'Brand#2')), g2 AS (SELECT * FROM g SEMI JOIN ids USING (mention_id)), p2 AS (SELECT * FROM p SEMI JOIN ids USING (mention_id)) SELECT tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f1 FROM (SELECT {_PAIR_OUT} FROM {_pairs('v1', 'g2', 'p2')})"

_BLOCK = lambda x: f"substr(replace(lower({x}), ' ', '_'), 1, 30)"
_NAME_KEYS = lambda name: f"'surname:' || lower(split_part({name}, ' ', -1)), 'surname_init:' || lower(split_part({name}, ' ', -1)) || '_' || lower(left({name}, 1))"
_AKEY = f"""akey AS (SELECT author_id, seq, unnest(list_distinct(list_concat(list_concat(list_filter([CASE WHEN orcid <> '' THEN 'orcid:' || orcid END, {_NAME_KEYS('canonical_name')}], lambda x: x IS NOT NULL),
  list_transform(affiliations[1:2], lambda x: 'affil:' || {_BLOCK('x')})), list_transform(journals[1:3], lambda x: 'journal:' || {_BLOCK('x')})))) AS key FROM author)"""
KEY_STATS = f"{MA}, {_AKEY}, k AS (SELECT key, count(*) AS authors FROM akey GROUP BY key) SELECT split_part(key, ':', 1) AS kind, count(*) AS keys, sum(authors)::BIGINT AS entries, max(authors) AS largest FROM k GROUP BY 1"


def _candidates(blind: bool) -> str:
    orcid = "NULL" if blind else "CASE WHEN orcid <> '' THEN 'orcid:' || orcid END"
    return f"""{MA}, {_AKEY},
capped AS (SELECT author_id, key FROM akey WHERE key NOT LIKE 'affil:%' AND key NOT LIKE 'journal:%' UNION ALL
  SELECT author_id, key FROM akey WHERE key LIKE 'affil:%' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq, author_id) <= 20),
mkey AS (SELECT mention_id, unnest(list_filter([{orcid}, {_NAME_KEYS('raw_name')}, 'affil:' || {_BLOCK('affiliation')}], lambda x: x IS NOT NULL)) AS key FROM mention),
cand AS (SELECT mention_id, author_id FROM (SELECT DISTINCT mention_id, author_id FROM mkey JOIN capped USING (key)) QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY author_id) <= 100)"""


CANDIDATES = f"{_candidates(False)} SELECT mention_id, count(*) AS n, min(author_id) AS first, max(author_id) AS last FROM cand GROUP BY mention_id"


def _bins(name: str, edges: list[tuple[str, float]]) -> str:
    return f"CASE {' '.join(f'''WHEN {name}_sim >= {v} THEN '{b}' ''' for b, v in edges)} WHEN {name}_sim > 0 THEN 'low' ELSE 'none' END AS {name}_bin"


def _compared(blind: bool, empty: str = "0.0") -> str:
    from ..config import BINS

    match = "FALSE" if blind else "m.orcid <> '' AND m.orcid = a.orcid"
    return f"""{_candidates(blind)},
pre AS (SELECT mention_id, author_id, m.person, a.seq AS author_person, {_LEV('m.raw_name', 'a.canonical_name')} AS name_sim, {match} AS orcid_match,
  {_jaccard('m.coauthors', 'a.coauthors', empty)} AS coauthor_sim, {_jaccard('list_transform([m.venue], lambda x: lower(x))', 'list_transform(a.journals, lambda x: lower(x))', empty)} AS journal_sim,
  CASE WHEN list_contains(a.affiliations, m.affiliation) THEN 1.0::DOUBLE ELSE list_max(list_transform(a.affiliations, lambda y: {_LEV('lower(m.affiliation)', 'lower(y)')})) END AS affiliation_sim
  FROM cand JOIN mention m USING (mention_id) JOIN author a USING (author_id)),
cmp AS (SELECT *, {', '.join(_bins(f, BINS[f]) for f in ('name', 'coauthor', 'journal', 'affiliation'))}, CASE WHEN orcid_match THEN 'match' ELSE 'missing' END AS orcid_bin,
  round(name_sim * 0.5::DOUBLE + coauthor_sim * 0.3::DOUBLE + journal_sim * 0.2::DOUBLE, 9) AS score FROM pre)"""


COMPARISONS = f"{_compared(False)} SELECT name_bin, orcid_bin, coauthor_bin, journal_bin, affiliation_bin, count(*) AS pairs, round(avg(name_sim), 6) AS name_sim, round(avg(coauthor_sim), 6) AS coauthor_sim, round(avg(journal_sim), 6) AS journal_sim, round(avg(affiliation_sim), 6) AS affiliation_sim FROM cmp GROUP BY ALL"
_BEST = "best AS (SELECT * FROM cmp QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, author_id) <= 1)"
BEST_MATCH = f"{_compared(True)}, {_BEST} SELECT mention_id, author_id, score FROM best"
_FS = " + ".join(f"CASE {f}_bin {' '.join(f'''WHEN '{b}' THEN {log_ratio(*mu)!r}::DOUBLE''' for b, mu in MU[f].items())} ELSE 0 END" for f in ("name", "orcid", "coauthor", "journal", "affiliation"))
BEST_FS = f"{_compared(False)} SELECT mention_id, author_id, fs AS score FROM (SELECT mention_id, author_id, round({_FS}, 9) AS fs FROM cmp) QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY fs DESC, author_id) = 1"
TOP_K = f"{_compared(True)} SELECT mention_id, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, author_id)::INTEGER AS rank, author_id, score FROM cmp QUALIFY rank <= 5"
_KIND = lambda accept, reject: f"CASE WHEN score IS NULL THEN 'new' WHEN score >= {accept} THEN 'merge' WHEN score <= {reject} THEN 'new' ELSE 'unknown' END"
DECISIONS = f"""{_compared(True)}, {_BEST}, n AS (SELECT mention_id, count(*) AS c FROM cmp GROUP BY mention_id),
d AS (SELECT mention_id, author_id, score, {_KIND(0.71171, 0.70431)} AS decision, coalesce(c, 0) AS candidate_count FROM mention LEFT JOIN best USING (mention_id) LEFT JOIN n USING (mention_id))
SELECT mention_id, decision, coalesce(score, 0) AS score, CASE WHEN decision = 'merge' THEN author_id END AS best_author_id, candidate_count FROM d"""
LEGACY = f"{_compared(True, '1.0')} SELECT mention_id, max(score) AS score, CASE WHEN max(score) >= 0.71031 THEN 'merged' ELSE 'new_author' END AS decision FROM cmp GROUP BY mention_id"


def _sweep() -> str:
    from .catalog_grid import ACCEPTS, REJECTS

    grid = ", ".join(f"({a}::DOUBLE, {r}::DOUBLE)" for a in ACCEPTS for r in REJECTS if r < a)
    variants = []
    for name, wrong, right in (("d1", "FALSE", "FALSE"), ("d2", "is_new AND there", "FALSE"), ("d3", "is_new AND there", "is_new AND NOT there")):
        variants.append(f"""SELECT '{name}' AS variant, accept, reject, count(*) AS total, count(*) FILTER (is_merge) AS merged, count(*) FILTER (is_new) AS new_n,
  count(*) FILTER ((is_merge AND same) OR ({right})) AS correct, count(*) FILTER ((is_merge AND NOT same) OR ({wrong})) AS wrong FROM met GROUP BY accept, reject""")
    return f"""{_compared(True)}, {_BEST}, grid AS (SELECT * FROM (VALUES {grid}) AS t(accept, reject)),
s AS (SELECT m.person, b.score, b.author_person, m.person % 2 = 0 AS there FROM mention m LEFT JOIN best b USING (mention_id)),
met AS (SELECT accept, reject, there, coalesce(author_person = person, FALSE) AS same, coalesce(score, -1e9) >= accept AS is_merge, coalesce(score, -1e9) < accept AND coalesce(score, -1e9) <= reject AS is_new FROM s CROSS JOIN grid),
tot AS ({' UNION ALL '.join(variants)}),
pr AS (SELECT *, CASE WHEN correct + wrong > 0 THEN correct / (correct + wrong) ELSE 0 END AS precision, correct / total AS recall FROM tot),
sweep AS (SELECT variant, accept, reject, merged, new_n AS new, total - merged - new_n AS unknown, correct, wrong, precision, recall, {_F1} AS f1 FROM pr)"""


_SWEEP = _sweep()
SWEEP = f"{_SWEEP} SELECT variant, accept, reject, merged, new, unknown, correct, wrong, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sweep"
BEST_F1 = f"{_SWEEP} SELECT accept, reject, round(f1, 6) AS f1 FROM sweep WHERE variant = 'd1' ORDER BY round(f1, 6) DESC, accept DESC, reject LIMIT 1"
PR_POINTS = f"{_SWEEP} SELECT accept, reject, round(recall, 6) AS recall, round(precision, 6) AS precision FROM sweep WHERE variant = 'd2' AND f1 > 0"
STRING_MATCH = f"""{MA}, by_name AS (SELECT canonical_name AS k, arg_max(author_id, seq) AS author_id FROM author GROUP BY 1), by_surname AS (SELECT split_part(canonical_name, ' ', -1) AS k, arg_min(author_id, seq) AS author_id FROM author GROUP BY 1),
r AS (SELECT 'name' AS baseline, person, author_id FROM mention JOIN by_name ON k = raw_name UNION ALL SELECT 'surname', person, author_id FROM mention JOIN by_surname ON k = lastname)
SELECT count(*) AS matched, count(*) FILTER (author_id = 'au_' || lpad(CAST(person AS VARCHAR), 10, '0')) AS correct, baseline FROM r GROUP BY baseline"""

_EXACT = f"""WITH {ARTICLE}, a AS (SELECT seq, nullif(doi, '') AS doi, nullif(title, '') AS title FROM article),
d AS (SELECT seq, min(seq) OVER (PARTITION BY doi) AS kept FROM a WHERE doi IS NOT NULL QUALIFY seq > kept),
t AS (SELECT seq, min(seq) OVER (PARTITION BY title) AS kept FROM a ANTI JOIN d USING (seq) WHERE title IS NOT NULL QUALIFY seq > kept),
found AS (SELECT seq, kept, 'doi' AS reason FROM d UNION ALL SELECT seq, kept, 'title' FROM t)"""
DEDUP_EXACT = f"{_EXACT} SELECT seq, kept, reason FROM found"
DEDUP_STATS = f"{_EXACT} SELECT (SELECT count(*) FROM a) AS total, (SELECT count(doi) FROM a) AS with_doi, (SELECT count(title) FROM a) AS with_title, (SELECT count(*) FROM d) AS doi_duplicates, (SELECT count(*) FROM t) AS title_duplicates"
DEDUP_TOKEN = f"WITH {ARTICLE}, t AS (SELECT DISTINCT title, list_distinct(string_split(title, ' ')) AS w FROM article WHERE title <> '') SELECT x.title AS a, y.title AS b FROM t x JOIN t y ON x.title < y.title AND {_jaccard('x.w', 'y.w', '1.0')} >= 0.8"

_AU = "'au_' || lpad(CAST(person AS VARCHAR), 10, '0')"
_EDGES = f"""{M}, pa AS (SELECT DISTINCT doi, {_AU} AS id FROM mention),
edge AS (SELECT x.id AS src, y.id AS dst, count(*) AS weight FROM pa x JOIN pa y ON x.doi = y.doi AND x.id < y.id GROUP BY 1, 2),
both_ways AS (SELECT src AS node, dst AS other, weight FROM edge UNION ALL SELECT dst, src, weight FROM edge),
deg AS (SELECT node, count(*) AS degree, sum(weight)::BIGINT AS strength FROM both_ways GROUP BY node)"""
EDGES = f"{_EDGES} SELECT src, dst, weight FROM edge"
DEGREES = f"{_EDGES} SELECT node, degree, strength FROM deg"
GRAPH_STATS = f"{_EDGES} SELECT (SELECT count(*) FROM deg) AS nodes, (SELECT count(*) FROM edge) AS edges, round(2 * (SELECT count(*) FROM edge) / (SELECT count(*) FROM deg), 6) AS avg_degree"
TOP_EDGES = f"{_EDGES} SELECT src, dst, weight FROM edge ORDER BY weight DESC, src, dst LIMIT 50"
K_HOP = f"{_EDGES}, s AS (SELECT 'au_0000000000' AS node), h1 AS (SELECT node FROM s UNION SELECT other FROM both_ways JOIN s USING (node)), h2 AS (SELECT node FROM h1 UNION SELECT other FROM both_ways JOIN h1 USING (node)) SELECT 'au_0000000000' AS start, node FROM h2"
REMOVED = f"{_EDGES} SELECT count(*) AS edges, sum(weight)::BIGINT AS weight FROM edge WHERE src NOT IN ('au_0000000000', 'au_0000000007') AND dst NOT IN ('au_0000000000', 'au_0000000007')"
AFFECTED = f"{_EDGES}, s AS (SELECT unnest(['au_0000000000', 'au_0000000001']) AS node), r AS (SELECT node FROM s UNION SELECT other FROM both_ways JOIN s USING (node)) SELECT 'p' AS pub_id, node FROM r LEFT JOIN deg USING (node) ORDER BY coalesce(strength, 0) DESC, node LIMIT 100"
COAUTHOR_IDS = f"{MA}, c AS (SELECT DISTINCT coauthors FROM mention), k AS (SELECT md5(array_to_string(coauthors, '|')) AS record_id, unnest(coauthors) AS name FROM c) SELECT record_id, count(DISTINCT author_id) AS authors FROM k JOIN author ON canonical_name = name GROUP BY record_id"


def _calibration() -> str:
    lev = lambda a, b: f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"
    name, aff, venue = lev("x.raw_name", "y.raw_name"), lev("lower(x.affiliation)", "lower(y.affiliation)"), lev("lower(x.venue)", "lower(y.venue)")
    feats = lambda p: f"""SELECT unnest([{{'feature': 'name_similarity', 'bin': CASE WHEN s >= 0.95 THEN 'exact' WHEN s >= 0.85 THEN 'high' WHEN s >= 0.7 THEN 'medium' WHEN s >= 0.5 THEN 'low' ELSE 'none' END}},
  {{'feature': 'orcid_match', 'bin': o}}, {{'feature': 'affiliation_similarity', 'bin': CASE WHEN f >= 0.95 THEN 'exact' WHEN f >= 0.7 THEN 'high' WHEN f >= 0.4 THEN 'partial' ELSE 'none' END}}, {{'feature': 'venue_similarity', 'bin': v}}]) AS x
  FROM (SELECT {name} AS s, {aff} AS f, CASE WHEN x.orcid <> '' AND x.orcid = y.orcid THEN 'exact' ELSE 'none' END AS o, CASE WHEN x.venue = y.venue THEN 'same' WHEN {venue} > 0.5 THEN 'similar' ELSE 'different' END AS v FROM {p} JOIN mention x ON x.mention_id = a JOIN mention y ON y.mention_id = b)"""  # noqa: E731
    return f"""{M}, l AS (SELECT mention_id, person, firstname, orcid, md5(mention_id) AS h FROM mention WHERE orcid <> ''),
pos AS (SELECT x.mention_id AS a, y.mention_id AS b FROM l x JOIN l y USING (orcid) WHERE x.mention_id < y.mention_id),
firsts AS (SELECT firstname, arg_min(mention_id, h) AS a FROM l GROUP BY firstname),
neg AS (SELECT f.a, l.mention_id AS b FROM l JOIN firsts f USING (firstname) JOIN mention z ON z.mention_id = f.a WHERE l.mention_id <> f.a AND l.person <> z.person),
u AS (SELECT x.feature AS feature, x.bin AS bin, 1 AS p, 0 AS q FROM ({feats('pos')}) UNION ALL SELECT x.feature, x.bin, 0, 1 FROM ({feats('neg')})),
n AS (SELECT feature, bin, sum(p) AS p, sum(q) AS q FROM u GROUP BY feature, bin)
SELECT feature, bin, round((p + 1.0::DOUBLE) / (sum(p) OVER w + 1.0::DOUBLE * count(*) OVER w), 6) AS m, round((q + 1.0::DOUBLE) / (sum(q) OVER w + 1.0::DOUBLE * count(*) OVER w), 6) AS u FROM n WINDOW w AS (PARTITION BY feature)"""


CALIBRATION = _calibration()

_U = lambda tag: f"(CAST('0x' || substr(md5(mention_id || '{tag}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
_STRESS = f"""WITH {CHINESE},
t AS (SELECT mention_id, raw_name, string_split(raw_name, ' ') AS w, {_U('op')} AS op_u, {_U('space')} AS space_u, {_U('pick')} AS pick_u,
  split_part(raw_name, ' ', 1) IN {_IN(SURNAMES + MORE_SURNAMES)} OR list_contains({[*SURNAMES, *MORE_SURNAMES]!r}, list_filter(string_split(regexp_replace(raw_name, '[,.\\-''\"()]', ' ', 'g'), ' '), lambda x: x <> '')[-1]) AS cn FROM cn_mention),
o AS (SELECT *, cn AND pick_u < 0.3 AS chosen, CASE WHEN op_u < 0.4 THEN 'swap_order' WHEN op_u < 0.6 THEN 'punctuation' WHEN op_u < 0.8 THEN 'remove_space' WHEN length(w[2]) <= 1 THEN 'swap_order_fallback' ELSE 'initialize_given' END AS op FROM t),
stressed AS (SELECT mention_id, raw_name AS raw_name_original, CASE WHEN chosen THEN op END AS stress_op,
  CASE WHEN NOT chosen THEN raw_name WHEN op LIKE 'swap_order%' THEN w[2] || ' ' || w[1] WHEN op = 'punctuation' THEN w[1] || ', ' || w[2] WHEN op = 'remove_space' THEN CASE WHEN space_u < 0.5 THEN replace(raw_name, ' ', '') ELSE replace(raw_name, ' ', '-') END ELSE w[1] || ' ' || left(w[2], 1) || '.' END AS raw_name FROM o)"""
STRESS = f"{_STRESS} SELECT mention_id, raw_name, raw_name_original, stress_op FROM stressed"
STRESS_REPORT = f"{_STRESS} SELECT stress_op AS op, count(*) AS n, count(*) FILTER (raw_name <> raw_name_original) AS changed FROM stressed WHERE stress_op IS NOT NULL GROUP BY 1"
SUBSET_STATS = f"{_STRESS} SELECT count(*) AS total, count(*) FILTER (cn) AS chinese, count(*) FILTER (NOT cn) AS non_chinese, round(count(*) FILTER (cn) / count(*), 6) AS ratio, count(DISTINCT CASE WHEN cn THEN nullif(orcid, '') END) AS chinese_orcids FROM o JOIN cn_mention USING (mention_id)"
TRACE = f"""{M} SELECT mention_id, substr(sha256(raw_name || '||salt'), 1, 16) AS name_hash, 2 AS tokens, len(coauthors) AS coauthors, substr(sha256(affiliation || '||salt'), 1, 16) AS affiliations, substr(sha256(venue || '||salt'), 1, 12) AS journals,
  array_to_string(list_filter([CASE WHEN orcid <> '' THEN 'orcid:' || orcid END, 'surname:' || lastname, 'surname_initial:' || lastname || '_' || upper(left(firstname, 1))], lambda x: x IS NOT NULL), ',') AS keys FROM mention"""
AUTHOR_STATS = f"{MA} SELECT count(*) AS total, count(*) FILTER (orcid <> '') AS with_orcid, count(DISTINCT split_part(canonical_name, ' ', -1)) AS unique_surnames, round(avg(len(journals)), 6) AS avg_records FROM author"
MERGED = f"""{MA}, t AS (SELECT a.author_id, a.coauthors, a.journals, a.affiliations, b.author_id AS other, b.coauthors AS c2, b.journals AS j2, b.affiliations AS f2 FROM author a LEFT JOIN author b ON b.seq = a.seq + 1 WHERE a.seq % 2 = 0)
SELECT author_id, len(list_distinct(list_concat(coauthors, coalesce(c2, [])))) AS coauthors, array_to_string(list_sort(list_distinct(list_concat(journals, coalesce(j2, [])))), ',') AS journals, len(list_distinct(list_concat(affiliations, coalesce(f2, [])))) AS affiliations,
  CASE WHEN other IS NULL THEN author_id ELSE author_id || ',' || other END AS linked_records, CASE WHEN other IS NULL THEN 1.0 ELSE round(0.9 * 0.95, 6) END AS confidence_score FROM t"""
