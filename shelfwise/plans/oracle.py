"""SQL for the same rows, from the rule tables, in plain relational terms."""

from __future__ import annotations

from shelfwise.config import RuleSet
from shelfwise.functions.plain import canonical
from shelfwise.plans.projection import LISTING, STATUSES

RULES = RuleSet.load()


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(upper(strip_accents(replace(coalesce({x}, ''), 'ß', 'ss'))), '[^A-Z0-9]+', ' ', 'g'))"


def has_token(tokens: str, words) -> str:
    return f"list_has_any({tokens}, [{', '.join(map(quoted, words))}])"


def weighted(x: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, length({x}) + 1), lambda i: coalesce(try_cast(substr(reverse({x}), i, 1) AS INT), 0) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)), 0)"


def fit(x: str, n: str) -> str:
    return f"lpad({x}, CASE WHEN {n} <= 8 THEN 8 WHEN {n} <= 12 THEN 12 WHEN {n} <= 13 THEN 13 ELSE 14 END, '0')"


LISTED = f"listing AS ({LISTING.format(lineitem='lineitem', part='part')}), statuses AS ({STATUSES.format(part='part')})"
LEAF = "taxonomie_niveau_4"

_suffix = "CASE WHEN regexp_matches({0}, 'O *R *I *G *I *N *E *I *T *A *L *I *A *$') THEN trim(regexp_replace({0}, 'O *R *I *G *I *N *E *I *T *A *L *I *A *$', '')) ELSE {0} END"
_family = "CASE WHEN regexp_matches({0}, 'F *A *M *I *L *Y *S *I *Z *E *$') THEN trim(regexp_replace({0}, 'F *A *M *I *L *Y *S *I *Z *E *$', '')) ELSE {0} END"

_leaf_case = " ".join(f"WHEN {has_token('tokens', words)} THEN {quoted(leaf)}" for leaf, words in RULES.keywords.items())
_family_case = " ".join(f"WHEN {has_token('tokens', f.tokens)} THEN {f.expected}::DOUBLE" for f in RULES.families.values())
_category = " ".join(f"WHEN {quoted(k)} THEN {c.expected}::DOUBLE" for k, c in RULES.categories.items())
_accepts = " OR ".join(f"(t4 = {quoted(k)} AND vat_rate IN ({', '.join(f'{r}::DOUBLE' for r in c.accepted)}))" for k, c in RULES.categories.items())
_known = ", ".join(quoted(" > ".join(p)) for p in RULES.paths)
LEGAL = ", ".join(f"{r}::DOUBLE" for r in RULES.legal_rates)


def _spelled(column: str, level: int) -> str:
    cases = {canonical(p[level]): p[level] for p in RULES.paths}
    return f"CASE {norm(column)} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in cases.items()) + f" ELSE {column} END"


def _filled(level: int) -> str:
    return f"CASE WHEN c{level + 1} = '' THEN coalesce(CASE c4 " + " ".join(f"WHEN {quoted(p[3])} THEN {quoted(p[level])}" for p in RULES.paths) + f" END, '') ELSE c{level + 1} END"


CLEANED = f"""{LISTED},
collapsed AS (SELECT * REPLACE (trim(regexp_replace(nom, '\\s+', ' ', 'g')) AS nom, trim(ean) AS ean, trim(tva) AS tva, trim(url_image) AS url_image), nom AS raw_nom FROM listing),
cut1 AS (SELECT *, {_suffix.format("nom")} AS nom1 FROM collapsed),
cleaned AS (
  SELECT * REPLACE ({_family.format("nom1")} AS nom), CASE WHEN nom1 <> nom THEN 'ITALIA' END AS origin, CASE WHEN {_family.format("nom1")} <> nom1 THEN 'FAMILY SIZE' END AS marketing_mention, nom AS joined_nom FROM cut1)"""

JUDGED = f"""{CLEANED},
codes AS (
  SELECT *, length(ean) AS n, {weighted("ean")} % 10 = 0 AS even, regexp_replace(ean, '^0+', '') AS bare, substr(ean, 2, 13) AS tail FROM cleaned),
verdicts AS (
  SELECT *, CASE
    WHEN ean = '' THEN 'missing'
    WHEN NOT regexp_full_match(ean, '[0-9]+') THEN 'invalid'
    WHEN even AND n IN (8, 13, 14) AND ean[1] = '2' THEN 'internal_gs1'
    WHEN even AND n = 14 AND ean[1] = '0' THEN 'unpadded'
    WHEN even AND n = 14 THEN 'gtin14'
    WHEN even AND n IN (8, 12, 13) THEN 'ok'
    WHEN even AND n < 14 THEN 'padded'
    WHEN even AND length(bare) BETWEEN 1 AND 14 AND length(bare) < n THEN 'unpadded'
    WHEN even THEN 'invalid'
    WHEN n = 14 AND {weighted("tail")} % 10 = 0 THEN 'unpadded'
    WHEN n < 8 THEN 'not_a_gtin' ELSE 'invalid' END AS ean_status FROM codes),
valued AS (
  SELECT *, CASE ean_status WHEN 'missing' THEN NULL WHEN 'padded' THEN {fit("ean", "n")}
    WHEN 'unpadded' THEN CASE WHEN n = 14 THEN tail ELSE {fit("bare", "length(bare)")} END ELSE ean END AS ean_value,
    CASE WHEN regexp_matches(lower(url_image), '^htps?:') THEN 'https:' || regexp_replace(url_image, '^[A-Za-z]+:', '')
         WHEN regexp_matches(lower(url_image), '^(hhtp|htttp):') THEN 'http:' || regexp_replace(url_image, '^[A-Za-z]+:', '')
         WHEN NOT regexp_matches(url_image, '^[A-Za-z][A-Za-z0-9+.-]*:') AND starts_with(url_image, 'www.') THEN 'https://' || url_image ELSE url_image END AS url,
    try_cast(rtrim(replace(tva, ',', '.'), '% ') AS DOUBLE) AS vat_rate FROM verdicts),
spelled AS (
  SELECT v.*, s.ok AS known_ok, s.reason, {", ".join(f"{_spelled(f'taxonomie_niveau_{k + 1}', k)} AS c{k + 1}" for k in range(4))}
  FROM valued v LEFT JOIN statuses s ON v.url = s.url),
seen AS (
  SELECT *, CASE WHEN ean_status IN ('ok', 'padded', 'unpadded', 'gtin14') THEN ean_value ELSE '' END AS ean_out,
    CASE WHEN ean_status IN ('internal_gs1', 'not_a_gtin') THEN ean_value ELSE '' END AS internal_code, ean_status IN ('ok', 'padded', 'unpadded') AS ean_valid,
    CASE WHEN url = '' THEN 'url_missing' WHEN NOT regexp_matches(lower(url), '^https?:') THEN 'url_malformed' WHEN known_ok IS NULL OR known_ok THEN NULL WHEN reason = 'dns' THEN 'url_domain_unresolvable' ELSE 'url_unreachable' END AS url_code,
    url <> '' AND regexp_matches(lower(url), '^https?:') AND coalesce(known_ok, false) AS url_ok,
    url = '' OR NOT regexp_matches(lower(url), '^https?:') OR known_ok IS NOT NULL AS url_checked,
    CASE WHEN c1 <> '' AND c2 <> '' AND c3 <> '' AND c4 <> '' THEN CASE WHEN c1 || ' > ' || c2 || ' > ' || c3 || ' > ' || c4 IN ({_known}) THEN 'complete' ELSE 'taxonomy_unknown_path' END
         WHEN (c1 = '' AND (c2 <> '' OR c3 <> '' OR c4 <> '')) OR (c2 = '' AND (c3 <> '' OR c4 <> '')) OR (c3 = '' AND c4 <> '') THEN 'taxonomy_gap' ELSE 'taxonomy_incomplete' END AS shape,
    {", ".join(f"{_filled(k)} AS t{k + 1}" for k in range(3))}, c4 AS t4, string_split({norm("nom")}, ' ') AS tokens FROM spelled),
expected AS (
  SELECT *, CASE {_leaf_case} END AS expected_leaf, CASE {_family_case} END AS family_rate FROM seen),
rated AS (
  SELECT *, coalesce(expected_leaf IS NOT NULL AND t4 <> '' AND expected_leaf <> t4, false) AS mismatch, coalesce({_accepts}, false) AS accepted, CASE t4 {_category} END AS category_rate FROM expected),
checked AS (
  SELECT *, coalesce(family_rate, CASE WHEN NOT mismatch THEN CASE WHEN accepted THEN vat_rate ELSE category_rate END END) AS vat_expected FROM rated),
rows_ AS (
  SELECT *, vat_expected IS NULL OR vat_rate IS NOT DISTINCT FROM vat_expected OR accepted AS vat_coherent, t1 <> '' AND t2 <> '' AND t3 <> '' AND t4 <> '' AS complete, {norm("nom")} AS key FROM checked)"""


def _mode(value: str, name: str) -> str:
    return f"""{name} AS (SELECT key, arg_max(v, (n, -f)) AS v, count(*) AS k FROM (SELECT key, {value} AS v, count(*) AS n, min(row_seq) AS f FROM rows_ WHERE coalesce({value}, '') <> '' GROUP BY ALL) GROUP BY key)"""


_PATH = "t1 || ' > ' || t2 || ' > ' || t3 || ' > ' || t4"
GOLDEN = f"""{JUDGED},
{_mode("CASE WHEN ean_valid THEN ean_out END", "m_ean")}, {_mode("internal_code", "m_internal")}, {_mode("url", "m_url")}, {_mode(f"CASE WHEN complete THEN {_PATH} END", "m_full")}, {_mode(_PATH, "m_path")},
{_mode("vat_rate::VARCHAR", "m_vat")}, {_mode("nom", "m_nom")}, {_mode("origin", "m_origin")},
base AS (
  SELECT key, arg_max(nom, (length(nom), -row_seq)) AS label, arg_min(url, row_seq) FILTER (WHERE url_ok) AS good_url, bool_or(url_checked) AS url_checked, bool_or(NOT vat_coherent) AS incoherent, count(*) AS source_rows, min(row_seq) AS first_seq
  FROM rows_ GROUP BY key),
golden0 AS (
  SELECT b.*, e.v AS ean, i.v AS internal_code, coalesce(good_url, u.v) AS url_image, good_url IS NOT NULL AS url_ok, coalesce(f.v, p.v) AS path, coalesce(f.k, p.k) > 1 AS taxonomy_conflict, f.v IS NOT NULL AS full_path,
         v.v::DOUBLE AS vat_rate, coalesce(v.k, 0) > 1 OR incoherent AS vat_conflict, CASE WHEN m.v <> b.label THEN m.v ELSE '' END AS label_enriched, o.v AS origin
  FROM base b LEFT JOIN m_ean e USING (key) LEFT JOIN m_internal i USING (key) LEFT JOIN m_url u USING (key) LEFT JOIN m_full f USING (key) LEFT JOIN m_path p USING (key) LEFT JOIN m_vat v USING (key) LEFT JOIN m_nom m USING (key) LEFT JOIN m_origin o USING (key)),
quantities AS (
  SELECT *, trim(regexp_replace(upper(strip_accents(label)), '[^A-Z0-9.,]+', ' ', 'g')) AS q FROM golden0),
golden AS (
  SELECT *, ean IS NOT NULL AND url_ok AND url_checked AND full_path AND NOT vat_conflict AND coalesce(vat_rate IN ({LEGAL}), false) AS publishable,
         try_cast(replace(nullif(regexp_extract(q, '(\\d+(?:[.,]\\d+)?)\\s*(KG|CL|ML|L|G|K)\\b', 1), ''), ',', '.') AS DOUBLE) AS quantity_value,
         CASE regexp_extract(q, '(\\d+(?:[.,]\\d+)?)\\s*(KG|CL|ML|L|G|K)\\b', 2) WHEN '' THEN NULL WHEN 'K' THEN 'KG' ELSE regexp_extract(q, '(\\d+(?:[.,]\\d+)?)\\s*(KG|CL|ML|L|G|K)\\b', 2) END AS quantity_unit FROM quantities)"""

ROUTED = f"""{GOLDEN},
routed AS (
  SELECT *, CASE WHEN trim(label) = '' THEN 'REJECTED' WHEN vat_conflict OR vat_rate IS NULL OR vat_rate NOT IN ({LEGAL}) THEN 'NEEDS_REVIEW' WHEN label_enriched <> '' THEN 'NEEDS_REVIEW' WHEN taxonomy_conflict OR NOT publishable THEN 'NEEDS_REVIEW' ELSE 'VALIDATED' END AS status,
         CASE WHEN trim(label) = '' THEN 0.0 WHEN vat_conflict OR vat_rate IS NULL OR vat_rate NOT IN ({LEGAL}) THEN 1.0 WHEN label_enriched <> '' THEN 0.0 WHEN taxonomy_conflict THEN 0.5 WHEN NOT publishable THEN 0.6 ELSE 1.0 END::DOUBLE AS confidence FROM golden)"""

BLOCKS = f"""{GOLDEN},
blocks AS (
  SELECT *, coalesce(nullif(string_split(path, ' > ')[4], ''), '?') || '|' || CASE WHEN coalesce(quantity_value, 0) = 0 THEN '?'
      ELSE CASE WHEN quantity_unit IN ('ML', 'CL', 'L') THEN 'VOL' ELSE 'MAS' END || regexp_replace(printf('%.6f', quantity_value * CASE quantity_unit WHEN 'CL' THEN 10 WHEN 'L' THEN 1000 WHEN 'KG' THEN 1000 ELSE 1 END), '[.]?0+$', '') END AS block FROM golden)"""


def lcs(a: str, b: str) -> str:
    return f"""list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT), list_transform(range(1, length({a}) + 1), lambda i: [i::BIGINT])),
      lambda prev, cell: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length({b}) + 1), lambda j: [j::BIGINT])),
        lambda row_, spot: list_append(row_, CASE WHEN substr({b}, spot[1], 1) = substr({a}, cell[1], 1) THEN prev[spot[1]] + 1 ELSE greatest(prev[spot[1] + 1], row_[spot[1]]) END)))[-1]"""


FIXES = f"""{JUDGED},
fixes AS (
  SELECT id_produit AS row_id, 'nom' AS field_name, raw_nom AS old_value, joined_nom AS new_value, 'ingest.fix_text' AS rule FROM rows_ WHERE raw_nom <> joined_nom
  UNION ALL SELECT id_produit, 'nom', joined_nom, nom, 'ingest.detach_suffix' FROM rows_ WHERE joined_nom <> nom
  UNION ALL SELECT id_produit, 'ean', ean, ean_value, 'field_checks.ean.' || ean_status FROM rows_ WHERE ean_status IN ('padded', 'unpadded')
  UNION ALL SELECT id_produit, 'url_image', url_image, url, CASE WHEN starts_with(url_image, 'www.') THEN 'field_checks.url.scheme_missing' ELSE 'field_checks.url.scheme_typo' END FROM rows_ WHERE url <> url_image
  UNION ALL SELECT id_produit, 'taxonomie_niveau_1', taxonomie_niveau_1, c1, 'field_checks.taxonomy.canonicalize' FROM rows_ WHERE taxonomie_niveau_1 <> c1
  UNION ALL SELECT id_produit, 'taxonomie_niveau_2', taxonomie_niveau_2, c2, 'field_checks.taxonomy.canonicalize' FROM rows_ WHERE taxonomie_niveau_2 <> c2
  UNION ALL SELECT id_produit, 'taxonomie_niveau_3', taxonomie_niveau_3, c3, 'field_checks.taxonomy.canonicalize' FROM rows_ WHERE taxonomie_niveau_3 <> c3
  UNION ALL SELECT id_produit, 'taxonomie_niveau_4', taxonomie_niveau_4, c4, 'field_checks.taxonomy.canonicalize' FROM rows_ WHERE taxonomie_niveau_4 <> c4
  UNION ALL SELECT id_produit, 'taxonomie_niveau_1', '', t1, 'cross_checks.taxonomy.deduce_from_leaf' FROM rows_ WHERE c1 <> t1
  UNION ALL SELECT id_produit, 'taxonomie_niveau_2', '', t2, 'cross_checks.taxonomy.deduce_from_leaf' FROM rows_ WHERE c2 <> t2
  UNION ALL SELECT id_produit, 'taxonomie_niveau_3', '', t3, 'cross_checks.taxonomy.deduce_from_leaf' FROM rows_ WHERE c3 <> t3),
found AS (
  SELECT id_produit AS row_id, 'marketing_suffix_detached' AS code FROM rows_ WHERE joined_nom <> nom
  UNION ALL SELECT id_produit, 'label_empty' FROM rows_ WHERE trim(nom) = ''
  UNION ALL SELECT id_produit, 'ean_' || ean_status FROM rows_ WHERE ean_status <> 'ok'
  UNION ALL SELECT id_produit, 'url_scheme_repaired' FROM rows_ WHERE url <> url_image
  UNION ALL SELECT id_produit, url_code FROM rows_ WHERE url_code IS NOT NULL
  UNION ALL SELECT id_produit, CASE WHEN vat_rate IS NULL THEN 'vat_missing' ELSE 'vat_illegal_rate' END FROM rows_ WHERE vat_rate IS NULL OR vat_rate NOT IN ({LEGAL})
  UNION ALL SELECT id_produit, shape FROM rows_ WHERE shape <> 'complete'
  UNION ALL SELECT id_produit, 'taxonomy_gap_filled' FROM rows_ WHERE c1 <> t1 OR c2 <> t2 OR c3 <> t3
  UNION ALL SELECT id_produit, 'taxonomy_name_mismatch' FROM rows_ WHERE mismatch
  UNION ALL SELECT id_produit, 'vat_category_mismatch' FROM rows_ WHERE NOT vat_coherent)"""
