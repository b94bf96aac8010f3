"""The vocabulary over the tables: parts as terms in three scripts, suppliers as seed entities, and what joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import audits as A
from loomgraph.operators.storage import written
from loomgraph.plans.base import Graph, query

#: Digits of a number spelled in a script; the half-width kana are those that one character folds.
_DIGITS, _HIRA, _KATA, _HALF, _HANGUL, _LATIN = "0123456789", "あいうえおかきくけこ", "アイウエオカキクケコ", "ｱｲｳｴｵｶｷｸｹｺ", "가나다라마바사아자차", "kstnhmrywg"


def _spelled(number: Column, script: str) -> Column:
    return F.translate(number.cast("string"), _DIGITS, script)


_SQL_TERMS = f"""
numbered AS (SELECT p_partkey AS k, p_size AS z, CAST(p_partkey % 700 AS VARCHAR) AS n FROM part),
terms AS (SELECT 'v' || k AS id,
  CASE z % 6 WHEN 0 THEN translate(n, '{_DIGITS}', '{_HIRA}') WHEN 1 THEN translate(n, '{_DIGITS}', '{_KATA}') WHEN 2 THEN translate(n, '{_DIGITS}', '{_HALF}') WHEN 3 THEN translate(n, '{_DIGITS}', '{_HIRA}') || '・ヶ'
    WHEN 4 THEN ' ' || translate(n, '{_DIGITS}', '{_KATA}') || ' ケ' ELSE NULL END AS term_ja,
  CASE z % 5 WHEN 0 THEN upper(translate(n, '{_DIGITS}', '{_LATIN}')) || 'ou' WHEN 1 THEN translate(n, '{_DIGITS}', '{_LATIN}') || 'ō (type) / other ' || n WHEN 2 THEN 'inferred ' || n WHEN 3 THEN translate(n, '{_DIGITS}', '{_LATIN}') || 'oo' ELSE '' END AS term_en,
  CASE z % 4 WHEN 0 THEN translate(n, '{_DIGITS}', '{_HANGUL}') WHEN 1 THEN translate(n, '{_DIGITS}', '{_HANGUL}') || ' / ' || ' (' || translate(n, '{_DIGITS}', '{_HANGUL}') || ')' WHEN 2 THEN '· ' || translate(n, '{_DIGITS}', '{_HANGUL}') || ', ' || n END AS term_ko,
  CASE z % 7 WHEN 0 THEN 'yomi ' || n WHEN 1 THEN translate(n, '{_DIGITS}', '{_HIRA}') END AS reading, CASE WHEN z % 9 = 4 THEN 'lanes: kind 이견 here' WHEN z % 2 = 0 THEN 'plain' END AS notes,
  CASE z % 3 WHEN 0 THEN '1a' WHEN 1 THEN '2' ELSE '3' END AS best_tier, z % 8 = 0 AS unverified FROM numbered),
relations AS (SELECT 'v' || k AS subject, CASE z % 4 WHEN 0 THEN 'same_as' WHEN 1 THEN 'variant_spelling' WHEN 2 THEN 'narrower' ELSE 'collides_with' END AS relation, 'v' || (k - 1) AS object, CASE WHEN z = 8 THEN 'source:x | disputed:y' ELSE 'source:x' END AS basis FROM numbered WHERE z <= 14 AND k > 0
  UNION ALL SELECT 'v' || k, 'collides_with', 'v' || (k - 2), 'inferred:z' FROM numbered WHERE z IN (4, 5) AND k > 1
  UNION ALL SELECT 'v' || k, 'seed_match', CASE WHEN k % 3 = 0 THEN upper(translate(CAST(k % 90 AS VARCHAR), '{_DIGITS}', '{_LATIN}')) ELSE translate(CAST(k % 90 AS VARCHAR), '{_DIGITS}', '{_LATIN}') END || 'o', CASE WHEN z % 3 = 0 THEN 'inferred:w' ELSE 'source:w' END FROM numbered WHERE z % 4 = 1
  UNION ALL SELECT 'v' || k, 'collides_with', translate(CAST(k % 90 AS VARCHAR), '{_DIGITS}', '{_LATIN}') || 'o', 'inferred:c' FROM numbered WHERE z = 50),
entities AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN upper(translate(n, '{_DIGITS}', '{_LATIN}')) ELSE translate(n, '{_DIGITS}', '{_LATIN}') END || 'o' AS name, CASE WHEN s_suppkey % 5 = 4 THEN 'Strain' ELSE 'OrnamentalTrait' END AS label,
  CASE s_suppkey % 4 WHEN 0 THEN translate(n, '{_DIGITS}', '{_KATA}') || '（よみ）' WHEN 1 THEN translate(n, '{_DIGITS}', '{_KATA}') END AS japanese_name,
  CASE s_suppkey % 3 WHEN 0 THEN [translate(n, '{_DIGITS}', '{_LATIN}') || 'ou', translate(n, '{_DIGITS}', '{_HIRA}')] WHEN 1 THEN [n || '(x)'] ELSE []::VARCHAR[] END AS aliases,
  CASE WHEN s_suppkey % 2 = 0 THEN [translate(n, '{_DIGITS}', '{_HIRA}') || 'ケ', translate(CAST(s_suppkey % 90 + 1 AS VARCHAR), '{_DIGITS}', '{_HALF}')] ELSE []::VARCHAR[] END AS unverified_labels, s_suppkey % 7 = 0 AS has_labels, s_suppkey % 6 = 2 AS lab
  FROM (SELECT s_suppkey, CAST(s_suppkey % 90 AS VARCHAR) AS n FROM supplier WHERE s_suppkey < 90))"""


def _terms(g: Graph) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    n = (k % 700).cast("string")
    hira, kata, half, hangul, latin = (_spelled(k % 700, x) for x in (_HIRA, _KATA, _HALF, _HANGUL, _LATIN))
    both = F.concat
    return g.read("part").select(
        both(F.lit("v"), k).alias("id"),
        F.when(z % 6 == 0, hira).when(z % 6 == 1, kata).when(z % 6 == 2, half).when(z % 6 == 3, both(hira, F.lit("・ヶ"))).when(z % 6 == 4, both(F.lit(" "), kata, F.lit(" ケ"))).alias("term_ja"),
        F.when(z % 5 == 0, both(F.upper(latin), F.lit("ou"))).when(z % 5 == 1, both(latin, F.lit("ō (type) / other "), n)).when(z % 5 == 2, both(F.lit("inferred "), n)).when(z % 5 == 3, both(latin, F.lit("oo"))).otherwise("").alias("term_en"),
        F.when(z % 4 == 0, hangul).when(z % 4 == 1, both(hangul, F.lit(" /  ("), hangul, F.lit(")"))).when(z % 4 == 2, both(F.lit("· "), hangul, F.lit(", "), n)).alias("term_ko"),
        F.when(z % 7 == 0, both(F.lit("yomi "), n)).when(z % 7 == 1, hira).alias("reading"), F.when(z % 9 == 4, "lanes: kind 이견 here").when(z % 2 == 0, "plain").alias("notes"),
        F.when(z % 3 == 0, "1a").when(z % 3 == 1, "2").otherwise("3").alias("best_tier"), (z % 8 == 0).alias("unverified"))


def _relations(g: Graph) -> DataFrame:
    part, k, z = g.read("part"), F.col("p_partkey"), F.col("p_size")
    term = lambda c: F.concat(F.lit("v"), c)
    spelled = _spelled(k % 90, _LATIN)
    near = part.where("p_size <= 14 AND p_partkey > 0").select(term(k).alias("subject"), F.when(z % 4 == 0, "same_as").when(z % 4 == 1, "variant_spelling").when(z % 4 == 2, "narrower").otherwise("collides_with").alias("relation"), term(k - 1).alias("object"), F.when(z == 8, "source:x | disputed:y").otherwise("source:x").alias("basis"))
    far = part.where("p_size IN (4, 5) AND p_partkey > 1").select(term(k), F.lit("collides_with"), term(k - 2), F.lit("inferred:z"))
    match = part.where("p_size % 4 = 1").select(term(k), F.lit("seed_match"), F.concat(F.when(k % 3 == 0, F.upper(spelled)).otherwise(spelled), F.lit("o")), F.when(z % 3 == 0, "inferred:w").otherwise("source:w"))
    return near.union(far).union(match).union(part.where("p_size = 50").select(term(k), F.lit("collides_with"), F.concat(spelled, F.lit("o")), F.lit("inferred:c")))


def _entities(g: Graph) -> DataFrame:
    s = F.col("s_suppkey")
    n, hira, kata, latin = s.cast("string"), _spelled(s, _HIRA), _spelled(s, _KATA), _spelled(s, _LATIN)
    none = F.array().cast("array<string>")
    return g.read("supplier").where("s_suppkey < 90").select(
        F.concat(F.when(s % 3 == 0, F.upper(latin)).otherwise(latin), F.lit("o")).alias("name"), F.when(s % 5 == 4, "Strain").otherwise("OrnamentalTrait").alias("label"),
        F.when(s % 4 == 0, F.concat(kata, F.lit("（よみ）"))).when(s % 4 == 1, kata).alias("japanese_name"),
        F.when(s % 3 == 0, F.array(F.concat(latin, F.lit("ou")), hira)).when(s % 3 == 1, F.array(F.concat(n, F.lit("(x)")))).otherwise(none).alias("aliases"),
        F.when(s % 2 == 0, F.array(F.concat(hira, F.lit("ケ")), _spelled(s + 1, _HALF))).otherwise(none).alias("unverified_labels"), (s % 7 == 0).alias("has_labels"), (s % 6 == 2).alias("lab"))


def _ja(x: str) -> str:
    return f"regexp_replace(translate(translate({x}, '{_HALF}', '{_KATA}'), '{X.HIRAGANA}ヶヵ', '{X.KATAKANA}ケカ'), '[\\s・･.]', '', 'g')"


def _romaji(x: str) -> str:
    out = f"regexp_replace(lower(strip_accents({x})), '[^a-z]', '', 'g')"
    for long in ("ou", "oo", "uu", "aa", "ii", "ee"):
        out = f"replace({out}, '{long}', '{long[0]}')"
    return out


def _ko(x: str) -> str:
    return f"regexp_replace({x}, '[\\s()（）·-]', '', 'g')"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '（.*?）|\\(.*?\\)', '', 'g')"


_EN = "list_distinct(list_filter(list_transform(string_split(coalesce(term_en, ''), '/'), lambda x: trim(regexp_replace(x, '\\(.*?\\)', '', 'g'))), lambda x: x <> ''))"
_KO = "list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(term_ko, ''), '[/,]'), lambda x: trim(x)), lambda x: x <> ''))"


def _components(name: str, where: str) -> str:
    return f"""{name}_edges AS (SELECT subject AS a, object AS b FROM relations WHERE {where} UNION SELECT object, subject FROM relations WHERE {where}),
{name}_reach AS (SELECT a AS node, a AS seen FROM {name}_edges UNION SELECT r.node, e.b FROM {name}_reach r JOIN {name}_edges e ON e.a = r.seen),
{name} AS (SELECT node, min(seen) AS component FROM {name}_reach GROUP BY node)"""


_AUDITS = f"""
WITH RECURSIVE {_SQL_TERMS.strip()},
{_components("linked", "relation IN ('same_as', 'variant_spelling', 'narrower', 'broader', 'collides_with')")},
{_components("same", "relation IN ('same_as', 'variant_spelling') AND basis NOT LIKE '%disputed:%'")},
keys AS (SELECT 'ja-normalised' AS which, id, {_ja("term_ja")} AS key FROM terms UNION SELECT 'en', id, {_romaji("part")} FROM (SELECT id, unnest({_EN}) AS part FROM terms WHERE term_en NOT LIKE '%inferred%') WHERE length({_romaji("part")}) > 3
  UNION SELECT 'ko', id, {_ko("part")} FROM (SELECT id, unnest({_KO}) AS part FROM terms)),
grouped AS (SELECT which, key, coalesce(component, id) AS component, count(*) AS size FROM keys LEFT JOIN linked ON node = id WHERE coalesce(key, '') <> '' GROUP BY ALL),
seeds AS (SELECT DISTINCT subject AS node, object AS seed FROM relations WHERE relation = 'seed_match'),
labels AS (SELECT name, japanese_name AS text, 'ja' AS field FROM entities WHERE japanese_name IS NOT NULL UNION ALL SELECT name, unnest(aliases), 'alias' FROM entities UNION ALL SELECT name, unnest(unverified_labels), 'unverified' FROM entities),
owners AS (SELECT lower({_ja("CASE WHEN field = 'ja' THEN " + _bare("text") + " ELSE text END")}) AS key, count(DISTINCT name) AS n FROM labels WHERE text <> '' GROUP BY 1),
carried AS (SELECT name, {_ja("CASE WHEN field = 'unverified' THEN text ELSE " + _bare("text") + " END")} AS key, bool_or(field = 'unverified') AS filed FROM labels GROUP BY ALL),
met AS (SELECT e.name, t.id, t.term_en, r.basis LIKE 'source:%' AS sourced, left(t.best_tier, 1) IN ('1', '2') AS good, t.unverified, coalesce(c.filed, false) AS filed, c.name IS NOT NULL AS carried FROM relations r JOIN entities e ON e.name = r.object AND e.label = 'OrnamentalTrait'
  JOIN terms t ON t.id = r.subject LEFT JOIN carried c ON c.name = e.name AND c.key = {_ja("t.term_ja")} WHERE r.relation = 'seed_match'),
variants AS (SELECT m.name, part FROM (SELECT name, unnest({_EN}) AS part FROM met) m WHERE regexp_full_match(part, '[\\x00-\\x7f]+') AND replace(lower(part), ' ', '') <> replace(lower(m.name), ' ', '') AND {_romaji("part")} = {_romaji("m.name")}
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.name = m.name AND l.field = 'alias' AND lower(l.text) = lower(part))),
traits AS (SELECT * FROM entities WHERE label = 'OrnamentalTrait'),
forms AS (SELECT id, count(*) AS forms, count(DISTINCT {_ko("part")}) AS keys FROM (SELECT id, unnest({_KO}) AS part FROM terms) GROUP BY id)
SELECT '1-scattered:' || which AS check, 'medium' AS severity, key AS subject, CAST(sum(size) * (sum(size) - 1) / 2 - sum(size * (size - 1) / 2) AS BIGINT) AS n FROM grouped GROUP BY which, key HAVING count(*) > 1
UNION ALL SELECT '2-wrong-merge:collision-inside-same_as-cluster', 'high', r.subject || ' ~ ' || r.object, (SELECT count(*) FROM same s WHERE s.component = a.component) FROM relations r JOIN same a ON a.node = r.subject JOIN same b ON b.node = r.object AND b.component = a.component WHERE r.relation = 'collides_with'
UNION ALL SELECT '2-wrong-merge:same_as-cluster-spans-seed-traits', 'high', component, count(DISTINCT seed) FROM same JOIN seeds USING (node) GROUP BY component HAVING count(DISTINCT seed) > 1
UNION ALL SELECT '2-wrong-merge:row-merged-across-kinds', 'low', id, 1 FROM terms WHERE notes LIKE '%kind 이견%'
UNION ALL SELECT '3-seed:same-label-on-two-entities', 'medium', key, n FROM owners WHERE n > 1
UNION ALL SELECT '3-seed:attested-label-filed-unverified', 'high', name || ' / ' || id, 1 FROM met WHERE filed AND sourced AND good AND NOT unverified
UNION ALL SELECT '3-seed:attested-synonym-missing', 'medium', name || ' / ' || id, 1 FROM met WHERE NOT carried AND sourced AND good
UNION ALL SELECT '3-seed:inferred-match-not-recorded', 'low', name || ' / ' || id, 1 FROM met WHERE NOT carried AND NOT sourced
UNION ALL SELECT '3-orthography:romanisation-variant', 'low', name || ' ~ ' || part, 1 FROM variants
UNION ALL SELECT '3-orthography:reading-inside-label', 'medium', name, 1 FROM traits WHERE japanese_name LIKE '%（%'
UNION ALL SELECT '3-structure:single-slot-japanese-name', 'medium', name, 1 FROM traits WHERE japanese_name IS NOT NULL AND len(unverified_labels) > 0 AND NOT has_labels
UNION ALL SELECT '3-structure:non-ascii-alias', 'low', name, 1 FROM traits WHERE NOT has_labels AND len(list_filter(aliases, lambda a: NOT regexp_full_match(a, '[\\x00-\\x7f]*'))) > 0
UNION ALL SELECT '3-orthography:case', 'low', name, 1 FROM traits WHERE name <> lower(name)
UNION ALL SELECT '3-orthography:reading-not-kana', 'low', id, 1 FROM terms WHERE regexp_matches(reading, '[A-Za-z]')
UNION ALL SELECT '3-orthography:width-variant-in-term', 'low', id, 1 FROM terms WHERE term_ja <> translate(term_ja, '{_HALF}', '{_KATA}')
UNION ALL SELECT '3-orthography:korean-spacing-variant', 'low', id, forms FROM forms WHERE forms > 1 AND keys < forms
"""


@query(_AUDITS, plain=True)
def Q39_T25_T26_T27_audits(g: Graph) -> DataFrame:
    """All audits of the vocabulary: names that share a folded key, wrong merges, seed labels and spellings."""
    return A.findings(written(_terms(g)), written(_relations(g)), written(_entities(g)))


@query(f"""
WITH {_SQL_TERMS.strip()}, ties AS (SELECT r.subject AS id, r.object AS seed, relation = 'seed_match' AS match, CASE WHEN basis LIKE 'source:%' THEN 0 ELSE 1 END AS weak FROM relations r WHERE relation IN ('seed_match', 'collides_with') AND object IN (SELECT name FROM entities) AND subject IN (SELECT id FROM terms)),
by_seed AS (SELECT e.name, e.lab, count(*) FILTER (WHERE match) AS m, count(*) FILTER (WHERE NOT match) AS c, min(weak) FILTER (WHERE match) AS wm, min(weak) FILTER (WHERE NOT match) AS wc FROM entities e LEFT JOIN ties t ON t.seed = e.name GROUP BY ALL),
by_term AS (SELECT x.id AS name, count(*) FILTER (WHERE match) AS m, count(*) FILTER (WHERE NOT match) AS c, min(weak) FILTER (WHERE match) AS wm, min(weak) FILTER (WHERE NOT match) AS wc FROM terms x LEFT JOIN ties t ON t.id = x.id GROUP BY ALL),
told AS (SELECT 'seed' AS side, name, CASE WHEN m > 0 THEN 'M' WHEN lab THEN 'L' WHEN c > 0 THEN 'C' ELSE 'N' END AS status, m, c, wm, wc FROM by_seed UNION ALL SELECT 'term', name, CASE WHEN m > 0 THEN 'M' WHEN c > 0 THEN 'C' ELSE 'U' END, m, c, wm, wc FROM by_term)
SELECT side, name, status, CASE CASE WHEN status = 'M' THEN wm WHEN status IN ('C', 'L') THEN wc END WHEN 0 THEN 'source' WHEN 1 THEN 'inferred' END AS basis, CASE WHEN status = 'M' THEN m WHEN status IN ('C', 'L') THEN c ELSE 0 END AS n FROM told
""", plain=True)
def Q38_coverage(g: Graph) -> DataFrame:
    """Which seed entities the vocabulary covers, and which terms no seed has."""
    return A.coverage(_entities(g).select("name", "lab"), _terms(g), _relations(g))


@query(f"""
WITH {_SQL_TERMS.strip()} SELECT id, {_ja("term_ja")} AS ja, trim(translate(translate(term_ja, '{_HALF}', '{_KATA}'), '{X.KATAKANA}', '{X.HIRAGANA}')) AS kana, {_romaji("term_en")} AS romaji, {_ko("term_ko")} AS ko, array_to_string(list_sort({_KO}), '|') AS parts, {_bare("term_en")} AS bare FROM terms
""", plain=True)
def T25_T26_T27_T42_folds(g: Graph) -> DataFrame:
    """Every term folded in each way that names are compared."""
    ja, en, ko = F.col("term_ja"), F.col("term_en"), F.col("term_ko")
    return _terms(g).select("id", X.norm_ja(ja).alias("ja"), X.fold_kana(ja).alias("kana"), X.norm_romaji(en).alias("romaji"), X.norm_ko(ko).alias("ko"), F.array_join(F.array_sort(X.split_multi(ko, "/,")), "|").alias("parts"), X.strip_reading(en).alias("bare"))
