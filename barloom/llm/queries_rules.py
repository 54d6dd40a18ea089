"""op1: quality rules with cutoffs certified on labelled documents."""
from barloom.llm.quality_rules import GRID, RULES, certified_cutoffs, judge, with_statistics
from barloom.llm.registry import WORDS, query, table
from barloom.llm.staging import stored

LOSS, ERROR, PRICE = 0.05, 0.05, 10

_GRID = ", ".join(map(str, GRID))
_STATS = " UNION ALL ".join(
    f"SELECT doc_id, lang, '{r}' AS rule, CASE WHEN {b} > 0 THEN (1000 * {a}) // {b} ELSE 0 END AS x FROM base WHERE NOT base_failed" for r, (a, b) in RULES.items())
SQL_CTES = rf"""
d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {WORDS.format('text')} AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i+2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 3)) AS u(k) WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, [x FOR x IN string_split(t, chr(10)) IF len(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) > 0] AS l FROM d),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
    SELECT d.doc_id, lang, len(w) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
           len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
    FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))),
stat AS ({_STATS}),
lab AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
tested AS (SELECT lang, rule, g, count(*) FILTER (WHERE q = 1) AS n, count(*) FILTER (WHERE q = 1 AND x > g) AS bad, count(*) FILTER (WHERE q = 0 AND x > g) AS caught
           FROM stat JOIN lab USING (doc_id), unnest([{_GRID}]) AS u(g) GROUP BY lang, rule, g),
tail AS (SELECT n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(a) + (n - k) * ln(1 - a))) OVER (PARTITION BY n ORDER BY k) AS p
         FROM (SELECT DISTINCT n, {LOSS / len(RULES)} AS a FROM tested), unnest(range(0, greatest(1, CAST(floor(n * a) AS BIGINT)) + 1)) AS u(k) WHERE k <= n),
allowed AS (SELECT n, max(k) AS most FROM tail WHERE p <= {ERROR} / ((SELECT count(DISTINCT lang) FROM tested) * {len(RULES) * len(GRID)}) GROUP BY n),
cut AS (SELECT lang, rule, max({{'gain': caught - {PRICE} * bad, 'g': g}}).g AS cutoff FROM tested JOIN allowed USING (n)
        WHERE bad <= most AND caught > {PRICE} * bad GROUP BY lang, rule),
rejected AS (SELECT DISTINCT doc_id FROM stat JOIN cut USING (lang, rule) WHERE x > cutoff)"""
SQL = f"""WITH {SQL_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM base"""


@query("op1_quality_rules", SQL)
def op1_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    stats = stored(with_statistics(docs).drop("text"), "rules")
    cutoffs = stored(certified_cutoffs(stats, table(spark, sf_dir, "labels"), loss=LOSS, error=ERROR, price=PRICE), "rules")
    return judge(stats, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
