"""op4: documents without lines that repeat an earlier line up to one word."""
from pyspark.sql import functions as F

from barloom.llm.line_dedup import drop_lines
from barloom.llm.registry import WORDS, query, table

SQL = f"""
WITH occ AS (SELECT doc_id, pos, l, {WORDS.format('l')} AS w, CAST(doc_id AS HUGEINT) * 10000000000 + pos AS ord
             FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)),
k AS (SELECT *, array_to_string(w, ' ') AS key, len(w) AS n FROM occ),
d AS (SELECT key, min(ord) AS first, any_value(w) AS w, any_value(n) AS n FROM k WHERE n >= 3 GROUP BY key),
v AS (SELECT key, first, n, i, array_to_string(list_concat(w[1:i-1], w[i+1:]), ' ') AS v FROM d, unnest(range(1, n + 1)) AS t(i) WHERE n >= 8),
near AS (SELECT a.key FROM v AS a JOIN (SELECT v, i, n, min(first) AS f FROM v GROUP BY v, i, n) AS b USING (v, i, n) WHERE b.f < a.first
         UNION SELECT a.key FROM v AS a JOIN d AS b ON a.v = b.key WHERE b.n >= 8 AND b.first < a.first
         UNION SELECT b.key FROM v AS a JOIN d AS b ON a.v = b.key WHERE b.n >= 8 AND a.first < b.first),
marked AS (SELECT k.doc_id, k.pos, k.l, coalesce(d.first < k.ord OR k.key IN (SELECT key FROM near), false) AS gone
           FROM k LEFT JOIN d USING (key)),
done AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS t FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN done USING (doc_id)
"""


@query("op4_line_dedup", SQL)
def op4_line_dedup(spark, sf_dir):
    done = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
