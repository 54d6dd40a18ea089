"""op6: documents without passages of 50 words that an earlier document has."""
from pyspark.sql import functions as F

from barloom.llm.registry import WORDS, query, table
from barloom.llm.substring import remove_repeats

SQL = f"""
WITH w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 49) AS g FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
m AS (SELECT g, min(doc_id) AS f FROM g GROUP BY g),
bad AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM g JOIN m USING (g) WHERE f < doc_id), unnest(range(0, 50)) AS t(k)),
words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n_words, count(bad.p) AS n_removed,
                string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE bad.p IS NULL) AS t
         FROM words LEFT JOIN bad USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op6_substring_dedup", SQL)
def op6_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = remove_repeats(docs, window=50, join_words=True)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
