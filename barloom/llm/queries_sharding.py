"""op2: documents dealt to shards by a permutation-filled table."""
from pyspark.sql import functions as F

from barloom.llm.registry import query, table
from barloom.llm.sharding import lookup_table, place
from barloom.llm.staging import stored

SHARDS, SIZE = 32, 4099

_HASH = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
SQL = f"""
WITH RECURSIVE s AS (SELECT i, {_HASH.format("'offset:' || n")} % {SIZE} AS o, {_HASH.format("'skip:' || n")} % {SIZE - 1} + 1 AS k
                     FROM (SELECT i, 'shard-' || printf('%03d', i) AS n FROM range(0, {SHARDS}) AS t(i))),
prefer AS (SELECT i, list((o + j * k) % {SIZE} ORDER BY j) AS p FROM s, range(0, {SIZE}) AS t(j) GROUP BY i),
turns AS (SELECT CAST(-1 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS slot, [CAST(false AS BOOLEAN) FOR x IN range(0, {SIZE})] AS used
          UNION ALL
          SELECT t + 1, c, used[1:c] || [true] || used[c + 2:] FROM (
              SELECT t, used, list_filter(prefer.p, lambda x: NOT used[x + 1])[1] AS c
              FROM turns JOIN prefer ON prefer.i = (turns.t + 1) % {SHARDS} WHERE t + 1 < {SIZE})),
owner AS (SELECT slot, 'shard-' || printf('%03d', t % {SHARDS}) AS shard FROM turns WHERE t >= 0),
placed AS (SELECT doc_id, {_HASH.format("coalesce(CAST(doc_id AS VARCHAR), 'null')")} % {SIZE} AS slot FROM documents)
SELECT doc_id, slot, shard FROM placed JOIN owner USING (slot)
"""


@query("op2_sharding", SQL)
def op2_sharding(spark, sf_dir):
    shards = spark.range(SHARDS).select(F.format_string("shard-%03d", "id").alias("shard"))
    slots = stored(lookup_table(shards, SIZE), "slots")
    return place(table(spark, sf_dir, "documents").select("doc_id"), slots, SIZE).select("doc_id", "slot", "shard")
