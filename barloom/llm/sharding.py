"""Shards by a permutation-filled lookup table; DataFrame functions only.

Every shard has its own preference order over the slots of a table of prime size: slot
(offset + j * skip) mod size is its j-th choice, offset and skip from hashes of its name.
The shards take turns; in its turn a shard claims the free slot that stands first in its
order. So shares differ by one slot at most, and when a shard comes or goes most slots keep
their owner. A key is placed by one hash and one look into the table.

The table has ``size`` rows, a parameter of at most ``MOST`` that does not depend on the
data, so it may be broadcast. Filling takes size**2 / 2 steps in one task, also independent
of the data.
"""
from pyspark.sql import functions as F

MOST = 20_011


def _hash(column):
    """60 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(F.encode(column, "UTF-8")), 1, 15), 16, 10).cast("long")


def _inverse(x, prime):
    """x ** (prime - 2) mod prime by squaring, the inverse of x."""
    bits = F.array(*[F.lit(int(b)) for b in reversed(bin(prime - 2)[2:])])
    start = F.struct(F.lit(1).cast("long").alias("r"), x.cast("long").alias("b"))
    return F.aggregate(bits, start, lambda s, bit: F.struct(
        F.when(bit == 1, s["r"] * s["b"] % prime).otherwise(s["r"]).alias("r"), (s["b"] * s["b"] % prime).alias("b")), lambda s: s["r"])


def lookup_table(shards, size):
    """(slot, shard) for a DataFrame of distinct shard names in its column ``shard``.

    The names in ascending order take turns; null and repeated names count once or not at
    all. No shard gives an empty table. ``size`` must be prime, above the number of shards.
    """
    if size > MOST or size < 3 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"size must be a prime of at most {MOST}")
    prefer = shards.where("shard is not null").select("shard").distinct().select(F.struct(
        "shard", (_hash(F.concat(F.lit("offset:"), "shard")) % size).alias("offset"),
        _inverse(_hash(F.concat(F.lit("skip:"), "shard")) % (size - 1) + 1, size).alias("back")).alias("s"))
    order = prefer.agg(F.sort_array(F.collect_list("s")).alias("s")).where("size(s) > 0")

    many = F.greatest(F.size("s"), F.lit(1))  # also where the filter above is evaluated later

    def turn(state, t):
        own = F.get("s", (t % many).cast("int"))
        # place of a free slot in the shard's order, ahead of the slot itself
        ranked = F.transform(state["free"], lambda x: F.pmod((x - own["offset"]) * own["back"], F.lit(size).cast("long")) * size + x)
        claimed = F.array_min(ranked) % size
        return F.transform(F.array(claimed), lambda c: F.struct(F.array_remove(state["free"], c).alias("free"),
                                                                F.concat(state["claims"], F.array(c)).alias("claims")))[0]

    start = F.struct(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")).alias("free"), F.array().cast("array<long>").alias("claims"))
    turns = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
    return (order.select("s", F.aggregate(turns, start, turn, lambda x: x["claims"]).alias("claims"))
            .select("s", F.posexplode("claims").alias("t", "slot"))
            .select("slot", F.get("s", (F.col("t") % many).cast("int"))["shard"].alias("shard")))


def place(docs, table, size, key_col="doc_id"):
    """docs with ``slot`` (long) and ``shard``; these replace columns of the same names.

    Equal keys get equal shards; a null key is placed like the text 'null'. With an empty
    lookup table the shard is null.
    """
    names = [c for c in docs.columns if c not in ("slot", "shard")]
    key = _hash(F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit("null"))) % size
    slots = F.broadcast(table.select(F.col("slot").alias("_slot"), "shard"))
    placed = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], key.alias("slot")).join(slots, F.col("slot") == F.col("_slot"), "left")
    return placed.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], "slot", "shard")


def moved(before, after):
    """(from_shard, to_shard, slots) of the slots two tables of one size give to different shards."""
    both = before.select("slot", F.col("shard").alias("from_shard")).join(after.select("slot", F.col("shard").alias("to_shard")), "slot")
    return both.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count("*").alias("slots"))
