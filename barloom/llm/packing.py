"""Best-fit packing into bins of several permitted lengths.

Best fit in descending order depends on the lengths only, so it is planned on the histogram
of lengths: at most ``max(sizes)`` rows whatever the data. Items of equal length are placed
together: a run of bins with equal contents takes as many as fit, which is what one-by-one
best fit does, since a bin just filled is the tightest for the next item while it fits. The
plan is a list of runs (length, first rank, items per bin, bins); every item then finds its
bin from its rank among the items of its length. Ranks are a count within (length, hash
bucket) plus the counts of the buckets before, so a length that most items have is ranked in
as many tasks as there are buckets.

All sizes share one pool of open bins. When nothing fits, the size with the least cost per
unit of those that hold the item is opened; at the end every bin shrinks to the cheapest
size that holds its contents.
"""
from bisect import bisect_left, insort

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.llm.staging import stored

SIZES = (512, 1024, 2048, 4096)
BROADCAST_RUNS = 200_000  # a longer plan is joined by a shuffle
RUN = "length long, first long, items long, each long, bin long, at long, capacity long"


def sequence_cost(size):
    """Cost of a sequence: its length, an overhead each, and attention that grows with the square."""
    return size + 96 + size * size / 16384


def _split(run, bins):
    """A run of bins cut after some bins; ranks of the second part start later."""
    first, count, size, used, held = run
    rest = [(length, rank + bins * each, each, at) for length, rank, each, at in held]
    return (first, bins, size, used, held), (first + bins, count - bins, size, used, rest)


def plan(histogram, sizes=SIZES, cost=sequence_cost):
    """Runs of the packing of {length: count}: tuples as in ``RUN``; lengths at most max(sizes)."""
    open_runs, levels, done, bins = {}, [], [], 0

    def put(run):
        room = run[2] - run[3]
        if room:
            if room not in open_runs:
                insort(levels, room)
                open_runs[room] = []
            insort(open_runs[room], run)
        else:
            done.append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(levels, length)
            if k < len(levels):
                room = levels[k]
                run = open_runs[room].pop(0)
                if not open_runs[room]:
                    del open_runs[room], levels[k]
            else:
                size = min((s for s in sizes if s >= length), key=lambda s: (cost(s) / s, s))
                room = size
                run = (bins, -(-left // (size // length)), size, 0, [])
                bins += run[1]
            each = min(room // length, left)  # the last bin may take fewer
            full = min(run[1], left // each)
            if full < run[1]:
                run, rest = _split(run, full)
                put(rest)
            put((run[0], full, run[2], run[3] + each * length, run[4] + [(length, rank, each, run[3])]))
            left, rank = left - full * each, rank + full * each
    for runs in open_runs.values():
        done += runs
    out = []
    for first, count, _, used, held in done:
        capacity = min((s for s in sizes if s >= used), key=lambda s: (cost(s), s))
        out += [(length, rank, count * each, each, first, at, capacity) for length, rank, each, at in held]
    return out


def pack(docs, text_col="text", id_col="doc_id", sizes=SIZES, cost=sequence_cost):
    """Pieces of all texts with their place: the columns of docs, the text cut to the piece (its
    words joined by a space), and ``piece``, ``start``, ``n_words``, ``bin_id``, ``bin_offset``,
    ``capacity`` (long), which replace columns of these names.

    A text longer than the largest size is cut into full pieces and a rest. A text without words
    (null, empty) is one piece of 0 words, without a bin. Rows with equal or null ids are packed
    each for itself; which of them gets which of two like places may change between runs. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    most, own = max(sizes), ("piece", "start", "n_words", "bin_id", "bin_offset", "capacity")
    names = [c for c in docs.columns if c not in own]
    inner = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names) if c != text_col]
    words = F.array_remove(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), "")
    held = docs.select(*inner, F.col(f"`{id_col}`").alias("_id"), words.alias("_w"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("_w") / most).cast("int") - 1)),
                      lambda i: F.struct(i.cast("long").alias("piece"), F.slice("_w", i * most + 1, most).alias("w")))
    kept = [c for c in held.columns if c.startswith("_c")]
    pieces = (held.select(*kept, "_id", F.explode(cut).alias("p"))
              .select(*kept, "_id", "p.piece", F.size("p.w").cast("long").alias("length"), F.array_join("p.w", " ").alias("_t")))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("_id", "piece"), F.lit(buckets)))
    counts = stored(pieces.where("length > 0").groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most max(sizes) rows
    runs = plan(histogram, sizes, cost)
    table = spark.createDataFrame(runs, RUN).withColumnRenamed("length", "_length")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    within = Window.partitionBy("length", "bucket").orderBy("_id", "piece")
    ranked = (pieces.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "bucket"], "left")
              .withColumn("rank", F.col("rank") + F.col("before")))
    placed = ranked.join(F.broadcast(table) if len(runs) <= BROADCAST_RUNS else table,
                         (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("items")), "left")
    nth = F.col("rank") - F.col("first")
    return placed.select(*[(F.col("_t") if c == text_col else F.col(f"_c{i}")).alias(c) for i, c in enumerate(names)],
                         "piece", (F.col("piece") * most).alias("start"), F.col("length").alias("n_words"),
                         (F.col("bin") + F.floor(nth / F.col("each"))).cast("long").alias("bin_id"),
                         (F.col("at") + nth % F.col("each") * F.col("length")).alias("bin_offset"), "capacity")


def sequences(pieces, id_col="doc_id", text_col="text"):
    """One row per bin: ``bin_id``, ``capacity``, ``n_words``, ``doc_ids`` and ``text`` in packed order.

    Pieces without a bin have no words and are left out. Texts are joined by newlines.
    """
    one = F.struct("bin_offset", F.col(id_col).alias("id"), F.col(text_col).alias("t"), "n_words").alias("p")
    packed = pieces.where("bin_id is not null").groupBy("bin_id", "capacity").agg(F.sort_array(F.collect_list(one)).alias("p"))
    return packed.select("bin_id", "capacity", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n_words"]).alias("n_words"),
                         F.transform("p", lambda x: x["id"]).alias("doc_ids"), F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))
