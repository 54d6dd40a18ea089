"""Repeated and nearly repeated lines: deletion neighbourhoods; DataFrame functions only.

A line is its sequence of words. Two lines of ``near_words`` words or more are near when one
word inserted, deleted or replaced turns one into the other. Every line then shares a variant
with its near lines: both with the same word place left out (replaced), or one whole and the
other with one word left out. Variants are emitted as hashed keys and each key is reduced to
the earliest line, by aggregates with a map-side part, so a variant that thousands of lines
share costs one row per task and never a pair of lines.

Lines that cannot have a near line emit nothing: two near lines agree in the first or in the
last half of their words, so a line whose halves occur in no other line has no neighbour. That
is a condition of the bound, not a sample. Keys are hashes of two sums of word hashes by place,
which prefix sums give for all variants of a line in one pass; the edit distance of every line
found and its earliest neighbour is then verified on the words.

The texts are the large part: they are dealt out by a hash of (id, text) once, for both the
reading of candidate lines and the writing of the result.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.llm.staging import stored

#: white space that a line can hold besides the space
OTHER = "\t\x0b\f\r"
MASK = (1 << 40) - 1


def _order(id_, pos):
    """Place of a line among all: by document id, then by line; null ids come last."""
    far = F.coalesce(id_, F.lit((1 << 63) - 1)).cast("decimal(20,0)")
    return (far * F.lit(10 ** 10).cast("decimal(11,0)") + pos.cast("decimal(10,0)")).cast("decimal(38,0)")


def _words(line):
    """Words of a line; a split at one character needs no regular expression, and few lines have other white space."""
    other = F.lit(False)
    for c in OTHER:
        other = other | F.contains(line, F.lit(c))
    return F.array_remove(F.split(F.when(other, F.translate(line, OTHER, " " * len(OTHER))).otherwise(line), " "), "")


def _halves(words, n):
    """Keys of the first and the last half, for n and, as a longer partner, for n - 1 words."""
    def key(side, h):
        return F.xxhash64(F.lit(side), h, F.slice(words, 1, h) if side == 0 else F.slice(words, -h, h))

    half = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.array(key(0, half), key(1, half))).otherwise(
        F.array(key(0, half), key(1, half), key(0, half - 1), key(1, half - 1)))


def _candidates(lines):
    """(h1) of the lines that may have a near line."""
    ends = lines.where("ends is not null").select("h1", F.explode("ends").alias("end"))
    common = ends.groupBy("end").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("end")
    return ends.join(common, "end").select("h1").distinct()


def _neighbours(held):
    """(ord, partner): the earliest line that is earlier and shares a variant, from (ord, n, w) dealt by ord."""
    at = held.select("ord", "n", F.posexplode("w").alias("j", "word"))
    at = at.select("ord", "n", "j", *[F.xxhash64("word", F.col("j") - back, F.lit(k)).bitwiseAND(MASK).alias(f"{x}{k}")
                                      for k in (1, 2) for x, back in (("a", 0), ("b", 1))])
    line = Window.partitionBy("ord")
    upto = line.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    left = at.select("ord", "n", "j", *[(F.sum(f"a{k}").over(upto) - F.col(f"a{k}") + F.sum(f"b{k}").over(line) - F.sum(f"b{k}").over(upto)).alias(f"v{k}") for k in (1, 2)],
                     *[F.sum(f"a{k}").over(line).alias(f"w{k}") for k in (1, 2)])
    # the line itself rides on its first word as place -1
    both = F.when(F.col("j") == 0, F.array(F.struct(F.col("j"), F.xxhash64("v1", "v2").alias("v")), F.struct(F.lit(-1).alias("j"), F.xxhash64("w1", "w2").alias("v")))
                  ).otherwise(F.array(F.struct(F.col("j"), F.xxhash64("v1", "v2").alias("v"))))
    variants = left.select("ord", F.explode(both).alias("x")).select("ord", "x.v", "x.j").where("v is not null and j is not null")
    group = variants.groupBy("v", "j").agg(F.min("ord").alias("first"), F.count("ord").alias("c"))
    key = group.groupBy("v").agg(F.min(F.when(F.col("j") < 0, F.col("first"))).alias("of_whole"), F.min(F.when(F.col("j") >= 0, F.col("first"))).alias("of_cut"),
                                 F.max(F.when(F.col("j") >= 0, F.col("c"))).alias("c")).where("c > 1 or (of_whole is not null and of_cut is not null)")
    # of lines with the same place left out, and of lines one shorter or longer
    # the count is always positive; it is named so that both readings of the groups share one exchange
    met = variants.join(key.select("v", "of_whole", "of_cut"), "v").join(group.where("c > 0").select("v", "j", "first"), ["v", "j"])
    partner = F.least(F.when(F.col("j") < 0, F.col("of_cut")).otherwise(F.col("of_whole")), F.when(F.col("j") >= 0, F.col("first")))
    return met.select("ord", partner.alias("partner")).where("partner < ord").groupBy("ord").agg(F.min("partner").alias("partner"))


def _within_one(a, b):
    """Whether one word edit or none turns array a into array b: common ends leave one word at most."""
    def common(x, y):
        place = F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False)
        return F.when(place == 0, F.size(x)).otherwise(place - 1)

    most = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= most - 1)


def drop_lines(docs, id_col="doc_id", text_col="text", same_words=3, near_words=8):
    """docs with the lines dropped that an earlier line repeats, and ``n_lines``, ``n_removed`` (long).

    Earlier: smaller document id, then smaller line number; a null id is later than all. A line of
    ``same_words`` words or more goes if an earlier line has the same words; of ``near_words`` or
    more also if an earlier line is within one word edit. Shorter lines and lines without words
    stay. Null and empty texts are returned as they are (null: no lines). Rows equal in id and
    text are treated alike: none is earlier than the other. Ids are taken to name one text: if they
    do not, lines of equal id and number tie, and which of them counts as earlier is not defined. Columns of docs named ``n_lines`` or
    ``n_removed`` are replaced. An empty table gives an empty table.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    base = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    id_, text = F.col(f"_c{names.index(id_col)}").cast("long"), F.col(f"_c{names.index(text_col)}")
    base = base.withColumn("_k1", F.xxhash64(id_, text)).withColumn("_k2", F.xxhash64(F.lit(1), id_, text))
    cut = base.select(id_.alias("_id"), "_k1", "_k2", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    seen = cut.select("_id", "_k1", "_k2", "pos", _words(F.col("line")).alias("w")).where(F.size("w") >= same_words)
    n = F.size("w")
    lines = stored(seen.select("_id", "_k1", "_k2", "pos", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"),
                               F.when(n >= near_words, _halves(F.col("w"), n)).alias("ends")), "lines")
    chosen = _candidates(lines)
    lines = lines.select("_k1", "_k2", "pos", "h1", "h2", _order(F.col("_id"), F.col("pos")).alias("ord"))
    repeated = (lines.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first <> last")
                .select("h1", F.col("h2").alias("_h2"), "first"))
    # most lines are neither; the others come out of one join
    wanted = stored(repeated.unionByName(chosen.select("h1", F.lit(None).cast("long").alias("_h2"), F.lit(None).cast("decimal(38,0)").alias("first"))), "lines")
    lines = stored(lines.join(wanted, "h1").where("_h2 is null or h2 = _h2 and ord > first"), "lines")
    spots = (lines.where("_h2 is null").groupBy("h1", "h2").agg(F.min(F.struct("ord", "pos", "_k1", "_k2")).alias("s")).select("s.*")
             .groupBy("_k1", "_k2").agg(F.collect_set(F.struct("pos", "ord")).alias("s")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.repartition(parts, "_k1", "_k2")
    # always the text; it names every column, so that this reading of the texts and the last share one exchange
    whole = F.when(F.size(F.array(F.xxhash64(*base.columns))) == 1, text)
    held = (dealt.join(spots, ["_k1", "_k2"]).select("_k1", "_k2", F.split(whole, "\n").alias("l"), F.explode("s").alias("s"))
            .select("_k1", "_k2", "s.pos", "s.ord", _words(F.col("l")[F.col("s.pos")]).alias("w")).where("ord is not null"))
    # one of equal rows
    held = held.withColumn("_r", F.row_number().over(Window.partitionBy("ord").orderBy("pos"))).where("_r = 1")
    # the words name every column, so that all readings of these lines share one exchange
    words = F.when(F.size(F.array(F.xxhash64("ord", "_k1", "_k2", "pos"))) == 1, F.col("w"))
    held = held.select("ord", F.size("w").alias("n"), words.alias("w"), "_k1", "_k2", "pos")
    near = _neighbours(held)
    near = (near.join(held.select("ord", "_k1", "_k2", "pos", F.col("w").alias("_a")), "ord")
            .join(held.select(F.col("ord").alias("partner"), F.col("w").alias("_b")), "partner").where(_within_one(F.col("_a"), F.col("_b"))))
    gone = (lines.where("_h2 is not null").select("_k1", "_k2", "pos").union(near.select("_k1", "_k2", "pos"))
            .groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("_gone")).select(F.col("_k1").alias("_g1"), F.col("_k2").alias("_g2"), "_gone"))
    # lines and dropped line numbers sorted together: a number stands right before its line
    both = F.sort_array(F.concat(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("t"))),
                                 F.transform("_gone", lambda i: F.struct(i.alias("i"), F.lit(None).cast("string").alias("t")))))
    beside = F.arrays_zip(F.col("_s").alias("s"), F.concat(F.array(F.lit(None).cast("struct<i:int,t:string>")), F.col("_s")).alias("p"))
    left = F.filter(beside, lambda x: x["s"]["t"].isNotNull() & ~x["s"]["i"].eqNullSafe(x["p"]["i"]))
    kept = F.array_join(F.transform(left, lambda x: x["s"]["t"]), "\n")
    out = dealt.join(gone, (F.col("_k1") == F.col("_g1")) & (F.col("_k2") == F.col("_g2")), "left")
    out = out.withColumn("_s", F.when(F.col("_gone").isNotNull(), both)).withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept).otherwise(text))
    return out.select(*[(F.col("_kept") if c == text_col else F.col(f"_c{i}")).alias(c) for i, c in enumerate(names)],
                      F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
