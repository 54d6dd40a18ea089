"""Quality rules with risk-controlled cutoffs; DataFrame functions only.

Every rule compares a whole-number statistic (per mille) with a cutoff. Labelled documents
are the holdout: for each stratum, rule and cutoff of a fixed grid, the good documents the
cutoff would reject are counted, and the exact binomial tail tells whether a rejection rate
above the allowed one can be ruled out. The allowed rate of a stratum is divided over the
rules, the error level over all strata, rules and cutoffs (Bonferroni), so with probability
1 - ``error`` no stratum loses more than ``loss`` of its good documents to the rules,
whichever certified cutoffs are used. Of the certified cutoffs the one is taken that rejects
most bad documents, each rejected good one counted against it ``price`` times; ties go to
the more lenient. A rule without a certified and useful cutoff rejects nothing there.
"""
from pyspark.sql import functions as F

from barloom.llm.staging import stored

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GRID = (20, 50, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900, 1000, 1500, 2000)
#: rule: numerator and denominator of its statistic
RULES = {"symbols": ("n_symbols", "n_words"), "upper": ("n_upper", "word_chars"),
         "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}
STATS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")
BROADCAST_ROWS = 10_000  # a larger table of cutoffs is joined by a shuffle


def _without(column, characters):
    return F.length(F.translate(column, characters, ""))


def _repeated_words(windows):
    """Words in windows of three that occur twice or more, from the array of window hashes.

    Sorting (hash, place) puts equal windows side by side; the places of windows that equal
    a neighbour, in order, cover min(3, distance to the next) words each.
    """
    def places(s):
        beside = F.arrays_zip(s.alias("s"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), s).alias("p"),
                              F.slice(s, 2, F.greatest(F.size(s), F.lit(1))).alias("n"))
        same = F.filter(beside, lambda x: (x["s"]["h"] == x["p"]["h"]) | (x["s"]["h"] == x["n"]["h"]))
        return F.sort_array(F.transform(same, lambda x: x["s"]["i"]))

    def covered(p):
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda t, x: t + x)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # one-element arrays hold a value for several uses, so that it is computed once
    count = F.transform(F.transform(F.array(placed), places), covered)[0]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(count).cast("long")


def with_statistics(docs, text_col="text"):
    """docs with the columns of ``STATS`` (long) for each whole text; they replace columns of these names.

    Words are runs of characters other than space and \\t \\n \\v \\f \\r; lines are split at \\n
    and count if they have a word. Null counts as the empty text: all statistics are 0. Rows are
    treated one by one, so repeated rows are nothing special; other columns keep their names,
    whatever they are. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANK, "")) > 0)
    names = [c for c in docs.columns if c not in STATS]
    kept = [f"_c{i}" for i in range(len(names))]
    held = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, kept)], text.alias("_t"), lines.alias("_l"), F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "").alias("_w"))
    n = F.greatest(F.size("_w") - 2, F.lit(0))
    windows = F.transform(F.arrays_zip(F.slice("_w", 1, n).alias("a"), F.slice("_w", F.lit(2), n).alias("b"), F.slice("_w", F.lit(3), n).alias("c")),
                          lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    held = held.withColumn("_h", windows)
    statistics = F.struct(
        F.size("_w").cast("long").alias("n_words"), _without("_t", BLANK).cast("long").alias("word_chars"),
        (F.length("_t") - _without("_t", SYMBOLS)).cast("long").alias("n_symbols"), (F.length("_t") - _without("_t", UPPER)).cast("long").alias("n_upper"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_h")).alias("n_repeat_words"))
    # one row from one: a later filter on the statistics is not pushed below, where each use would compute them again
    return held.select(*kept, F.explode(F.array(statistics)).alias("_x")).select(*[F.col(k).alias(c) for c, k in zip(names, kept)], "_x.*")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _statistic(rule):
    top, below = RULES[rule]
    return F.when(F.col(below) > 0, F.expr(f"(1000 * {top}) div {below}")).otherwise(F.lit(0))


def _most_allowed(n, rate, level):
    """The largest k with P(Bin(n, rate) <= k) <= level, or -1; exact tail, summed in logarithms."""
    first = n * F.log(F.lit(1.0) - rate)
    start = F.struct(first.alias("term"), first.alias("sum"), F.when(first <= F.log(level), 0).otherwise(-1).cast("long").alias("best"))

    def step(s, k):
        term = s["term"] + F.log((n - k + 1) / k) + F.log(rate / (F.lit(1.0) - rate))
        total = F.greatest(s["sum"], term) + F.log1p(F.exp(-F.abs(s["sum"] - term)))
        return F.struct(term.alias("term"), total.alias("sum"), F.when(total <= F.log(level), k).otherwise(s["best"]).cast("long").alias("best"))

    # beyond the mean the tail is above one half, so the sum can end there
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.floor(n * rate)).cast("long")), start, step, lambda s: s["best"])


def certified_cutoffs(stats, labels, stratum="lang", id_col="doc_id", loss=0.05, error=0.05, price=10):
    """(stratum, rule, cutoff, n_good, n_false, n_allowed, n_caught): the cutoff in force of each rule.

    ``labels`` has ``id_col`` and ``quality`` (1 good, 0 bad); a document with several labels is
    good only if all say so, and null ids or labels are left out. A null stratum is the stratum ''.
    Only documents that pass the base tests count. Rows of stats with equal ids each count with their
    id's label. The binomial sums take as many steps as good documents may be lost in a stratum.
    No labels or no documents give an empty table; other columns are not read.
    """
    labels = labels.where(f"`{id_col}` is not null and quality is not null").groupBy(id_col).agg(F.min("quality").alias("_q"))
    held = (stats.where(~base_failed()).select(id_col, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                                                *[_statistic(r).alias(r) for r in RULES]).join(labels, id_col))
    held = stored(held, "rules")  # read twice below
    long = held.select("stratum", "_q", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("x")) for r in RULES])).alias("s"))
    tested = long.groupBy("stratum", F.col("s.rule").alias("rule")).agg(
        F.count_if(F.expr("_q = 1")).alias("n_good"),
        *[F.count_if(F.expr(f"_q = 1 and s.x > {g}")).alias(f"f{g}") for g in GRID],
        *[F.count_if(F.expr(f"_q = 0 and s.x > {g}")).alias(f"c{g}") for g in GRID])
    strata = tested.agg(F.count_distinct("stratum"))
    tests = F.col("_s") * len(RULES) * len(GRID)
    tested = tested.withColumn("_s", strata.scalar()).withColumn(
        "n_allowed", _most_allowed(F.col("n_good"), F.lit(loss / len(RULES)), F.lit(error) / tests))
    each = F.explode(F.array(*[F.struct(F.lit(g).cast("long").alias("cutoff"), F.col(f"f{g}").alias("n_false"), F.col(f"c{g}").alias("n_caught"))
                               for g in GRID])).alias("g")
    good = tested.select("stratum", "rule", "n_good", "n_allowed", each).where("g.n_false <= n_allowed and g.n_caught > " + f"{price} * g.n_false")
    best = F.max(F.struct((F.col("g.n_caught") - price * F.col("g.n_false")).alias("gain"), F.col("g.cutoff").alias("cutoff"),
                          F.col("g.n_false").alias("n_false"), F.col("g.n_caught").alias("n_caught"))).alias("b")
    return (good.groupBy("stratum", "rule", "n_good", "n_allowed").agg(best)
            .select("stratum", "rule", "b.cutoff", "n_good", "b.n_false", "n_allowed", "b.n_caught"))


def judge(stats, cutoffs, stratum="lang"):
    """stats with ``base_failed`` and ``kept``; cutoffs: a stored result of certified_cutoffs.

    A null stratum has the cutoffs of the stratum ''; without cutoffs only the base tests count.
    Repeated rows are judged alike, columns of these two names are replaced, others keep their
    names, whatever they are. An empty table gives an empty table.
    """
    wide = cutoffs.groupBy(F.col("stratum").alias("_s")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES])
    if wide.count() <= BROADCAST_ROWS:  # as many rows as certified strata
        wide = F.broadcast(wide)
    names = [c for c in stats.columns if c not in ("base_failed", "kept")]
    held = stats.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], base_failed().alias("_failed"),
                        F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("_k"), *[_statistic(r).alias(f"_of_{r}") for r in RULES])
    failed = F.lit(False)
    for r in RULES:
        failed = failed | F.coalesce(F.col(f"_of_{r}") > F.col(f"_cut_{r}"), F.lit(False))
    joined = held.join(wide, F.col("_k") == F.col("_s"), "left")
    return joined.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], F.col("_failed").alias("base_failed"), (~F.col("_failed") & ~failed).alias("kept"))
