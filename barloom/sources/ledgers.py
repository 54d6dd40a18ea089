"""Prediction ledgers and evaluations: dated reads, write-once, lineage."""
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.functions import scalars as S

BASELINE_SOURCES = ("previous_close", "prev_close", "baseline_close", "current_close", "current_price")


def latest_date(ledger, bound=None):
    """Largest run date, and the bound itself when a ledger exists for it."""
    b = F.lit(bound).cast("date")
    return ledger.agg(F.max("run_date").alias("latest"),
                      F.max(F.when(F.col("run_date") == b, F.col("run_date"))).alias("exact_date"))


def scan_evaluations(evaluation, exclude=None):
    return evaluation if exclude is None else evaluation.where(F.col("market_date") != F.lit(exclude).cast("date"))


def recent_sessions(evaluation, n=5, date="market_date"):
    """Rows of the last n distinct sessions."""
    last = evaluation.select(date).distinct().orderBy(F.desc(date)).limit(n)
    return evaluation.join(last, date, "left_semi")


def baseline_columns(df, run_date, cutoff=None, version="v1", cost_pct=K.COST_PCT):
    """Ids, lineage and the no-change baseline of a prediction frame."""
    run = F.lit(run_date).cast("date") if isinstance(run_date, str) else run_date
    cut = run if cutoff is None else cutoff
    out = df.withColumns({"prediction_id": S.prediction_id(run, F.col("symbol"), cut, F.lit(version)),
                          "run_date": run, "cutoff_date": cut, "model_version": F.lit(version)})
    source = next((c for c in BASELINE_SOURCES if c in df.columns), None)
    if source is None:
        return out
    base = F.col(source)
    return out.withColumns({**{f"baseline_{c}": base for c in ("open", "high", "low", "close")},
                            "baseline_cost_pct": F.lit(cost_pct)})


def read_ledger(ledger, run_date, version="v1"):
    """Predictions of one date; lineage is added when the stored frame has none."""
    day = ledger.where(F.col("run_date") == F.lit(run_date).cast("date"))
    return day if "prediction_id" in day.columns else baseline_columns(day, run_date, version=version)


def binding_report(evaluation, ledger):
    """Lineage check of evaluations against the ledger, one row per prediction date."""
    a = ledger.select("symbol", F.col("run_date").alias("prediction_date"), "prediction_id").dropDuplicates(["symbol", "prediction_date"])
    b = evaluation.groupBy("symbol", "prediction_date").agg(F.count("*").alias("_n"))
    both = a.join(b, ["symbol", "prediction_date"], "full")
    known, seen = F.col("prediction_id").isNotNull(), F.col("_n").isNotNull()
    return both.groupBy("prediction_date").agg(
        F.count_if(known).alias("ledger_rows"), F.count_if(known & seen).alias("bound_rows"),
        F.count_if(known & ~seen).alias("missing"), F.count_if(~known).alias("extra"),
        F.count_if(F.coalesce(F.col("_n") > 1, F.lit(False))).alias("duplicates")).withColumn(
        "valid", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("duplicates") == 0))


def bind_evaluation(evaluation, ledger):
    """Evaluation rows with the prediction id of the ledger."""
    ids = ledger.select("symbol", F.col("run_date").alias("prediction_date"), "prediction_id").dropDuplicates(["symbol", "prediction_date"])
    return evaluation.drop("prediction_id").join(ids, ["symbol", "prediction_date"])


def json_rows(df, keys):
    """One JSON text per row, missing and non-finite numbers written as null."""
    names = [c for c in df.columns if c not in keys]
    types = dict(df.dtypes)
    body = F.struct(*[(S.finite(c) if types[c] in ("double", "float") else F.col(c)).alias(c) for c in names])
    return df.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("doc"))


def read_json_rows(df, schema, doc="doc"):
    """The fields of a JSON text per row next to the other columns; text that is not JSON gives nulls."""
    parsed = df.withColumn("_j", F.from_json(doc, schema, {"mode": "PERMISSIVE"})).drop(doc)
    return parsed.select(*[c for c in parsed.columns if c != "_j"], "_j.*")


def _partition(spark, path, column, value):
    """Stored rows of one partition, or None where it does not exist."""
    try:
        df = spark.read.option("basePath", path).parquet(f"{path}/{column}={value}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return df


def write_ledger_once(spark, path, df, run_date):
    """Store the predictions of a date; a second write must carry the same ids.

    Returns "WRITTEN" or "UNCHANGED"; raises ValueError where the stored ledger
    differs, is corrupt, or the new frame is not fit to be stored.
    """
    from barloom.operators.quality import validate_ledger
    old = _partition(spark, path, "run_date", run_date)
    if old is not None and not old.isEmpty():
        if not validate_ledger(old).first()["valid"]:
            raise ValueError("stored ledger is corrupt and is not overwritten")
        a, b = old.select("prediction_id"), df.select("prediction_id")
        if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
            raise ValueError("ledger is immutable: the stored ids differ")
        return "UNCHANGED"
    if df.isEmpty() or not validate_ledger(df).first()["valid"]:
        raise ValueError("predictions fail the identity, price or bucket checks")
    df.drop("run_date").write.mode("errorifexists").parquet(f"{path}/run_date={run_date}")
    return "WRITTEN"


def write_evaluation_once(spark, path, evaluation, ledger, market_date):
    """Store the evaluation of a date, bound to the ledger; the first write wins."""
    day = F.lit(market_date).cast("date")
    dates = [r[0] for r in evaluation.select("prediction_date").distinct().limit(2).collect()]
    if len(dates) != 1:
        raise ValueError("an evaluation refers to exactly one prediction date")
    if evaluation.where(F.col("prediction_date") > day).limit(1).count():
        raise ValueError("the prediction date lies after the market date")
    mine = ledger.where(F.col("run_date") == F.lit(dates[0]))
    report = binding_report(evaluation, mine).first()
    if not report["valid"]:
        raise ValueError(f"evaluation does not match the ledger: {report.asDict()}")
    if _partition(spark, path, "market_date", market_date) is not None:
        return "UNCHANGED"
    bound = bind_evaluation(evaluation, mine).drop("market_date")
    bound.write.mode("errorifexists").parquet(f"{path}/market_date={market_date}")
    return "WRITTEN"
