"""op5: documents drawn by importance resampling towards labelled good text."""
from barloom.llm.registry import query, table
from barloom.llm.resampling import resample


@query("op5_quality_resampling")
def op5_quality_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
