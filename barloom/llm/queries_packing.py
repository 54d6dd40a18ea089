"""op3: documents packed into sequences of several permitted lengths."""
from barloom.llm.packing import pack
from barloom.llm.registry import query, table


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "piece", "start", "n_words", "bin_id", "bin_offset", "capacity")
