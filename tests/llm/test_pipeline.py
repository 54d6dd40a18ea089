"""The pipeline against plain versions of its stages."""
import corpus_pipeline
from tests.llm import brute
from tests.llm.test_packing_search_sampling import check_pieces


def alive(texts):
    return {i: t for i, (t, removed) in texts.items() if not removed or brute.words(t)}


def test_pipeline(spark, sf_dir, rows):
    docs = {i: t for i, t in rows}
    want, stats = {}, {i: brute.rule_statistics(t) for i, t in rows}
    want["quality rules"] = docs = {i: t for i, t in docs.items() if stats[i][0] >= 50 and 100 * stats[i][6] <= 50 * stats[i][0]}  # too few labels for a rule
    want["line dedup"] = docs = alive({i: (t, gone) for i, (t, _, gone) in brute.drop_lines(docs.items()).items()})
    parts = brute.near_components(docs.items(), 5, 80)
    want["near dedup"] = docs = {i: t for i, t in docs.items() if parts[i][1] == i}
    gone = brute.removed_words(docs.items())
    kept = {i: [w.decode() for w, g in zip(brute.words(t), gone[i]) if not g] for i, t in docs.items()}
    want["substring dedup"] = docs = {i: " ".join(w) if any(gone[i]) else docs[i] for i, w in kept.items() if w or not gone[i]}
    at = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir).cache()
        assert at.columns == list(corpus_pipeline.COLUMNS)
        got = {r.doc_id: r.text for r in at.collect()}
        assert {i: t.split() if name == "substring dedup" else t for i, t in got.items()} == \
            {i: t.split() if name == "substring dedup" else t for i, t in want[name].items()}, name
        assert at.where("n_chars <> length(text)").count() == 0
    check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), docs.items(), 4096)


def test_stages_take_empty_tables(spark, sf_dir):
    at = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, at, sf_dir).count() == 0
