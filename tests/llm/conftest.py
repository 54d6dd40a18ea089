import numpy as np
import pytest

from tests.llm import brute


@pytest.fixture(scope="session")
def rows():
    return brute.corpus()


@pytest.fixture(scope="session")
def documents(spark, rows):
    """The corpus with the columns of documents and one whose name an operator uses itself."""
    return spark.createDataFrame([(i, t, "ab"[i % 2] if i % 5 else None, f"src{i % 3}", len(t or ""), "x") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(3)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("false")


@pytest.fixture(scope="session")
def sf_dir(spark, documents, tmp_path_factory):
    """A folder with the tables that the queries read."""
    folder = str(tmp_path_factory.mktemp("tables"))
    documents.drop("n_words").write.parquet(f"{folder}/documents.parquet")
    documents.selectExpr("doc_id", "int(doc_id % 4 > 0) quality", "int(doc_id % 7 = 0) toxic").write.parquet(f"{folder}/labels.parquet")
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[::9] = x[0]
    vectors = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    vectors += [(1000, None, 0), (1020, [0.0] * 12, 0), (1040, [float("nan")] + [1.0] * 11, 0), (1060, [None] + [1.0] * 11, 0), (1080, [float("inf")] + [1.0] * 11, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder
