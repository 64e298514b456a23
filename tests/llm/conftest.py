import pytest


@pytest.fixture()
def work(spark, tmp_path, monkeypatch):
    """Intermediate tables in a folder of this test."""
    from lapsekit.llm import shared

    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    return shared.Work(spark, "test")


@pytest.fixture()
def docs(spark):
    """Makes documents of (doc_id, text) with columns that clash with names inside the operators."""

    def make(*rows):
        wide = [(i, t, "en", "src", None if t is None else len(t), 1, "x", 2, 3, 4) for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, doc int, token string, member int, key int, w int"
        return spark.createDataFrame(wide, schema).repartition(3)

    return make
