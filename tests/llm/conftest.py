import pytest


@pytest.fixture(scope="session")
def tables(sf):
    import duckdb

    c = duckdb.connect()
    get = lambda q: c.execute(q).fetchall()
    return {"documents": get(f"select doc_id, text from '{sf}/documents.parquet'"), "benchmark": get(f"select item_id, text from '{sf}/benchmark.parquet'"), "embeddings": get(f"select vec_id, embedding, label from '{sf}/embeddings.parquet'")}
