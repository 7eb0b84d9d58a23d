import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "conversations", "embeddings", "labels")
NAMES = ["pretoken_counts", "special_segments", "pair_postings", "pair_posting_lists", "bpe_merges", "bpe_merges_distributed", "bpe_vocab", "bytes_repr", "vocab_json", "merges_text", "token_frequency", "token_stream_stats", "pretoken_spans", "doc_token_counts", "embedding_lookup", "transformer_block", "transformer_lm", "encode_with_specials", "token_stream_sha256", "streaming_encode", "chunk_boundaries", "swiglu", "mha_rope", "grad_clip"]


def plain(rows, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    import duckdb

    from corpusloom.plans import oracles, queries

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = queries.queries()[name](spark, SF)
    want = con.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), columns)


def test_entry_without_the_optional_parts(tmp_path):
    """A copy without the optional folders imports, and names the queries of the rest only."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "corpusloom"), tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    from corpusloom.plans import queries

    assert int(got.stdout) == len(queries.queries())


def test_missing_libraries_are_errors(tmp_path):
    """Only an absent subpackage is left out; one that lacks a library is an error."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "corpusloom"), tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpusloom" / "llm").mkdir()
    (tmp_path / "corpusloom" / "llm" / "__init__.py").touch()
    (tmp_path / "corpusloom" / "llm" / "queries.py").write_text("import a_library_that_is_not_there")
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert got.returncode and "a_library_that_is_not_there" in got.stderr
