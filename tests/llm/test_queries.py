"""The registered queries: names, columns, and their SQL where there is one."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tillroll.llm.queries import ORACLE, QUERIES

SF001 = "/root/testdata/sf0.001"

COLUMNS = {
    "op2_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_main_text": ["page_id", "url", "text", "n_chars"],
    "op5_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_exact_top_k": ["query_id", "rank", "vec_id", "score"],
    "op11_centroid_clustering": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op12_hilbert_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op13_filter_audit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                          "toxic_lost", "shapley"],
}


def test_all_queries_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_sql(spark, name):
    got = entry.queries()[name](spark, SF001)
    assert got.columns == COLUMNS[name]
    if name in ORACLE:
        con = duckdb.connect()
        for table in ("documents", "embeddings", "labels"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF001}/{table}.parquet')")
        want = con.execute(ORACLE[name])
        names = [d[0] for d in want.description]
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_entry_without_the_training_data_files():
    """Without corpus_pipeline.py and the subpackage the other queries are still there."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('tillroll.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'growth_month' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())
assert set(e.oracle_sql()) == set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])
