"""The registered queries: those with SQL against it, the others for their columns."""

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from loomspan.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_simhash": "doc_id fingerprint component_id", "op3_html_text": "page_id url text n_chars", "op4_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op5_url_filter": "page_id host path rule verdict", "op6_mixing": "doc_id size source_size target taken", "op7_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op9_warc": "page_id payload_bytes payload_digest record_type refers_to", "op10_quality_cascade": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op11_phrases": "lang rank phrase a l r n score",
    "op12_conversation_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", "op13_token_counts": "doc_id n_bytes n_tokens over_limit",
}


def test_there_is_one_query_for_each_operator():
    assert set(queries.queries()) == set(COLUMNS) and set(queries.oracle_sql()) <= set(COLUMNS) and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert queries.queries()[name](spark, SF).columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df, relation = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert Counter(map(tuple, df.select(*relation.columns).collect())) == Counter(relation.fetchall())
