"""The registered corpus queries against their SQL, and the shape of the others' results."""

import pytest
from compare import compare, oracle

from gridmere.llm import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    ok, _, _, message = compare(spark, oracle(sf), sf, name, QUERIES[name], ORACLES[name])
    assert ok, message


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op1_simhash_near_dedup", "doc_id fingerprint component_id"),
        ("op5_toxicity", "doc_id held_out score predicted"),
        ("op7_sharding", "doc_id size text_crc32 law shard slot grown_shard"),
        ("op8_token_files", "doc_id start n_tokens ids_crc32"),
        ("op13_suffix_array_dedup", "doc_id n_bytes n_removed n_spans kept_sha256"),
    ],
)
def test_one_row_per_document(spark, sf, name, columns):
    made = QUERIES[name](spark, sf)
    assert made.columns == columns.split()
    ids = sorted(r["doc_id"] for r in made.collect())
    assert ids == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
