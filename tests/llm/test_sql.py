"""The queries with SQL against it, and all others for their shape."""

import glob
from pathlib import Path

import duckdb
import pytest

from tensorweft.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_warc": "page_id payload_bytes payload_digest record_type refers_to", "op2_simhash": "doc_id fingerprint component_id", "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated", "op5_url_filter": "page_id host path rule verdict", "op6_html": "page_id url text n_chars",
    "op7_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op8_substring_dedup": "doc_id n_words n_removed kept_sha256", "op9_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op10_mixing": "doc_id size source_size target taken",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return db


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    rows = [r.asDict() for r in out.collect()]
    source = "pages" if name in ("op1_warc", "op5_url_filter", "op6_html") else "documents"
    assert len(rows) == duck.sql(f"SELECT count(*) FROM {source}").fetchall()[0][0]
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        names = sorted(want.columns)
        assert names == sorted(out.columns)
        key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted((key(r[n] for n in names) for r in rows), key=repr) == sorted(map(key, want.select(", ".join(names)).fetchall()), key=repr)
