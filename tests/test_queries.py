"""Every registered query of the ingestion engine against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quarry import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    texts = {c: (pd.to_numeric(pdf[c]).astype(float) if pdf[c].dtype.kind in "iuf" or str(pdf[c].dtype) == "Int64" else pdf[c].astype(str)) for c in pdf.columns}
    return pd.DataFrame(texts).sort_values(list(texts)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query_equals_sql(spark, db, sf_dir, name):
    got = rows(core.QUERIES[name](spark, sf_dir).toPandas())
    want = rows(db.execute(core.ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)
