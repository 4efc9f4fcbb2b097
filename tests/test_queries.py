import math

import duckdb
import pytest

import __spark_entry__ as entry
from huetide.sources.fixtures import BASE
from tests.conftest import SF

#: A query of each kind; the driver holds every one against its SQL.
NAMES = ["prj01_colour_dimension", "prj03_substance_admission", "prj07_temporal_status", "prj10_admission_overrides", "agg03_paired_prevalence", "agg04_evidence_rollup", "agg08_palette_regime", "agg16_recurrence", "agg20_classifier_metrics",
         "jn03_colour_distance_join", "jn06_region_source_fallback", "win04_seen_changed", "win07_domain_rotation", "alg02_components", "alg06_medoid", "alg10_page_dates", "scl02_url_forms", "scl08_box_overlap", "str03_daily_prevalence"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", NAMES)
def test_like_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
