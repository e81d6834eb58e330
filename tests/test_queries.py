import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(set(__spark_entry__.oracle_sql()) & set(__spark_entry__.queries()))
#: The twins of these walk whole graphs; the rest of the chain is covered by the others.
SLOW = {"json_result_roundtrip", "frame_flags", "relabel_known_empty", "temporal_status_names", "near_zone_rule", "component_features", "component_shape", "assist_filter", "connected_components_native"}


@pytest.fixture(scope="module")
def twin():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SLOW])
def test_query_equals_its_twin(spark, twin, name):
    own = __spark_entry__.queries()[name](spark, SF)
    found = twin.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(own.columns)
    assert rows(own.columns, own.collect()) == rows(names, found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
