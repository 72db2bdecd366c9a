"""Every registered query of the core against its SQL on the smallest tables."""

import importlib.util
import sys
from pathlib import Path

import duckdb
import pytest

from factorloom import catalog
from factorloom.plans import expr, registry


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple("-" if v is None or v != v else f"{v + 0.0:.5g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, db, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLE:
        assert _rows(got) == _rows(db.execute(catalog.ORACLE[name]).df())
    else:
        assert len(got)


def test_the_seed_bank_holds_all_templates():
    own = [e for e in registry.templates(registry.CROSS_SECTION) if expr.only_uses(e, "crypto")]
    assert own == list(catalog.SEED_BANK)


def test_entry(spark, sf):
    spec = importlib.util.spec_from_file_location("entry_point", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    row = module.entry(spark).first()
    assert row["valid_times"] > 0 and -1 <= row["score"] <= 1
    assert set(module.oracle_sql()) <= set(module.queries())
    sys.modules.pop("entry_point", None)


def test_the_approaches_hold_what_the_generators_make():
    from factorloom.operators import candidates as C

    own = [e for e in registry.templates(registry.CROSS_SECTION) if "crypto." in e]
    for name, exprs in catalog.APPROACHES.items():
        assert [e for e in C.GENERATORS[name](own, 6) if C.realize(e).valid] == list(exprs)
