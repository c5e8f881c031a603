"""The driver's contract, and that the engine stands without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_stands_alone(tmp_path):
    for name in os.listdir(ROOT):
        src = os.path.join(ROOT, name)
        if name in ("barloom", "__spark_entry__.py"):
            (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "barloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["bars_tick", "feat_mr_z", "upsert_merge", "seen_dedupe", "near_peak_workers"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(e.oracle_sql()[name])
    columns = sorted(want.columns)
    got = e.queries()[name](spark, DATA).select(*columns).collect()
    norm = lambda rows: sorted(repr(tuple(round(float(v), 6) if isinstance(v, (int, float)) else v for v in r)) for r in rows)
    assert norm(got) == norm(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["cv_summary", "regime_summary", "stress_grid"])
def test_queries_take_every_genome(spark, name):
    import __spark_entry__ as e
    from barloom.plans.fixtures import GENOMES

    assert {r.genome_id for r in e.queries()[name](spark, DATA).select("genome_id").collect()} == {i for i, *_ in GENOMES}


def test_demo_has_its_default_size(spark):
    import __spark_entry__ as e

    assert e.queries()["demo_ohlcv"](spark, DATA).count() == 120_000
