"""Every registered query runs and keeps its contract; those with SQL agree with it (see ``verify.py``)."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from furrow import catalog


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"country", "allocated", "winners"}


def test_names():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_corpus_operators(tmp_path, pipeline):
    """The rest of the library is whole where ``furrow/llm`` is absent, whether or not ``corpus_pipeline.py`` is."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "furrow", tmp_path / "furrow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if pipeline and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 150 and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin"})


def test_queries_agree_with_sql(spark, small):
    import glob

    import duckdb

    from verify import rows_of

    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{f}'")
    chosen = ["s1_read_cells", "s10_field_size_submissions", "t6_spearman", "t11_quota_cutoff", "t12_quota_allocate", "t13_quota_allocate_nearest", "t26_tillage_classes", "a2_country_totals", "d8_histogram_auto", "g7_resample_bilinear", "g13_focal_box", "g17_fill_nearest", "g20_allocate_country", "g25_points_within", "r24_barest_date", "k9_tillage_window", "m6_patch_composite", "m12_split", "m13_nearest_of_class", "m16_roc_auc", "g4_resample_nearest", "g14_focal_circle", "m22_information_gain"]
    for name in chosen:
        df = catalog.QUERIES[name](spark, small)
        res = con.execute(catalog.ORACLE_SQL[name])
        cols = [c[0] for c in res.description]
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall()), name
