import subprocess
import sys
from pathlib import Path

import pytest
from compare import DATA

import __spark_entry__ as entry
from skylathe.session import checkpoint_dir, cut, cut_count, passing_cuts

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["ref_table", "ref_field", "period", "n_refs", "n_orphans"]
    assert df.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_text_operators():
    names = [".".join(p.with_suffix("").relative_to(ROOT).parts) for p in sorted((ROOT / "skylathe").rglob("*.py")) if "llm" not in p.parts and p.stem != "__init__"]
    code = f"import sys, importlib\nfor m in {names!r}:\n    importlib.import_module(m)\nassert not any(m.startswith('skylathe.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_cut_is_a_table_in_the_shared_folder(spark):
    df = spark.range(10).repartition(3)
    out, n = cut_count(df)
    assert n == 10 and out.count() == 10
    assert all(f.startswith(checkpoint_dir(spark).split("/")[0]) for f in out.inputFiles())
    assert "Range" not in cut(df)._jdf.queryExecution().executedPlan().toString()


def test_passing_cuts_are_removed(spark):
    kept = cut(spark.range(3))
    with passing_cuts(spark):
        files = cut(spark.range(5)).inputFiles()
        assert files and all(Path(f.removeprefix("file:")).exists() for f in files)
    assert not any(Path(f.removeprefix("file:")).exists() for f in files)
    assert kept.count() == 3


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master, getCheckpointDir, getConf = "spark://host:7077", staticmethod(lambda: None), staticmethod(lambda: Conf)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError):
        checkpoint_dir(Session)
