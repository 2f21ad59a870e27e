"""What holds for the library as a whole: plans, isolation, shared folders."""

import subprocess
import sys
from pathlib import Path

import pytest

from skyaccord import lineage
from skyaccord.plans import matching
from tests.conftest import SF

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", ["frac_summary", "nmad", "mad_inliers", "offset_stats", "rho_summary"])
def test_statistics_do_not_compute_the_match_again(spark, name):
    """The match is stored once; what is left to plan reads that table and joins no cells."""
    plan = getattr(matching, name)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan and "__x#" not in plan


def _entry(tmp_path, files):
    """Names of all queries, or the error, of the entry module beside these files."""
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    for p in ROOT.rglob("*.py"):
        there = p.relative_to(ROOT)
        if there.parts[0] in ("skyaccord", "__spark_entry__.py") and there.parts[:2] != ("skyaccord", "llm"):
            (tmp_path / there).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / there).write_text(p.read_text())
    code = "import __spark_entry__ as e; print(sorted(e.queries()))"
    return subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)


def test_entry_works_without_the_corpus_part(tmp_path):
    got = _entry(tmp_path, {})
    assert got.returncode == 0 and "frac_summary" in got.stdout and "op1_" not in got.stdout


@pytest.mark.parametrize("broken", ["import a_module_that_is_missing", "from skyaccord.llm import nothing_of_this_name", "1 / 0"])
def test_other_import_errors_are_raised(tmp_path, broken):
    got = _entry(tmp_path, {"corpus_pipeline.py": broken, "skyaccord/llm/__init__.py": "", "skyaccord/llm/queries.py": ""})
    assert got.returncode != 0


def test_a_cluster_must_name_a_shared_folder():
    class Unset:
        def __getattr__(self, _):
            return self

        def __call__(self, *_):
            return self

        def isDefined(self):  # noqa: N802
            return False

        def get(self, *_):
            return None

        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Unset()
        conf = Unset()

    with pytest.raises(RuntimeError):
        lineage.ensure_checkpoint_dir(Session())
