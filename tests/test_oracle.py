"""Registered queries against SQL on the smallest given tables. ``tests/compare.py`` runs all of them."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")

SAMPLE = (
    "agg_verdict flt_hygiene_battery fn_mentions fn_apply_renumber join_out_of_range join_box_overlap agg_expected_grid "
    "win_islands win_round_to_total set_sentence_diff st_bh st_meta_dl st_rank_sum st_bootstrap sv_weighted_mean vl_km stm_audit"
).split()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_result(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) == []


def test_contract():
    """The lists are asked for before a session exists, too."""
    code = "import __spark_entry__ as e; assert len(e.oracle_sql()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    root = Path(__file__).resolve().parent.parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
