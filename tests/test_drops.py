"""A panel built by additions equals one built from all files; repeated, failed and double runs change nothing."""

import os
import shutil

import pytest
from conftest import rows

from tallyward.plans.drops import MARKER, PanelFiles
from tallyward.plans.panel import build_panel
from tallyward.sources.files import read_incident_files
from tallyward.sources.staging import children

HEADER = "Crime ID,Month,Reported by,Falls within,Longitude,Latitude,Location,LSOA code,LSOA name,Crime type,Last outcome category,Context"
EXCLUDED = (("Far Force",), "Nowhere", "S")


def write_drop(root, name, cells, when=None):
    """A street file: (month, force, area, category, n)."""
    path = f"{root}/{name}-street.csv"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as out:
        print(HEADER, file=out)
        for month, force, area, category, n in cells:
            for _ in range(n):
                print(f",{month},{force},{force},0.0,51.0,On,{area},name,{category},,", file=out)
    if when is not None:
        os.utime(path, (when, when))
    return path


@pytest.fixture
def boundaries(spark):
    shape = "geo_code string, geo_label string"
    return spark.createDataFrame([("E1", "One"), ("E2", "Two"), ("S3", "Three"), ("E4", "Nowhere 1")], shape)


@pytest.fixture
def drops(tmp_path):
    root = str(tmp_path / "drops of files")
    write_drop(root, "2019-01/2019-01-a b", [("2019-01", "A", "E1", "theft", 3), ("2019-01", "A", "", "theft", 2), ("2019-01", "A", "S3", "fire", 1)])
    write_drop(root, "2019-02/2019-02-a", [("2019-02", "A", "E1", "theft", 1), ("2019-02", "Far Force", "E2", "arson", 4)])
    return root


def whole(spark, root, boundaries):
    return build_panel(read_incident_files(spark, [root]), boundaries, *EXCLUDED)


def same(spark, ledger, root, boundaries):
    got, want = ledger.panel(boundaries, *EXCLUDED), whole(spark, root, boundaries)
    assert rows(got.cells) == rows(want.cells)
    assert rows(got.levels.distinct()) == rows(want.levels.distinct())
    return rows(got.cells)


def test_additions_equal_one_build(spark, drops, boundaries, tmp_path):
    ledger = PanelFiles(spark, str(tmp_path / "panel"))
    assert ledger.add(drops) == 2
    first = same(spark, ledger, drops, boundaries)
    assert ledger.add(drops) == 0 and len(ledger.commits()) == 1
    write_drop(drops, "2020-01/2020-01-a", [("2020-01", "A", "E2", "theft", 5), ("2020-01", "A", "E1", "theft", 2), ("2020-01", "A", "E4", "theft", 2)])
    later = PanelFiles(spark, str(tmp_path / "panel"))
    assert later.add(drops) == 1
    second = same(spark, later, drops, boundaries)
    assert len(second) == len(first) + 2
    only = later.panel(boundaries, *EXCLUDED, years=["2020"])
    assert rows(only.cells) == [r for r in second if r[3] == "2020"]


def test_a_corrected_file_replaces_its_counts(spark, drops, boundaries, tmp_path):
    ledger = PanelFiles(spark, str(tmp_path / "panel"))
    ledger.add(drops)
    path = write_drop(drops, "2019-02/2019-02-a", [("2019-02", "A", "E2", "theft", 7)], when=1_000_000)
    assert ledger.add(drops) == 1
    assert ("theft", "2019-02", "E2", "2019", 7) in same(spark, ledger, drops, boundaries)
    os.utime(path, (2_000_000, 2_000_000))
    assert ledger.add(drops) == 1
    same(spark, ledger, drops, boundaries)
    os.remove(path)
    assert ledger.add(drops) == 0
    assert ("theft", "2019-02", "E2", "2019", 7) in rows(ledger.panel(boundaries, *EXCLUDED).cells)


def test_lost_runs_are_not_read(spark, drops, boundaries, tmp_path):
    ledger = PanelFiles(spark, str(tmp_path / "panel"))

    def broken(spark, paths):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.add(drops, read=broken)
    assert children(spark, ledger.folder) == []
    ledger.add(drops)
    want = same(spark, ledger, drops, boundaries)
    os.remove(f"{ledger.commits()[0].removeprefix('file:')}/{MARKER}")  # as if the run had died before its last step
    assert rows(ledger.panel(boundaries, *EXCLUDED).cells) == []
    assert ledger.add(drops) == 2
    assert same(spark, ledger, drops, boundaries) == want


def test_two_runs_at_once_count_a_file_once(spark, drops, boundaries, tmp_path):
    folder = str(tmp_path / "panel")
    ledger, other = PanelFiles(spark, folder), PanelFiles(spark, folder)

    def meanwhile(spark, paths):
        other.add(drops)
        return read_incident_files(spark, paths)

    assert ledger.add(drops, read=meanwhile) == 2
    assert len(ledger.commits()) == 2
    same(spark, ledger, drops, boundaries)


def test_compaction_keeps_the_counts(spark, drops, boundaries, tmp_path):
    ledger = PanelFiles(spark, str(tmp_path / "panel"))
    ledger.add(drops)
    write_drop(drops, "2019-02/2019-02-a", [("2019-02", "A", "E2", "theft", 7)])
    write_drop(drops, "2020-01/2020-01-a", [("2020-01", "A", "E2", "theft", 5)])
    ledger.add(drops)
    shutil.copytree(ledger.folder, tmp_path / "before")
    ledger.compact()
    assert len(ledger.commits()) == 1
    same(spark, ledger, drops, boundaries)
    assert ledger.add(drops) == 0
    shutil.copytree(tmp_path / "before", ledger.folder, dirs_exist_ok=True)  # as if it had died before removing the others
    assert len(ledger.commits()) == 3
    same(spark, ledger, drops, boundaries)
    assert ledger.add(drops) == 0


def test_no_files_and_no_commits(spark, boundaries, tmp_path):
    os.makedirs(tmp_path / "none")
    ledger = PanelFiles(spark, str(tmp_path / "panel"))
    assert ledger.add(str(tmp_path / "none")) == 0
    assert rows(ledger.panel(boundaries, *EXCLUDED).cells) == []
    ledger.compact()
    assert ledger.commits() == []
