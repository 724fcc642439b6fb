"""Notes as files: paths stay, links resolve, filters decide which files are read, failures take back what they wrote."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from trailnote.sources import notefiles, notes

ROWS = [
    ("assumptions/active/a.md", "see [b](../inbox/b.md) and [c](c.md)"),
    ("assumptions/inbox/b.md", "é\n\nback to [a](../active/a.md)"),
    ("experiments/active/e 1+2%.md", None),
    ("learning/reading-log.md", "log"),
    ("odd.txt", ""),
]


@pytest.fixture
def root(spark, tmp_path):
    made = spark.createDataFrame([(p, t, "x", 1) for p, t in ROWS], "path string, text string, kind string, more int")
    notefiles.write_note_files(made.repartition(3), str(tmp_path / "notes"))
    return str(tmp_path / "notes")


def test_what_is_written_is_read_under_its_own_path(spark, root):
    got = {r.path: (r.kind, r.folder_state, r.text) for r in notefiles.read_note_files(spark, root).collect()}
    assert {p: t for p, (_, _, t) in got.items()} == {p: t or "" for p, t in ROWS}
    # Kind and state are told as notes.located tells them.
    kind, state = notes.located(F.col("path"))
    told = spark.createDataFrame([(p,) for p, _ in ROWS], "path string").select("path", kind, state).collect()
    assert {r[0]: (r[1], r[2]) for r in told} == {p: v[:2] for p, v in got.items()}
    assert got["assumptions/active/a.md"][:2] == ("assumption", "active")
    links = notes.note_links(notefiles.read_note_files(spark, root)).collect()
    assert {(r.path, r.target) for r in links} == {("assumptions/active/a.md", "assumptions/inbox/b.md"), ("assumptions/active/a.md", "assumptions/active/c.md"), ("assumptions/inbox/b.md", "assumptions/active/a.md")}


def test_a_note_written_again_replaces_itself(spark, root):
    notefiles.write_note_files(spark.createDataFrame([("odd.txt", "new")], "path string, text string"), root)
    found = notefiles.read_note_files(spark, root)
    assert found.count() == len(ROWS) and found.filter("path = 'odd.txt'").first().text == "new"
    assert not [f for _, _, names in os.walk(root) for f in names if f.startswith(".") and not f.endswith(".crc")]


def test_filters_read_only_their_folders(spark, root):
    reader = notefiles._Reader(root)
    rest = list(reader.pushFilters([EqualTo(("folder_state",), "active"), GreaterThan(("text",), "a"), In(("kind",), ("assumption", "principle"))]))
    assert [type(f) for f in rest] == [GreaterThan]
    assert [p for part in reader.partitions() for p in part.paths] == ["assumptions/active/a.md"]
    # A file that cannot be read is no matter where the filter leaves it out.
    os.symlink("/nowhere", f"{root}/assumptions/inbox/broken.md")
    open(f"{root}/experiments/active/bad.md", "wb").write(b"\xff ok")
    got = notefiles.read_note_files(spark, root).filter("folder_state = 'active' AND kind = 'experiment'").collect()
    assert sorted((r.path, r.text) for r in got) == [("experiments/active/bad.md", "� ok"), ("experiments/active/e 1+2%.md", "")]
    plan = notefiles.read_note_files(spark, root).filter("folder_state = 'active'")._jdf.queryExecution().toString()
    assert "Filter" not in plan.split("== Physical Plan ==")[1].split("PushedFilters")[0] or "folder_state" in plan


@pytest.mark.parametrize("path", ["../out.md", "/abs.md", "a/../../b.md", None])
def test_paths_outside_are_refused(spark, tmp_path, path):
    with pytest.raises(Exception, match="not a path below the root"):
        notefiles.write_note_files(spark.createDataFrame([(path, "x")], "path string, text string"), str(tmp_path / "in"))
    assert not os.path.exists(tmp_path / "out.md")


def test_abort_takes_back(tmp_path):
    writer = notefiles._Writer(str(tmp_path), ["path", "text"], False)
    done = writer.write(iter([("a/x.md", "x"), ("a/y.md", "y")]))
    assert sorted(os.listdir(tmp_path / "a")) == ["x.md", "y.md"]
    writer.abort([done, None])
    assert os.listdir(tmp_path / "a") == []


def test_nothing_there(spark, tmp_path):
    assert notefiles.read_note_files(spark, str(tmp_path / "none")).count() == 0
