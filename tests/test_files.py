import os

import pytest
from pyspark.sql import functions as F

from codicil.errors import PipelineError
from codicil.functions import textkeys as K
from codicil.plans import projection as J
from codicil.session import durable, scope
from codicil.sources import corpus as C
from codicil.sources import files
from tests import corpus_fixture as X


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_files_whole_and_removed(spark, tmp_path, scheme):
    root = scheme + str(tmp_path)
    path = files.join(root, "a", "b.json")
    with pytest.raises(FileNotFoundError):
        files.read(path)
    files.write(path, b"one")
    files.write(path, b"two")
    assert files.read(path) == b"two" and [n for n in os.listdir(tmp_path / "a") if not n.startswith(".")] == ["b.json"]
    with files.exclusive(files.join(root, "lock")), pytest.raises(BlockingIOError):
        with files.exclusive(files.join(root, "lock")):
            pass
    with files.exclusive(files.join(root, "lock")):
        pass
    files.delete(files.join(root, "a"))
    assert not files.exists(path)


def test_a_store_and_its_register_share_one_file_system(spark, tmp_path):
    rows = J.build(C.load_corpus(spark, X.write(str(tmp_path / "c")), "corpus-v0.1.0"))
    store = J.Store(spark, "file://" + str(tmp_path / "store"))
    assert store.publish(J.Release("corpus-v0.1.0", "1" * 40, ("0.1.0",)), rows) == "import_and_activate"
    assert store.read("provisions").count() == 4 and sorted(n for n in os.listdir(tmp_path / "store") if not n.startswith(".")) == ["acts", "citations", "pointer.json", "postings", "provisions", "releases", "sources"]


def test_a_lock_file_left_behind_blocks_nobody(spark, tmp_path):
    store = J.Store(spark, str(tmp_path))
    (tmp_path / "lock").touch()
    with store.lock():
        pass


def test_scope_removes_its_folders(spark):
    with scope(spark):
        df = durable(spark.range(3), "three")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_many_schema_versions(spark):
    many = spark.range(1200).select(F.format_string("0.%04d.0", "id").alias("schema_version"))
    with pytest.raises(PipelineError):
        J.schema_versions({"acts": many})
    late = spark.range(1200).select(F.when(F.col("id") < 1199, "0.1.0").otherwise("9.9.9").alias("schema_version"))
    with pytest.raises(PipelineError, match="9.9.9"):
        J.build({"acts": late})


def test_markers_by_column_and_by_scanner(spark):
    lines = ["1. a", "12A. (a) b", " (iv ) c", "(a)(ii) d", "(1a) e", "12AB. no", "( a) no", "(a no", "(1ab) no", "x (a)", "3.—(2) y", "(é) no", "1 . no", "", "\t7.", "()", "(1.) no"]
    text = "\n".join(lines)
    got = spark.createDataFrame([(text,), (None,)], "t string").select(K.markers("t")).collect()
    assert got[0][0] == ["1.", "12A.", "(iv )", "(a)", "(1a)", "3.", "7."] and got[1][0] is None
    spans = K.marker_spans(text)
    assert [m for _, m in spans] == ["1.", "12A.", "(a)", "(iv )", "(a)", "(ii)", "(1a)", "3.", "(2)", "7."] and all(text[i : i + len(m)] == m for i, m in spans)


def test_releases_beyond_any_list_are_decided(spark):
    rel = spark.range(12_000).select(F.format_string("corpus-v0.%d.0", "id").alias("release_tag"), F.lit("a").alias("commit_sha"), F.array(F.lit("0.1.0")).alias("canonical_schema_versions"), F.lit(1).alias("projection_schema_version"), F.lit("ready").alias("import_state"))
    top = J.Release("corpus-v0.11999.0", "a", ("0.1.0",))
    got = {r["action"]: r["count"] for r in J.decide_all(rel.drop("import_state"), rel, top, None).groupBy("action").count().collect()}
    assert got == {"activate_existing": 11_999, "noop": 1}
