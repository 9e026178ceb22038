"""Release cases on hand-made nodes."""

import pytest
from pyspark.sql import functions as F

from listwright.operators import release as R
from listwright.sources.releases import release_load, release_write

NOW = "2026-06-01T00:00:00Z"
SCHEMA = "id string, label string, tags array<string>, pos int"


@pytest.fixture
def nodes(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def changes(df):
    return {r["id"]: r["change"] for r in df.collect()}


def test_added_edited_deleted(nodes):
    prev = nodes(("A", "Celsius", None, 0), ("B", "Kelvin", None, 1), ("D", "same", None, 2))
    curr = nodes(("A", "Celsius!", None, 0), ("C", "Meter", None, 1), ("D", "same", None, 2))
    assert changes(R.diff_releases(prev.drop("pos"), curr.drop("pos"))) == {"A": "edited", "B": "deleted", "C": "added", "D": "unchanged"}


def test_summary_is_sorted(nodes):
    curr = nodes(*[(i, "x", None, 0) for i in "cab"]).drop("pos")
    found = R.change_summary(R.diff_releases(curr.limit(0), curr)).collect()
    assert [r["id"] for r in found] == ["a", "b", "c"]


def test_version_columns_do_not_count(nodes):
    prev = nodes(("A", "x", None, 0)).drop("pos").withColumn("created", F.lit("2020")).withColumn("status", F.lit("s"))
    curr = nodes(("A", "x", None, 0)).drop("pos").withColumn("modified", F.lit("2021"))
    assert changes(R.diff_releases(prev, curr)) == {"A": "unchanged"}


def test_list_order_does_not_count(nodes):
    prev, curr = nodes(("A", "x", ["b", "a"], 0)).drop("pos"), nodes(("A", "x", ["a", "b"], 0)).drop("pos")
    assert changes(R.diff_releases(prev, curr)) == {"A": "unchanged"}
    more = nodes(("A", "x", ["a", "b", "c"], 0)).drop("pos")
    assert changes(R.diff_releases(prev, more)) == {"A": "edited"}


def test_null_and_empty_columns(spark):
    prev = spark.createDataFrame([("A", "x")], "id string, label string")
    curr = spark.createDataFrame([("A", "x", None)], "id string, label string, extra string")
    assert changes(R.diff_releases(prev, curr)) == {"A": "unchanged"}


def test_rows_without_id_and_last_of_equal_ids(nodes):
    prev = nodes((None, "n", None, 0), ("A", "old", None, 1), ("A", "new", None, 2))
    curr = nodes(("A", "new", None, 0), (None, "m", None, 1))
    assert changes(R.diff_releases(prev, curr, pos="pos")) == {"A": "unchanged"}


def test_whole_step_and_again(nodes):
    prev = nodes(("A", "a", None, 0), ("B", "b", None, 1)).drop("pos")
    curr = nodes(("A", "a2", None, 0), ("C", "c", None, 1)).drop("pos")
    done = R.apply_release(prev, curr, NOW)
    by_id = {r["id"]: r for r in done.collect()}
    assert by_id["A"]["modified"] == NOW and by_id["A"]["is_version_of"] == ["A"]
    assert by_id["B"]["status"] == R.WITHDRAWN and by_id["B"]["label"] is None
    assert by_id["C"]["created"] == NOW and by_id["C"]["status"].endswith("/Active")
    again = R.apply_release(done.drop("change"), curr, "2027")
    assert changes(again) == {"A": "unchanged", "B": "withdrawn", "C": "unchanged"}
    kept = {r["id"]: r for r in again.collect()}
    assert kept["C"]["created"] == NOW and kept["A"]["modified"] == NOW and kept["B"]["modified"] == NOW


def test_links_accumulate_or_overwrite(spark, nodes):
    prev = nodes(("A", "a", None, 0)).drop("pos")
    curr = nodes(("A", "b", None, 0)).drop("pos").withColumn("is_version_of", F.array(F.lit("old")))
    links = lambda **kw: R.apply_release(prev, curr, NOW, **kw).first()["is_version_of"]
    assert links() == ["old", "A"]
    assert links(accumulate=False) == ["A"]


def test_withdrawn_comes_back(nodes):
    prev = nodes(("A", "a", None, 0)).drop("pos").withColumn("status", F.lit(R.WITHDRAWN))
    assert changes(R.diff_releases(prev, nodes(("A", "a", None, 0)).drop("pos"))) == {"A": "added"}


def test_without_carry(nodes):
    prev = nodes(("A", "a", None, 0)).drop("pos").withColumn("created", F.lit("2020"))
    curr = nodes(("A", "a", None, 0)).drop("pos")
    assert R.apply_release(prev, curr, NOW, carry=False).first()["created"] is None
    assert R.apply_release(prev, curr, NOW).first()["created"] == "2020"


def test_init_then_again(nodes):
    df = nodes(("A", "a", None, 0), (None, "x", None, 1)).drop("pos")
    filled, n = R.init_versioning(df, NOW)
    assert n == 1
    assert R.init_versioning(filled, "later")[1] == 0


def test_bad_input(nodes):
    with pytest.raises(ValueError):
        R.apply_release(None, None, NOW)
    with pytest.raises(ValueError):
        R.apply_release(None, nodes(("A", "a", None, 0)).drop("id"), NOW)


def test_first_release(nodes):
    assert changes(R.apply_release(None, nodes(("A", "a", None, 0)).drop("pos"), NOW)) == {"A": "added"}


def test_status_of():
    assert R.status_of("under development").endswith("/UnderDevelopment")
    assert R.status_of("http://x/y") == "http://x/y"


def test_snapshots(spark, tmp_path, nodes):
    base = str(tmp_path / "rel")
    df = nodes(("A", "a", None, 0)).drop("pos")
    assert release_load(spark, base, schema=df.schema).count() == 0
    release_write(df, base, "1.2.0")
    release_write(df.withColumn("label", F.lit("z")), base, "1.10.0")
    newest = release_load(spark, base).first()
    assert (newest["label"], newest["release"]) == ("z", "1.10.0")
    assert release_load(spark, base, "1.2.0").first()["label"] == "a"


def test_empty_and_unfinished_releases(spark, tmp_path, nodes):
    base = str(tmp_path / "rel")
    df = nodes(("A", "a", None, 0)).drop("pos")
    release_write(df, base, "1." + "2" * 21)
    release_write(df.limit(0), base, "1." + "1" * 22)
    (tmp_path / "rel" / "release=2.0").mkdir()  # its writer has not finished
    newest = release_load(spark, base)
    assert newest.count() == 0 and "label" in newest.columns


def test_unreadable_release_raises(spark, tmp_path):
    (tmp_path / "release=1").mkdir()
    (tmp_path / "release=1" / "part.parquet").write_text("no parquet")
    (tmp_path / "release=1" / "_SUCCESS").write_text("")
    with pytest.raises(Exception):
        release_load(spark, str(tmp_path)).collect()


def test_nodes_are_dealt_out_before_their_triples_are_folded(spark):
    """One shuffle of nodes per release, over as many tasks as are asked for; their triples are not moved again."""
    from listwright.plans import load

    diff = load()[0]["release_triples_diff"](spark, "/root/testdata/sf0.001")
    assert diff.count() == 147
    plan = diff._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan
