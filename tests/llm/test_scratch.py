"""What operators leave on the shared folder while their result is not yet read."""

from statuta.llm import common, substring_dedup


def test_windows_are_judged_without_the_tables_of_anchors(spark):
    """Anchors and phrases are deleted when the windows are written, before anything is shuffled for these."""
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(1, text), (2, "x y " + text + " z"), (3, text), (4, "short"), (5, None)], "id long, text string")
    before = set(common.scratch_tables())
    gone = substring_dedup.removals(docs)
    left = [p.rpartition("/")[2] for p in common.scratch_tables() if p not in before]
    assert sorted(name.split("-")[1] for name in left) == ["copies", "owners", "windows"]
    found = {r["id"]: sorted(r["starts"]) for r in gone.collect()}
    assert found == {2: list(range(2, 33)), 3: [-1]}
