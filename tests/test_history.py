"""Key histories: filters, merges by generation, replays, killed writers."""
import pytest
from pyspark.sql import functions as F

from docforge.session import materialise, scratch_path
from docforge.sources import history
from docforge.sources.history import KeyHistory


@pytest.fixture(autouse=True)
def ask_the_filters(monkeypatch):
    monkeypatch.setattr(history, "OPEN_ALL", 0)


def urls(spark, names):
    return materialise(spark.createDataFrame([(n,) for n in names], "url string"), "test-urls")


def found(h, keys, before):
    asked = {r.url for r in keys.collect()}
    return {r.url for r in h.may_match(keys, before).collect()} & asked


def test_a_batch_opens_only_runs_that_hold_its_keys(spark, monkeypatch):
    monkeypatch.setattr(history, "FAN", 100)        # no merge: one run a batch
    h = KeyHistory(spark, scratch_path(spark, "history"), "url string")
    for k in range(12):
        h.write(k, urls(spark, [f"https://h/{k}/{i}" for i in range(40)]))
    keys = urls(spark, ["https://h/3/7", "https://h/9/0", "https://new/1", None])
    assert found(h, keys, 12) == {"https://h/3/7", "https://h/9/0"}
    names = [r["name"].split("-")[1] for r in h.runs()]
    assert names == [str(k) for k in range(12)]
    opened = {name.split("-")[1] for name, _ in h.opened}
    assert {"3", "9"} <= opened and len(opened) <= 4      # a filter may err towards opening
    monkeypatch.setattr(history, "OPEN_ALL", 10**6)     # a small history is read as it is
    assert found(h, keys, 12) == {"https://h/3/7", "https://h/9/0"} and h.opened == []
    monkeypatch.setattr(history, "OPEN_ALL", 0)
    # batches from the asking one on are not looked at
    assert found(h, keys, 9) == {"https://h/3/7"}
    assert h.may_match(urls(spark, ["https://new/2"]), 12).count() <= 40


def test_runs_are_merged_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(history, "FAN", 4)
    h = KeyHistory(spark, scratch_path(spark, "history"), "url string")
    for k in range(10):
        h.write(k, urls(spark, [f"u{k}", f"v{k}", "same"]))
    assert len(h.runs()) < 8
    assert {r.url for r in h.rows(10).collect()} == {f"{c}{k}" for k in range(10) for c in "uv"} | {"same"}
    assert found(h, urls(spark, ["u0", "v9", "same", "w"]), 10) == {"u0", "v9", "same"}
    # a merged batch can't be run again, the last one can
    with pytest.raises(ValueError, match="merged"):
        h.write(2, urls(spark, ["x"]))
    h.write(9, urls(spark, ["z"]))
    assert found(h, urls(spark, ["u9", "z", "u8"]), 10) == {"z", "u8"}


def test_a_killed_merge_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(history, "FAN", 3)
    path = scratch_path(spark, "history")
    h = KeyHistory(spark, path, "url string")
    for k in range(3):
        h.write(k, urls(spark, [f"u{k}"]))
    before = h.runs()

    def killed(*a):
        raise RuntimeError("killed")

    monkeypatch.setattr(KeyHistory, "_commit", killed)
    with pytest.raises(RuntimeError):       # the merged run is written, its manifest is not
        h.write(3, urls(spark, ["u3"]))
    monkeypatch.undo()
    again = KeyHistory(spark, path, "url string")
    assert again.runs() == before
    again.write(3, urls(spark, ["u3"]))
    assert {r.url for r in again.rows(4).collect()} == {"u0", "u1", "u2", "u3"}


def test_many_parts_and_empty_batches(spark, monkeypatch):
    monkeypatch.setattr(history, "PART_ROWS", 100)
    h = KeyHistory(spark, scratch_path(spark, "history"), "band int, bkey string")
    rows = materialise(spark.range(1000).select((F.col("id") % 8).cast("int").alias("band"),
                                                F.col("id").cast("string").alias("bkey")), "rows")
    h.write(0, rows)
    h.write(1, rows.where("false"))
    assert [r["parts"] for r in h.runs()] == [16]
    keys = materialise(rows.where("bkey IN ('5', '77')"), "keys")
    got = h.may_match(keys, 2)
    assert {(r.band, r.bkey) for r in keys.collect()} <= {(r.band, r.bkey) for r in got.collect()}
    assert len(h.opened) <= 4 and got.count() < 400
