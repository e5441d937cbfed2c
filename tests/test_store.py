import datetime

import pytest

from chromatile.sources.store import Conflict, ProjectStore

SCHEMA = "id long, name string, created_at timestamp, updated_at timestamp"


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture
def store(spark, tmp_path):
    return ProjectStore(spark, str(tmp_path / "store"), SCHEMA, buckets=8)


def rows(df):
    return sorted(map(tuple, df.collect()))


def changes(spark, *items):
    return spark.createDataFrame([(i, name, None, day(d)) for i, name, d in items], SCHEMA)


def test_save_get_list_delete(spark, store):
    assert store.version() == 0 and store.read().count() == 0 and store.get(1).count() == 0 and store.listing().count() == 0
    assert store.save(changes(spark, *[(i, f"p{i}", i) for i in range(40)], (None, "no id", 1))) == 1
    assert rows(store.read()) == [(i, f"p{i}", day(i), day(i)) for i in range(40)]
    assert store.save(changes(spark, (3, "three", 90), (3, "older", 80), (100, "new", 91))) == 2
    assert rows(store.get(3)) == [(3, "three", day(3), day(90))] and rows(store.get(100)) == [(100, "new", day(91), day(91))]
    assert [r.id for r in store.listing().take(3)] == [100, 3, 39] and store.listing().columns == ["id", "updated_at"]
    assert store.delete(spark.createDataFrame([(3,), (4,), (777,)], "id long")) == 3
    assert {r.id for r in store.read().collect()} == {*range(40), 100} - {3, 4}
    assert rows(store.read(1)) == [(i, f"p{i}", day(i), day(i)) for i in range(40)]  # an old version stays as it was
    assert store.save(changes(spark)) == 3 and ProjectStore(spark, store.path, SCHEMA, buckets=3).buckets == 8


def test_only_touched_buckets_are_written(spark, store):
    store.save(changes(spark, *[(i, "a", 0) for i in range(64)]))
    before = store._manifest(1)["folders"]
    store.save(changes(spark, (5, "b", 1)))
    after = store._manifest(2)["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    touched = next(b for b in before if before[b] != after[b])
    assert store.read().filter("id = 5").inputFiles() and {f for f in store.get(5).inputFiles()} == {f for f in store._read([after[touched]]).inputFiles()}


def test_a_crash_before_the_swap_leaves_the_old_version(spark, store, monkeypatch):
    store.save(changes(spark, (1, "a", 0), (2, "b", 0)))
    held = rows(store.read())
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        store.save(changes(spark, (1, "lost", 5), (3, "lost", 5)))
    monkeypatch.undo()
    again = ProjectStore(spark, store.path, SCHEMA)
    assert again.version() == 1 and rows(again.read()) == held
    again.save(changes(spark, (2, "c", 6)))
    again.compact()
    assert rows(again.read()) == [(1, "a", day(0), day(0)), (2, "c", day(0), day(6))]
    named = {f.split("/")[0] for f in again._manifest(2)["folders"].values()}
    assert set(again._names("data")) == named and again._names("versions") == ["000000000002.json"]


def test_the_second_of_two_writers_fails(spark, store):
    store.save(changes(spark, (1, "a", 0)))
    late = ProjectStore(spark, store.path, SCHEMA)
    late.version = lambda: 1  # it read version 1 before the other one saved
    store.save(changes(spark, (1, "first", 1)))
    with pytest.raises(Conflict):
        late.save(changes(spark, (1, "second", 2)))
    assert rows(store.read()) == [(1, "first", day(0), day(1))] and not [n for n in store._names("versions") if n.startswith("draft")]


def test_compaction_keeps_versions(spark, store):
    for k in range(4):
        store.save(changes(spark, (k, "x", k)))
    store.compact(keep=2)
    assert [rows(store.read(v)) for v in (3, 4)] == [[(i, "x", day(i), day(i)) for i in range(v)] for v in (3, 4)]
    assert len(store._names("versions")) == 2
