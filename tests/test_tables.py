"""Tables that change together, and stored files with their records."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import purchases
from tallyspark.sources import objects, render, views
from tallyspark.sources.tables import Conflict, Tables, upserted

SF = "/root/testdata/sf0.001"


@pytest.fixture
def held(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"))


def numbers(held, name, version=None):
    return sorted(r.id for r in held.read(name, version).collect())


def test_readers_see_both_tables_or_none(spark, held):
    assert held.version()["number"] == 0
    held.commit(appended={"a": spark.range(3), "b": spark.range(2)})
    old = held.version()
    held.commit(replaced={"a": spark.range(10, 12)}, appended={"b": spark.range(7, 8)})
    assert (numbers(held, "a", old), numbers(held, "b", old)) == ([0, 1, 2], [0, 1])
    assert (numbers(held, "a"), numbers(held, "b")) == ([10, 11], [0, 1, 7])


def test_a_writer_that_ends_early_leaves_the_old_version(spark, held):
    held.commit(appended={"a": spark.range(3), "b": spark.range(3)})
    before = held.version()
    broken = spark.range(5).withColumn("id", F.when(F.col("id") == 4, F.expr("cast(raise_error('lost') as long)")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        held.commit(replaced={"a": spark.range(1), "b": broken})  # a is written, b is not
    assert held.version() == before and numbers(held, "a") == [0, 1, 2]
    assert [n.split("-")[0] for n in held.sweep()].count("a") == 1
    assert numbers(held, "b") == [0, 1, 2] and held.sweep() == []


def test_numbered_commits_count_once(spark, held):
    for number in (0, 0, 1, 0, 1):
        held.commit(appended={"a": spark.range(number, number + 1)}, writer="stream", number=number)
    assert numbers(held, "a") == [0, 1]


def test_replacing_what_has_changed_is_refused(spark, held):
    held.commit(appended={"a": spark.range(3)})
    base = held.version()
    held.commit(appended={"a": spark.range(5, 6)})
    with pytest.raises(Conflict):
        held.commit(replaced={"a": held.read("a", base).filter("id > 0")}, base=base)
    assert numbers(held, "a") == [0, 1, 2, 5]
    held.compact("a")
    assert numbers(held, "a") == [0, 1, 2, 5] and len(held.version()["tables"]["a"]["folders"]) == 1
    with pytest.raises(ValueError, match="bigint"):
        held.commit(appended={"a": spark.range(1).select(F.lit("x").alias("id"))})


def test_two_writers_at_once_both_count(spark, held):
    """A manifest whose number is taken is not replaced; the commit is made again on top."""
    held.commit(appended={"a": spark.range(1)})
    real, calls = held.version, []

    def late():
        found = real()
        calls.append(found["number"])
        if len(calls) == 2:  # after this commit has looked at the version, another writer comes first
            Tables(spark, held.root).commit(appended={"a": spark.range(50, 51)})
        return found

    held.version = late
    assert held.commit(appended={"a": spark.range(7, 8)})
    held.version = real
    assert numbers(held, "a") == [0, 7, 50] and real()["number"] == 3


def test_delete_and_replace_children(spark, held):
    held.commit(appended={"purchases": views.purchases(spark, SF).select("id", "user_id"), "items": views.purchase_items(spark, SF)})
    base = held.version()
    gone = held.read("purchases").filter("id % 2 = 0")
    left, items, _ = purchases.delete(held.read("purchases"), held.read("items"), gone.withColumn("purchase_id", F.col("id")), gone)
    held.commit(replaced={"purchases": left, "items": items}, base=base)
    assert held.read("items").filter("purchase_id % 2 = 0").count() == 0 and held.read("purchases").filter("id % 2 = 0").count() == 0
    new = held.read("items").limit(1).withColumn("title", F.lit("new"))
    again = upserted(held.read("items"), new, "purchase_id", "line_index")
    assert again.count() == held.read("items").count() and again.filter("title = 'new'").count() == 1


def files(spark, n=6):
    return spark.range(n).select(F.concat(F.lit("r/"), "id", F.lit("/x.bin")).alias("key"), F.encode(F.concat(F.lit("é"), "id"), "utf-8").alias("content"))


def keys(spark, path):
    return sorted(r.key for r in objects.stored(spark, path).collect())


def test_objects_with_their_record(spark, tmp_path, held):
    path = str(tmp_path / "files")
    objects.put(files(spark), path, lambda k: held.commit(appended={"record": k}))
    assert keys(spark, path) == sorted(r.key for r in held.read("record").collect()) == [f"r/{i}/x.bin" for i in range(6)]
    assert {bytes(r.content).decode() for r in render.read_objects(spark, path).collect()} == {f"é{i}" for i in range(6)}

    def fails(_):
        raise RuntimeError("no table")

    with pytest.raises(RuntimeError, match="no table"):
        objects.put(files(spark).withColumn("key", F.concat(F.lit("s"), "key")), path, fails)
    assert keys(spark, path) == [f"r/{i}/x.bin" for i in range(6)]
    # A driver that is lost after the files and before the record leaves files without one.
    objects.write(files(spark, 2).withColumn("key", F.concat(F.lit("s"), "key")), path)
    assert objects.sweep(held.read("record"), path) == 2 and len(keys(spark, path)) == 6


@pytest.mark.parametrize("bad", ["../x", "", None, "/etc/x", "_staging/x"])
def test_objects_of_a_failed_write(spark, tmp_path, bad):
    path = str(tmp_path / "files")
    objects.write(files(spark, 1), path)
    with pytest.raises(Exception, match="not a key"):
        objects.write(files(spark).withColumn("key", F.when(F.col("key") == "r/5/x.bin", F.lit(bad)).otherwise(F.concat(F.lit("s"), "key"))), path)
    assert keys(spark, path) == ["r/0/x.bin"]
