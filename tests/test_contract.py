"""Enforced writes (SNK3/DQ6) and versions of the star (SNK2)."""
import os

from helpers import rows

from tillstar.operators.contract import Contract, reasons, write_enforced
from tillstar.sources import versions


def test_rows_are_kept_or_set_aside(spark, tmp_path):
    fact = spark.createDataFrame(
        [(1, 10, 5.0), (1, 10, 6.0), (1, 10, 4.0), (2, 99, 1.0), (2, 10, 2.0), (3, None, 1.0), (None, 10, 1.0), (4, 10, None),
         (5, 99, None), (6, 20, 1.0), (6, 20, 1.0)], "id int, dim int, amount double")
    dim = spark.createDataFrame([(10,), (10,), (20,), (None,)], "key int")
    contract = Contract(required=("amount",), key=("id",), references={"dim": (dim, "key")})
    kept, aside, counts = write_enforced(fact, contract, str(tmp_path / "t"))
    assert kept.columns == fact.columns
    assert rows(kept) == [(1, 10, 4.0), (2, 10, 2.0), (3, None, 1.0), (6, 20, 1.0)]
    assert rows(aside, "id", "dim", "amount", "reason") == [
        (1, 10, 5.0, "duplicate key"), (1, 10, 6.0, "duplicate key"), (2, 99, 1.0, "orphan dim"), (4, 10, None, "null amount"),
        (5, 99, None, "null amount"), (6, 20, 1.0, "duplicate key"), (None, 10, 1.0, "null id")]
    assert counts == {"rows": 11, "set_aside": 7, "null": 3, "orphan": 1, "duplicate": 3}


def test_empty_contract_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, reason string")
    assert rows(reasons(df, Contract())) == [(1, None)]
    kept, aside, counts = write_enforced(df.limit(0), Contract(key=("id",)), str(tmp_path / "t"))
    assert rows(kept) == rows(aside) == []


def test_readers_see_one_version_and_unchanged_parts_keep_their_files(spark, tmp_path):
    root = str(tmp_path)
    fact = spark.createDataFrame([(y, k, float(k)) for y in (2020, 2021, None) for k in range(5)], "year int, k int, v double")
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "k int, name string")
    assert versions.current(spark, root) is None
    first = versions.load({"dim": dim, "fact": fact}, root, {"fact": "year"})
    seen = versions.read(spark, root, "fact")
    assert rows(seen) == rows(fact)
    files = {r.part: r.path for r in versions.manifest(spark, root).where("table_name = 'fact'").collect()}
    changed = fact.where("NOT (year <=> 2021 AND k = 3)").unionByName(fact.limit(0))
    second = versions.load({"dim": dim, "fact": changed.repartition(3)}, root, {"fact": "year"}, publish=False)
    # written, not shown: readers still see the first
    assert versions.current(spark, root) == first and rows(versions.read(spark, root, "fact")) == rows(fact)
    versions.show(spark, root, second)
    assert rows(versions.read(spark, root, "fact")) == rows(changed)
    assert rows(seen) == rows(fact)                      # a reader that began before
    now = {r.part: r.path for r in versions.manifest(spark, root).where("table_name = 'fact'").collect()}
    assert {p for p in files if files[p] == now[p]} == {"2020", "null"}
    assert not os.path.exists(os.path.join(root, second, "dim"))
    assert versions.drop_unused(spark, root) == []       # the new one reads files of the old
    third = versions.load({"dim": dim.limit(2), "fact": changed.limit(3)}, root, {"fact": "year"})
    assert rows(versions.read(spark, root, "fact")) == rows(changed.limit(3))
    gone = versions.drop_unused(spark, root, keep=(second,))
    assert gone == [] and set(versions.drop_unused(spark, root)) <= {first, second}
    assert versions.current(spark, root) == third and versions.read(spark, root, "dim").count() == 2
    assert os.path.exists(os.path.join(root, "CURRENT"))
