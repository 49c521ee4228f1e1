"""What long jobs leave on disk."""

import time
from pathlib import Path

import builders as b
from compare import SF_DIR
from pyspark.sql import functions as F

from lotwise.operators.lineage import lineage
from lotwise.operators.replay import OPERATION, replay_ledger
from lotwise.plans import catalogue
from lotwise.session import settled, shared_folder, written


def shuffle_files(spark) -> int:
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles().mkString("\n").split("\n")
    return sum(Path(file).name.startswith("shuffle_") for file in files)


def tables(spark) -> set[str]:
    folder = Path(shared_folder(spark).removeprefix("file:"))
    return {path.name for path in folder.iterdir()} if folder.exists() else set()


def test_shuffle_files_go_when_a_table_is_written(spark):
    before = shuffle_files(spark)
    keyed = spark.range(10_000).groupBy((F.col("id") % 1000).alias("key")).agg(F.count("*").alias("n")).repartition(4, "n")
    table = written(keyed, "counts")
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert table.count() == 1000


def chain(spark, length: int):
    """Money that moves through ``length`` accounts, one a month."""
    days = [f"2000-{month:02d}-01" for month in range(1, length + 1)]
    return b.ledger(
        spark,
        accounts=b.accounts(spark, *[(f"a{k}", "F", "B") for k in range(length)]),
        quotes=b.quotes(spark, ("F", days[-1], 2)),
        lots=b.lots(spark, *[(k + 1, f"a{k}", days[0], days[k], 10, 100, k or None) for k in range(length)]),
        orders=b.orders(spark, *[(k, days[k]) for k in range(1, length)]),
        sales=b.sales(spark, *[(k, k, k, 10, 100) for k in range(1, length)]),
    )


def test_lineage_leaves_only_its_result(spark):
    before = tables(spark)
    found = settled(lineage(chain(spark, 9)), "lineage-all")
    assert {name.rsplit("-", 1)[0] for name in tables(spark) - before} == {"lineage-all"}
    hops = sorted((r["hop"], r["lot_id"], r["origin_lot"], r["fraction"]) for r in found.collect())
    assert hops == [(hop, 9 - hop, 1, 1) for hop in range(9)]


def test_replay_leaves_only_what_its_result_reads(spark):
    ops = [
        (1, "subscription", "a", "2000-01-01", None, 10, 100, None),
        (2, "subscription", "nobody", "2000-01-01", None, 10, 100, None),
        (3, "transfer", "a", "2000-02-01", None, 10, 120, "b"),
        (4, "redemption", "b", "2000-03-01", 1, None, 130, None),
        (5, "redemption", "b", "2000-03-02", None, -1, 130, None),
    ]
    rows = [(i, k, a, b.day(d), n, b.dec(s), b.dec(m), to, None, None, None) for i, k, a, d, n, s, m, to in ops]
    accounts = b.accounts(spark, ("a", "F", "B"), ("b", "G", "B"))
    prices = b.quotes(spark, *[(fund, f"2000-0{month}-01", month) for fund in "FG" for month in (1, 2, 3)])
    before = tables(spark)
    done = replay_ledger(spark.createDataFrame(rows, OPERATION), accounts, prices)
    left = {name.rsplit("-", 1)[0] for name in tables(spark) - before}
    assert left <= {"lots", "refused", "events", "numbered"}
    assert {tuple(r) for r in done.refused.collect()} == {(2, "unknown account"), (5, "shares not positive")}
    assert [(r["order_id"], r["shares"]) for r in done.sales.orderBy("order_id").collect()] == [(3, 10), (4, 60)]


def test_text_ledger_groups_transfers_once(spark, monkeypatch):
    inputs, made = catalogue.Inputs(spark, SF_DIR), []
    kept = catalogue.written
    monkeypatch.setattr(catalogue, "written", lambda df, name: made.append(name) or kept(df, name))
    before = tables(spark)
    log = catalogue._ingested(inputs)
    assert made == ["transfers"] and not any(name.startswith("transfers-") for name in tables(spark) - before)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"subscription", "redemption", "transfer"}
