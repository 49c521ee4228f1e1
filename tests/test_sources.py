"""Text records, rejected rows, feeds and streams on small files."""

import datetime as dt
import os

import builders as b
from pyspark.sql import functions as F

from lotwise.plans import files
from lotwise.schemas import LOT, QUOTE, SALE
from lotwise.session import new_path
from lotwise.sources import ledger_text as tx
from lotwise import session
from lotwise.operators.replay import replay_ledger
from lotwise.sources import quote_feeds
from lotwise.streaming import quotes as sq
from lotwise.streaming import variation_state


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_quotes_with_noise_and_bad_rows(spark, tmp_path):
    path = write(tmp_path / "q.txt", "# quotes\n\n X | 2020-01-02 | 10.12345\nX|2020-02-30|1\nX\nX|2020-01-03|\nX|2020-01-04|1|2\n")
    good, bad = tx.read_layout(spark, path, "quote")
    assert b.rows(good) == [("X", "2020-01-02", 10.1235), ("X", "2020-01-03", None)]
    assert b.rows(bad, "reason") == [("bad date",), ("too few fields",), ("too many fields",)]


def test_whole_numbers_are_lots_and_decimals_are_shares(spark, tmp_path):
    path = write(tmp_path / "r.txt", "A|2020-01-01|2\nA|2020-01-01|2.0|5\nA|2020-01-01|+3\nA|2020-01-01||9.5|all\nA|2020-01-01|many\n")
    good, bad = tx.read_layout(spark, path, "redemption")
    assert sorted((r["lots"], r["shares"] and float(r["shares"]), r["comment"]) for r in good.collect() if r["lots"]) == [(2, None, None), (3, None, None)]
    assert [(float(r["shares"]), float(r["proceeds"])) for r in good.filter("shares IS NOT NULL").collect()] == [(2.0, 5.0)]
    assert [r["comment"] for r in good.filter("lots IS NULL AND shares IS NULL").collect()] == ["all"]
    assert b.rows(bad, "reason") == [("bad quantity",)]


def test_fund_defaults_and_yes_words(spark, tmp_path):
    path = write(tmp_path / "f.txt", "X1|Fund|||csv|3\nX2|Fund||||2|Yes|USD|k\nX3|Fund||||2|perhaps\n")
    good, bad = tx.read_layout(spark, path, "fund")
    assert sorted((r["isin"], r["active"], r["currency"], r["feed_key"]) for r in good.collect()) == [
        ("X1", False, "EUR", None), ("X2", True, "USD", "k")
    ]
    assert b.rows(bad, "reason") == [("bad active",)]


def test_quote_ranges(spark, tmp_path):
    path = write(tmp_path / "c.txt", "X|2020-01-01|2020-01-03\nX|2020-01-03\nX|2020-01-03|2020-01-01\nX|soon\n")
    good, bad = tx.read_layout(spark, path, "quote_range")
    assert b.rows(tx.wanted_quotes(good), "date") == [("2020-01-01",), ("2020-01-02",), ("2020-01-03",)]
    assert {(str(r["end_date"]), r["days"]) for r in tx.range_requests(good).collect()} == {("2020-01-03", 2), ("2020-01-03", None)}
    assert b.rows(bad, "reason") == [("bad first_date",), ("last date before first",)]


def test_csv_feed_drops_first_and_last_line(spark, tmp_path):
    write(tmp_path / "isin=X" / "a.csv", "Date;Value\n2020-01-02 00:00:00.0;12,3456\n2020-01-03 00:00:00.0;12,4\n")
    write(tmp_path / "isin=Y" / "a.csv", "Date;Value\n2020-01-02 00:00:00.0;1,5\n2020-01-03 00:00:00.0;9,9")
    assert b.rows(quote_feeds.read_quote_csv_feed(spark, str(tmp_path))) == [
        ("X", "2020-01-02", 12.3456), ("X", "2020-01-03", 12.4), ("Y", "2020-01-02", 1.5)
    ]


def test_feeds_take_any_fraction_and_tell_what_they_refuse(spark, tmp_path):
    csv, js = tmp_path / "csv", tmp_path / "json"
    rows = "2020-01-02 00:00:00.0;1,5\n2020-01-03 00:00:00.000;1,6\n2020-01-04 00:00:00.000000;1,7\n2020-01-05 00:00:00;1,8\nsoon;2\n2020-01-06 00:00:00.0\n"
    write(csv / "isin=X" / "a.csv", f"Date;Value\n{rows}")
    assert [r[2] for r in b.rows(quote_feeds.read_quote_csv_feed(spark, str(csv)))] == [1.5, 1.6, 1.7, 1.8]
    assert b.rows(quote_feeds.rejected_csv_quotes(spark, str(csv)), "line", "reason") == [
        ("2020-01-06 00:00:00.0", "too few fields"), ("soon;2", "bad date")
    ]
    block = '{"nested": {"body": {"vars": {"data": [{"rowDateRaw": 86400, "last_closeRaw": "2.5"}]}}}}'
    write(js / "isin=X" / "a.json", '{"body": {"content": {"_list": [%s, {}]}}}' % block)
    write(js / "isin=Y" / "a.json", '{"body": {"content": {"_list": [{}]}}}')
    assert b.rows(quote_feeds.read_quote_json_feed(spark, str(js))) == [("X", "1970-01-02", 2.5)]
    assert b.rows(quote_feeds.rejected_json_quotes(spark, str(js)), "isin", "reason") == [("Y", "no quotes in the response")]


def test_operations_follow_the_files(spark, tmp_path):
    paths = [
        write(tmp_path / "s.txt", "# c\nA|2020-01-02|100\nB|2020-01-01||5.123456\nC|bad\n"),
        write(tmp_path / "r.txt", "A|2020-01-05|1|9.5|all\nA|2020-01-06|-1\nA|2020-01-06|-1.5\n"),
        write(tmp_path / "t.txt", "A|2020-01-07|B||2.1234599\n"),
    ]
    ops, bad = tx.read_operations(spark, *paths, first_id=10)
    assert [(r["op_id"], r["kind"], r["account_id"], r["lots"], r["shares"] and float(r["shares"])) for r in ops.orderBy("op_id").collect()] == [
        (10, "subscription", "A", None, None), (11, "subscription", "B", None, 5.12345),
        (12, "redemption", "A", 1, None), (13, "transfer", "A", None, 2.12345),
    ]
    assert b.rows(bad, "file", "reason") == [
        ("redemption", "quantity not positive"), ("redemption", "quantity not positive"), ("subscription", "bad trade_date")
    ]
    done = replay_ledger(ops, b.accounts(spark, ("A", "X", "B0"), ("B", "X", "B1")), b.quotes(spark, ("X", "2020-01-02", 10)))
    assert b.rows(done.refused, "op_id", "reason") == [(13, "too many shares")]
    assert b.rows(done.sales, "order_id", "shares", "proceeds") == [(12, 10.0, 9.5)]


def test_json_feed_reads_the_last_but_one_block(spark, tmp_path):
    block = '{"nested": {"body": {"vars": {"data": [{"rowDateRaw": %d, "last_closeRaw": %s}]}}}}'
    body = '{"body": {"content": {"_list": [%s, %s, {}]}}}' % (block % (0, 1), block % (86400 * 18263, '"12.34565"'))
    write(tmp_path / "isin=X" / "a.json", body)
    assert b.rows(quote_feeds.read_quote_json_feed(spark, str(tmp_path))) == [("X", "2020-01-02", 12.3457)]


def test_late_and_repeated_quotes_in_the_stream(spark, tmp_path):
    folder, store, checkpoint = tmp_path / "in", new_path(spark, "store"), new_path(spark, "cp")
    sq.empty_table(spark, store, QUOTE)
    for number, text in enumerate(["X|2020-01-05|5\nX|2020-01-06|6\n", "X|2020-01-02|2\nX|2020-01-05|55\n"]):
        write(folder / f"{number}.txt", text)
        sq.stream_quote_ingest(sq.quote_stream(spark, str(folder)), store, checkpoint).awaitTermination()
    assert b.rows(spark.read.parquet(store)) == [("X", "2020-01-02", 2.0), ("X", "2020-01-05", 5.0), ("X", "2020-01-06", 6.0)]


def test_the_older_file_of_a_batch_wins(spark, tmp_path):
    folder, store = tmp_path / "in", new_path(spark, "store")
    sq.empty_table(spark, store, QUOTE)
    for name, text, moment in (("b.txt", "X|2020-01-05|9\n", 1000), ("a.txt", "X|2020-01-05|5\nX|2020-01-06|6\nX|2020-01-06|4\n", 2000)):
        os.utime(write(folder / name, text), (moment, moment))
    sq.stream_quote_ingest(sq.quote_stream(spark, str(folder)), store, new_path(spark, "cp")).awaitTermination()
    assert b.rows(spark.read.parquet(store)) == [("X", "2020-01-05", 9.0), ("X", "2020-01-06", 4.0)]


def test_a_batch_reads_only_its_days(spark, tmp_path):
    tables = b.ledger(
        spark,
        accounts=b.accounts(spark, ("A", "X", "B0")),
        lots=b.lots(spark, *[(k, "A", f"2020-01-{k:02}", f"2020-01-{k:02}", None, 100, None) for k in range(1, 20)]),
    )
    pending = sq.write_pending(tables, new_path(spark, "pending"))
    days = sq._days(b.quotes(spark, ("X", "2020-01-05", 5)), "trade_date")
    plan = spark.read.schema(sq.PENDING_LOT).parquet(f"{pending}/lots").filter(days)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(trade_date,2020-01-05)" in plan.split("PushedFilters")[1]


def test_stream_completes_pending_rows_once(spark, tmp_path):
    tables = b.ledger(
        spark,
        accounts=b.accounts(spark, ("A", "X", "B0")),
        lots=b.lots(spark, (1, "A", "2020-01-02", "2020-01-02", None, 100, None), (2, "A", "2020-01-05", "2020-01-05", 4, None, None)),
        orders=b.orders(spark, (1, "2020-01-05")),
        sales=b.sales(spark, (1, 1, 2, 2, None)),
    )
    folder, checkpoint = tmp_path / "in", new_path(spark, "cp")
    pending = sq.write_pending(tables, new_path(spark, "pending"))
    done_lots = sq.empty_table(spark, new_path(spark, "lots"), LOT)
    done_sales = sq.empty_table(spark, new_path(spark, "sales"), SALE)
    for number, text in enumerate(["X|2020-01-05|5\n", "X|2020-01-02|3\nX|2020-01-05|7\n"]):
        write(folder / f"{number}.txt", text)
        stream = sq.quote_stream(spark, str(folder))
        sq.stream_backfill(stream, pending, done_lots, done_sales, checkpoint).awaitTermination()
    assert b.rows(spark.read.parquet(done_lots), "lot_id", "initial_shares", "cost") == [(1, 33.33333, 100.0), (2, 4.0, 20.0)]
    assert b.rows(spark.read.parquet(done_sales), "sale_id", "proceeds") == [(1, 10.0)]


def test_live_variation_ignores_older_quotes(spark, tmp_path):
    folder, output, checkpoint = tmp_path / "in", new_path(spark, "out"), new_path(spark, "cp")
    for number, text in enumerate(["X|2020-01-05|10\nX|2020-01-06|11\n", "X|2020-01-02|2\nX|2020-01-07|22\n"]):
        write(folder / f"{number}.txt", text)
        sq.stream_variation(sq.quote_stream(spark, str(folder)), output, checkpoint).awaitTermination()
    found = [(str(r["date"]), round(r["variation"], 6)) for r in spark.read.parquet(output).orderBy("date").collect()]
    assert found == [("2020-01-06", 10.0), ("2020-01-07", 100.0)]
    assert dt.date(2020, 1, 2) not in {r["date"] for r in spark.read.parquet(output).collect()}


def test_variation_state_steps():
    import pandas as pd

    def batch(*rows):
        return pd.DataFrame([(b.day(d), b.dec(n)) for d, n in rows], columns=["date", "nav"])

    first, last = variation_state.advance("X", [batch(("2020-01-03", 3), ("2020-01-02", 2)), batch(("2020-01-03", 1))], None)
    assert first.values.tolist() == [["X", b.day("2020-01-03"), b.dec(1), b.dec(2)]] and last == (b.day("2020-01-03"), b.dec(1))
    later, last = variation_state.advance("X", [batch(("2020-01-01", 9), ("2020-01-06", 4), ("2020-01-05", 2))], last)
    assert later["previous"].tolist() == [b.dec(1), b.dec(2)] and last == (b.day("2020-01-06"), b.dec(4))
    none, last = variation_state.advance("X", [batch(("2020-01-01", 9))], last)
    assert none.empty and last == (b.day("2020-01-06"), b.dec(4))


def test_release_empties_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path / "shared"))
    assert session.written(spark.range(5), "numbers").count() == 5
    assert list((tmp_path / "shared").rglob("*.parquet"))
    session.release(spark)
    assert not (tmp_path / "shared").exists()


def test_text_files_are_written_compressed_and_read_back_whole(spark):
    lines = spark.range(2000).select(F.concat_ws(" | ", F.lit("acc"), F.col("id")).alias("value"))
    folder = files.append_lines(lines, new_path(spark, "text"))
    back = spark.read.text(folder)
    assert all(name.endswith(".gz") for name in back.inputFiles())
    assert sorted(r.value for r in back.collect()) == sorted(r.value for r in lines.collect())
