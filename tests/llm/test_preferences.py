from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lotwise.llm import preferences
from lotwise.llm.common import ready, table

SCHEMA = "pair_id long, turn long, role string, text string"
CHOSEN = [
    (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "good"),
    (2, 0, "user", "only chosen"),
    (3, 0, "user", "same"), (3, 1, "assistant", "same"),
    (4, None, None, None), (4, 0, "user", "x"), (4, 0, "user", "x"), (4, 1, "assistant", ""),
    (5, 0, "user", "l"), (5, 1, "assistant", "m"),
    (None, 0, "user", "none"),
]
REJECTED = [
    (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "bad"), (1, 4, "user", "why"),
    (3, 0, "user", "same"), (3, 1, "assistant", "same"),
    (4, None, "unknown", ""), (4, 0, "user", "x"), (4, 1, "assistant", "y"),
    (5, 0, "user", "l"), (6, 0, "user", "only rejected"),
]


def brute(chosen, rejected):
    sides = []
    for rows in (chosen, rejected):
        side = defaultdict(lambda: defaultdict(Counter))
        for pair, turn, role, text in rows:
            if pair is not None:
                side[pair][preferences.FIRST if turn is None else turn][(role or "unknown", text or "")] += 1
        sides.append(side)
    out = Counter()
    for pair in set(sides[0]) & set(sides[1]):
        left, right = sides[0][pair], sides[1][pair]
        differ = [t for t in set(left) | set(right) if left.get(t) != right.get(t)]
        cut = min(differ, default=None)
        for part, side in (("chosen", left), ("rejected", right)):
            for turn, rows in side.items():
                before = cut is None or turn < cut
                if before and part == "rejected":
                    continue
                for (role, text), n in rows.items():
                    head = f"<|im_start|>{role}\n"
                    whole = f"{head}{text}<|im_end|>\n"
                    trained = (len(head), len(whole)) if not before and role == "assistant" else (None, None)
                    shown = None if turn == preferences.FIRST else turn
                    out[(pair, "prompt" if before else part, shown, role, whole, *trained)] += n
    return out


def test_pairs_match_brute_force(spark):
    ready(spark)
    sides = [spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("clash")).withColumn("split", F.lit(0))
             for rows in (CHOSEN, REJECTED)]
    got = Counter(map(tuple, preferences.format_pairs(*sides).collect()))
    assert got == brute(CHOSEN, REJECTED)
    assert {r[1] for r in got if r[0] == 3} == {"prompt"} and not any(r[0] in (2, 6, None) for r in got)


def test_whole_prompt_and_completions(spark):
    ready(spark)
    rows = preferences.format_pairs(spark.createDataFrame(CHOSEN, SCHEMA), spark.createDataFrame(REJECTED, SCHEMA))
    parts = defaultdict(str)
    trained = defaultdict(str)
    for r in rows.filter("pair_id = 1").orderBy("turn").collect():
        parts[r["part"]] += r["rendered"]
        if r["trained_from"] is not None:
            trained[r["part"]] += r["rendered"][r["trained_from"] : r["trained_to"]]
    assert parts["prompt"].count("<|im_start|>") == 3 and parts["prompt"].endswith("user\nc<|im_end|>\n")
    assert trained == {"chosen": "good<|im_end|>\n", "rejected": "bad<|im_end|>\n"}


def test_real_conversations_match_brute_force(spark):
    sides = preferences.replaced_reply(table(spark, "/root/testdata/sf0.01", "conversations"))
    rows = [[tuple(r) for r in s.select("pair_id", "turn", "role", "text").collect()] for s in sides]
    got = Counter(map(tuple, preferences.format_pairs(*sides).collect()))
    assert got == brute(*rows) and len({r[0] for r in got}) > 50


def test_sparse_ids_and_turns_after_the_last_reply_are_kept(spark):
    ready(spark)
    ids = [-(2**40), 10, 20, 31, 2**50]
    rows = [r for k in ids for r in ((k, 0, "user", f"u{k}"), (k, 1, "assistant", f"a{k}"), (k, 2, "user", "bye"))]
    talks = spark.createDataFrame([*rows, (15, 0, "user", "no reply"), (None, 0, "assistant", "x")], SCHEMA)
    sides = preferences.replaced_reply(talks.withColumnRenamed("pair_id", "conv_id").repartition(4))
    got = {(r["pair_id"], r["part"], r["turn"]): r["rendered"] for r in preferences.format_pairs(*sides).collect()}
    assert len(got) == 5 * len(ids)
    for k, donor in zip(ids, [*ids[1:], ids[0]]):
        assert f"a{k}<" in got[k, "chosen", 1] and f"a{donor}<" in got[k, "rejected", 1]
        assert got[k, "chosen", 2] == got[k, "rejected", 2] and f"u{k}<" in got[k, "prompt", 0]


def test_empty_tables(spark):
    ready(spark)
    none = spark.createDataFrame([], SCHEMA)
    assert preferences.format_pairs(none, spark.createDataFrame(REJECTED, SCHEMA)).count() == 0
    sides = preferences.replaced_reply(none.withColumnRenamed("pair_id", "conv_id"))
    assert preferences.format_pairs(*sides).count() == 0
