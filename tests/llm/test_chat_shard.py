import hashlib
import zlib
from collections import defaultdict

import pytest

from propstats.catalog import check
from propstats.llm import chat, queries, sharding
from propstats.llm.common import table


def told(turns):
    h = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(h.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def expected(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        conv[c].append((turn if turn is not None else -(10**30), role or "", text or ""))
    return {c: told([(r, t) for _, r, t in sorted(v)]) for c, v in conv.items()}


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_op3_reads_back_every_conversation(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    assert got(queries.op3_chat_formatting(spark, sf_dir)) == expected([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


ODD = [
    (1, 0, "system", "be\\<|kind"), (1, 1, "user", None), (1, 2, "assistant", "\\\\<|im_end|>\n"), (1, None, "user", "first?"),
    (2, 0, None, "x"), (2, 0, "a\nb%<|im_start|>", "\n"), (2, 0, "a\nb%<|im_start|>", "\n"), (None, 5, "assistant", "null conversation"),
    (3, 0, "assistant", ""), (4, 0, "assistant", "long " * 5000), (4, 1, "user", "😀é<"), (4, 2, "assistant", "😀|>\\"),
    *[(5, i, "system" if i == 0 else ("user", "assistant")[i % 2], f"turn {i} " * (i % 17)) for i in range(3000)],
]


@pytest.mark.parametrize("budget,history", [(1024, 128), (64, 16), (8, 0)])
def test_windows_keep_turns_whole_and_budgets(spark, budget, history):
    df = spark.createDataFrame([(*r, 1, 2) for r in ODD], "conv_id long, turn long, role string, text string, window int, p int")
    made = chat.windows(df, budget, history).cache()
    assert got(chat.digests(made)) == expected(ODD)
    rows = made.collect()
    system = next(r.text for r in rows if r.conv_id == 5 and r.window == 0).split("<|im_end|>\n")[0]
    for r in rows:
        assert r.over_budget == (r.tokens > budget)
        own = r.text.count(chat.START) - r.n_repeated
        assert own >= 1
        if r.over_budget:
            assert own == 1 or budget < 64
        if r.conv_id == 5:
            assert r.text.startswith(system)
        for span in r.loss:
            assert r.text[: span.start].endswith("<|im_start|>assistant\n") and r.text[span.end :].startswith("<|im_end|>")
    if history:
        assert any(r.n_repeated > 1 for r in rows)


def test_op3_agrees_with_sql(spark, sf_dir):
    problems, rows = check.compare(queries.op3_chat_formatting(spark, sf_dir), check.connect(sf_dir), queries.oracle_sql()["op3_chat_formatting"])
    assert not problems and rows > 0


def test_no_python_in_the_formatter(spark, sf_dir):
    plan = queries.op3_chat_formatting(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.windows(df)).count() == 0


def test_op2_law_and_slots(spark, sf_dir):
    rows = queries.op2_sharding(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_movement_is_confined(spark):
    df = spark.range(40000).selectExpr("id AS doc_id", "CAST(null AS string) AS text", "1 AS shard", "2 AS slot", "3 AS bucket")
    tree = sharding.even_tree(2, 2, 4)
    heavier = sharding.Node("root", (tree.children[0], sharding.Node("region-1", (tree.children[1].children[0], sharding.Node("rack-1-1", (*tree.children[1].children[1].children, sharding.leaf(16)))))))
    rows = sharding.assign(df, tree, heavier).collect()
    counts = [sum(r.shard == s for r in rows) for s in range(16)]
    assert max(counts) < 1.15 * 2500 and min(counts) > 0.85 * 2500
    # A rack gained weight: rows move only into its region, and within the region only into that rack.
    for r in rows:
        if r.shard != r.grown_shard:
            assert r.grown_shard >= 8 and (r.shard < 8 or r.grown_shard >= 12)
    new = [r for r in sharding.assign(df, tree, sharding.with_new_region(tree, 16)).collect() if r.shard != r.grown_shard]
    assert {r.grown_shard for r in new} == {16} and 0.8 < len(new) / (40000 / 17) < 1.2


def test_sharding_odd_rows(spark):
    rows = [(None, "a"), (None, "a"), (1, None), (1, None), (2, ""), (3, "é" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.assign(df, sharding.even_tree(1, 1, 2)).collect()
    assert len(out) == 6 and sorted(r.size for r in out) == [1, 1, 1, 2, 2, 200_001]
    for s in (0, 1):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign(df.limit(0), sharding.even_tree(1, 1, 2)).count() == 0
    weightless = sharding.Node("root", (sharding.leaf(0, 0.0), sharding.leaf(1)))
    assert {r.shard for r in sharding.assign(df, weightless).collect()} == {1}
