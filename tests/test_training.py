"""Samples, split, packing, chat rendering, JSON contract, state (FIXTURES 6-7)."""

import hashlib
import json

from pyspark.sql import functions as F

from docforge.functions.chat import render_sample, user_turn
from docforge.operators.chat import assemble_conversations, evaluation_prompts, prompt_table
from docforge.operators.contract import RULES, contract_checks, violations
from docforge.operators.train_prep import (pack_blocks, split_boundary, train_test_split,
                                           training_lengths)
from docforge.params import (BEGIN_OF_TEXT, EVAL_SYSTEM_PROMPT, EXAMPLE_PROMPTS, GOLDEN_QUESTIONS,
                             INSTRUCTION_TEMPLATES, SERVING_SYSTEM_PROMPT, HarvestParams)
from docforge.sources.samples_io import read_samples, to_json_line, write_samples


def test_templates():
    assert len(INSTRUCTION_TEMPLATES) == 6
    assert all("{topic}" in t for t in INSTRUCTION_TEMPLATES)
    assert len({t.split()[0] for t in INSTRUCTION_TEMPLATES}) >= 3


def test_split_sizes_and_repartition_invariance(spark):
    for n, k in [(10, 1), (101, 11)]:
        df = spark.createDataFrame([(str(i),) for i in range(n)], "sample_id string")
        a = train_test_split(df.coalesce(1), "sample_id")
        b = train_test_split(df.repartition(7), "sample_id")
        ta = {r.sample_id for r in a.where(F.col("split") == "test").collect()}
        tb = {r.sample_id for r in b.where(F.col("split") == "test").collect()}
        assert len(ta) == k and ta == tb


def test_group_split_keeps_groups_whole(spark):
    from docforge.operators.train_prep import group_split
    rows = [(f"p{i % 20}", str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "page string, sample_id string")
    out = group_split(df, "page").collect()
    sides = {}
    for r in out:
        sides.setdefault(r.page, set()).add(r.split)
    assert all(len(v) == 1 for v in sides.values())
    assert sum(1 for v in sides.values() if v == {"test"}) == 2
    assert len(out) == 200


def test_packing(spark):
    df = spark.createDataFrame([("a", 1, 3), ("b", 2, 4), ("c", 3, 5)], "k string, o int, n long")
    seg = pack_blocks(df, "k", ["o"], "n", block=5).orderBy("block_id", "from_tok").collect()
    assert max(r.block_id for r in seg) == 2
    total = sum(r.to_tok - r.from_tok for r in seg)
    assert total == 15


def test_chat_layout(spark):
    df = spark.createDataFrame([("I", "Source: u", "A")], "i string, s string, o string")
    r = df.select(user_turn(F.col("i"), F.col("s")).alias("u"),
                  render_sample(F.col("i"), F.col("s"), F.col("o"), system="S").alias("t")).first()
    assert r.u == "I\nContext: Source: u"
    assert r.t == (BEGIN_OF_TEXT + "<|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|>"
                   "<|start_header_id|>user<|end_header_id|>\n\nI\nContext: Source: u<|eot_id|>"
                   "<|start_header_id|>assistant<|end_header_id|>\n\nA<|eot_id|>")


def test_history_assembly(spark):
    rows = [(1, 0, "user", "u1"), (1, 1, "assistant", "a1"), (1, 2, "user", "u2"),
            (1, 3, "assistant", "  "), (1, 4, "user", "m")]
    h = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = assemble_conversations(h).first()
    assert r.n_messages == 5
    assert r.prompt.count("<|start_header_id|>") == 5
    assert SERVING_SYSTEM_PROMPT in r.prompt
    assert r.prompt.index("u1") < r.prompt.index("a1") < r.prompt.index("u2") < r.prompt.index("\n\nm<|eot_id|>")


def test_blank_prompt_dropped(spark):
    q = spark.createDataFrame([(1, "   "), (2, "hello")], "id int, text string")
    assert [r.id for r in prompt_table(q, ["id"], "text").collect()] == [2]


def test_json_round_trip_and_contract(spark, tmp_path):
    s = spark.createDataFrame([("Test instruction", "Source: https://example.com",
                                "Test output content")], "instruction string, input string, output string")
    path = str(tmp_path / "s")
    write_samples(s, path, mode="overwrite")
    back = read_samples(spark, path).select("instruction", "input", "output").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in s.collect()]
    lines = spark.createDataFrame([
        (json.dumps({"instruction": INSTRUCTION_TEMPLATES[0].format(topic="x"),
                     "input": "Source: u", "output": "o"}),),
        ('{"instruction": "nope", "input": "u", "output": "o", "extra": "1"}',)], "line string")
    r = contract_checks(lines).collect()
    assert all(r[0][k] for k in RULES) and r[0].n_keys == 3
    assert [k for k in RULES if r[1][k]] == ["round_trip_ok"]
    assert to_json_line(s).first().line.startswith('{"instruction":')


def test_contract_rules_one_by_one(spark):
    good = {"instruction": INSTRUCTION_TEMPLATES[1].format(topic="a\nb é"), "input": "Source: u", "output": "o"}
    cases = [
        (json.dumps(good), []),
        (json.dumps(good, ensure_ascii=False, indent=1), []),
        (json.dumps({**good, "output": True}), ["types_ok"]),
        (json.dumps({**good, "instruction": 5}), ["types_ok", "instruction_ok"]),
        (json.dumps({**good, "output": None}), ["types_ok", "round_trip_ok"]),
        (json.dumps({k: good[k] for k in ("instruction", "input")}), ["keys_ok", "types_ok", "round_trip_ok"]),
        (json.dumps({**good, "more": "x"}), ["keys_ok", "types_ok"]),
        (json.dumps({**good, "input": "source: u"}), ["input_ok"]),
        (json.dumps([good]), list(RULES)), ("", list(RULES)), (None, list(RULES)), ("{broken", list(RULES)),
    ]
    lines = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, line string")
    got = {i: [] for i in range(len(cases))}
    for r in violations(contract_checks(lines), ["i"]).collect():
        got[r.i].append(r.rule)
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_null_user_turn_is_rendered_empty(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", None), (1, 2, "assistant", "a")]
    r = assemble_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert r.n_messages == 3 and r.prompt.count("<|start_header_id|>") == 3


def test_evaluation_prompts(spark):
    rows = [(1, 0, "system", "own"), (1, 1, "user", "u"), (2, 0, "user", "u"), (3, 0, "system", "")]
    got = evaluation_prompts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    n = len(GOLDEN_QUESTIONS) + len(EXAMPLE_PROMPTS)
    assert got.count() == 3 * n
    by = {(r.conv_id, r.prompt_set, r.prompt_id): r.prompt for r in got.collect()}
    assert EVAL_SYSTEM_PROMPT in by[1, "golden", 0] and "\n\nown<" in by[1, "example", 0]
    assert SERVING_SYSTEM_PROMPT in by[2, "example", 7] and SERVING_SYSTEM_PROMPT in by[3, "example", 0]


def test_split_moves_no_text(spark):
    df = spark.range(1000).selectExpr("cast(id AS string) AS k", "repeat('x', 50) AS output")
    out = train_test_split(df, "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and out.where("split = 'test'").count() == 100


def test_split_boundary_is_the_row_of_its_rank(spark):
    keys = spark.range(5000).selectExpr("cast(id % 4990 AS string) AS key")
    want = sorted((hashlib.md5(f"42#{r.key}".encode()).hexdigest(), r.key) for r in keys.collect())
    for k in (1, 2, 500, 4999, 5000):
        assert split_boundary(keys, k, few=7) == want[k - 1]
    assert split_boundary(keys, 0) is None and split_boundary(keys, 5001) is None


def test_pluggable_lengths(spark):
    s = spark.createDataFrame([("k", "a b", "Source: u", "c d e")],
                              "sample_id string, instruction string, input string, output string")
    p = HarvestParams(formatter=lambda i, x, o: o, token_counter=lambda t: F.length(t).cast("bigint"))
    assert training_lengths(s, ["sample_id"], p).first().n_tok == 5
    assert training_lengths(s, ["sample_id"]).first().n_tok > 5


def test_state_round_trip_and_corrupt(spark, tmp_path):
    from docforge.sources.state import CrawlState
    d = str(tmp_path / "state")
    st = CrawlState(spark, d)
    assert st.steps == 0 and st.frontier() is None and st.read("log").count() == 0
    st.write("log", spark.createDataFrame([(f"url{k}", 0, [k], k, "kept", 1) for k in (1, 2, 3)],
                                          "url string, depth int, crawl_key array<long>, page_id long, "
                                          "gate_reason string, n_samples long"))
    st.write("frontier", spark.createDataFrame([("url4", 1, [0]), ("url5", 1, [1])],
                                               "url string, depth int, crawl_key array<long>"))
    assert CrawlState(spark, d).steps == 0          # not committed yet
    st.commit(42, 1)
    st = CrawlState(spark, d)
    assert (st.collected, st.steps, st.depth) == (42, 1, 1)
    assert {r.url for r in st.read("log").collect()} == {"url1", "url2", "url3"}
    assert {r.url for r in st.frontier().collect()} == {"url4", "url5"}
    (tmp_path / "state" / "step=0" / "_COMMITTED.json").write_text("{invalid json")
    for crc in (tmp_path / "state" / "step=0").glob("._COMMITTED*.crc"):
        crc.unlink()
    assert CrawlState(spark, d).steps == 0


def test_split_boundary_counts_repeated_keys(spark, monkeypatch):
    """A key that most rows share is one row with a count: nothing comes to the driver for it."""
    keys = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('k', id) END AS key")
    import hashlib
    want = sorted((hashlib.md5(f"42#{r.key}".encode()).hexdigest(), r.key) for r in keys.collect())
    sent = []
    collect = type(keys).collect
    monkeypatch.setattr(type(keys), "collect", lambda self: sent.append(rows := collect(self)) or rows)
    for k in (1, 500, 1500, 2999, 3000):
        assert split_boundary(keys, k, few=7) == want[k - 1]
    assert max(map(len, sent)) <= 4096 and sum(map(len, sent)) < 6000


def test_group_split_computes_its_rows_once(spark):
    """The groups' sides come from written keys: the rows' plan is there once."""
    from docforge.operators.train_prep import group_split
    df = spark.range(40).selectExpr("id", "id % 7 AS g")
    out = group_split(df, "g")
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    assert out.count() == 40 and out.where("split = 'test'").select("g").distinct().count() == 1


def test_packing_reads_the_texts_once(spark):
    """The split and the packing of the query read written lengths: no text is cut again for them."""
    from docforge.queries import QUERIES
    from tests.conftest import SF_SMALL
    df = QUERIES["pack_blocks"](spark, SF_SMALL)
    assert not [f for f in df.inputFiles() if "documents" in f]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and df.count() > 0
