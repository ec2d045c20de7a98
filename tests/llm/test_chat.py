from __future__ import annotations

from tests.llm.brute import sha
from tideline.llm import chat

NODE = "tree long, node long, parent long, role string, text string, score double"
TRICKY = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "a\\b\\\\<", "<<SYS>>\n<</SYS>>", "", "é<s>", "\\<|", "[/INST"]


def told(nodes, branches=None):
    return chat.read_back(chat.format_trees(nodes, branches)).collect()


def test_round_trip_of_tricky_texts(spark):
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "us|er\n<s>", t, None) for i, t in enumerate(TRICKY)]
    (row,) = told(spark.createDataFrame(rows, NODE))
    assert row.texts == TRICKY
    assert row.roles == [r[3] for r in rows]
    assert row.loss == [t for i, t in enumerate(TRICKY) if i % 2]
    for span in row.loss_spans:
        inside = row.formatted[span.start : span.start + span.length]
        assert row.formatted[span.start + span.length :].startswith(chat.END)
        assert "<|" not in inside and "</s>" not in inside and "[INST]" not in inside


def test_branches_are_paths_ranked_by_score(spark):
    rows = [
        (7, 1, None, "user", "q", 0.0),
        (7, 2, 1, "assistant", "a", 1.0),
        (7, 3, 1, "assistant", "b", 2.0),
        (7, 4, 2, "user", "c", 5.0),
        (7, 5, 99, "user", "lost parent", None),
        (None, 1, None, "user", "no tree", 0.0),
    ]
    found = told(spark.createDataFrame(rows, NODE))
    paths = {(r.tree, r.leaf): (r.branch, r.score, r.texts) for r in found}
    assert paths == {
        (7, 4): (1, 6.0, ["q", "a", "c"]),
        (7, 3): (2, 2.0, ["q", "b"]),
        (7, 5): (3, 0.0, ["lost parent"]),
        (None, 1): (1, 0.0, ["no tree"]),
    }
    best = told(spark.createDataFrame(rows, NODE), branches=1)
    assert sorted((r.tree or 0, r.leaf) for r in best) == [(0, 1), (7, 4)]


def test_long_thread(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(70)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = told(chat.threads(frame))
    assert row.texts == [r[3] for r in rows] and row.n_turns == 70
    assert sha("".join(row.loss)) == sha("".join(r[3] for r in rows if r[2] == "assistant"))


def test_nulls_ties_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, None, None), (1, 2, "user", "x"), (1, 2, "user", "x")]
    (row,) = told(chat.threads(spark.createDataFrame(rows, schema)))
    assert row.texts == ["", "x", "x"] and row.roles == ["", "user", "user"] and row.loss == []
    assert told(chat.threads(spark.createDataFrame([], schema))) == []


def test_cycles_do_not_harm_other_paths(spark):
    """A cycle, a leaf below it, a node that is its own parent; good paths beside them."""
    cyclic = [(1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 4, 3), (3, 9, 9)]
    good = [(1, 10, None), (1, 11, 10), (2, 1, None), (2, 2, 1), (2, 3, 2), (4, 1, None)]
    rows = [(t, n, p, "user", f"{t}-{n}", 0.0) for t, n, p in cyclic + good]
    frame = spark.createDataFrame(rows, NODE)
    found = {(r.tree, r.leaf): r.texts for r in told(frame)}
    assert found == {(1, 11): ["1-10", "1-11"], (2, 3): ["2-1", "2-2", "2-3"], (4, 1): ["4-1"]}
    assert sorted(map(tuple, chat.rootless(frame).collect())) == [c[:2] for c in cyclic]


def test_repeated_nodes_count_once_and_rows_without_id_are_left_out(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0),
        (1, 2, 1, "assistant", "b", 1.0),
        (1, 2, 1, "assistant", "b", 1.0),
        (1, 2, 1, "assistant", "a", 1.0),
        (1, None, 1, "assistant", "no id", 1.0),
        (None, 5, None, "user", "x", None),
        (None, 5, None, "user", "x", None),
    ]
    found = {(r.tree, r.leaf): (r.n_turns, r.texts) for r in told(spark.createDataFrame(rows, NODE))}
    assert found == {(1, 2): (2, ["q", "a"]), (None, 5): (1, ["x"])}
