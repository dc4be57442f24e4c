import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfrank.llm import chat as C


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<<s>s>", "[[INST]", "[/INST", "a\nb\r\n", "🙂漢\\[INST]é", "<s><s></s>", "$1 \\$", "x" * 5000, "</s", "\\n\\", "[\\INST]"]


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices(["<", "s", ">", "/", "\\", "[", "INST", "]", "</s>", "\n", "🙂"], k=12)) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape(F.col("t")).alias("e")).withColumn("back", C.unescape(F.col("e"))).collect()
    for r in got:
        assert r.back == r.t and not any(m in r.e for m in (C.OPEN, C.HEAD, C.TEXT, C.CLOSE))


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "</s>"]), rng.choice([*ODD, None])) for c in range(30) for t in range(rng.randrange(1, 20))]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (50, None, "assistant", "no turn"), (50, 0, "user", "hi")]
    return rows + [(51, 0, "assistant", "same")] * 3 + [(52, t, "assistant", f"long {t}") for t in range(300)]


def test_conversations_against_plain_code(spark, talks):
    docs = spark.createDataFrame([(*r, "x", 1) for r in talks], "conv_id long, turn long, role string, text string, leaf string, node int").repartition(7)
    got = {r.conv_id: r[1:] for r in C.digest(C.conversations(docs)).collect()}
    want = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in talks}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in talks if r[0] == conv), key=order)]
        loss = "".join(t for role, t in turns if role == "assistant")
        size = 0
        for role, text in turns:
            for part in (role, text):
                for m in ("\\", "<s>", "[INST]", "[/INST]", "</s>"):
                    size += part.count(m)
                size += len(part)
            size += len("<s>[INST][/INST]</s>")
        want[conv] = (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), size)
    assert got == want


def test_paths_and_ranks_of_trees(spark):
    """Random trees against a walk from every leaf; a circle, a parent that isn't there, one's own parent, another tree's."""
    rng = random.Random(3)
    rows, number = [], 0
    for tree in range(12):
        own = []
        for _ in range(rng.randrange(1, 60)):
            rows.append((tree, number, rng.choice(own) if own and rng.random() < 0.9 else None, rng.choice([None, 0.5, 1.0, 2.0, -1.0])))
            own.append(number)
            number += 1
    rows += [(20, 900 + i, 900 + (i + 1) % 5, 1.0) for i in range(5)] + [(20, 910, 900, 1.0), (20, 920, 920, 1.0), (20, 921, 920, 3.0), (21, 930, 5000, 0.0), (22, 940, 930, 1.0)]
    rows += [(30, 2000 + i, 2000 + i - 1 if i else None, 0.0) for i in range(70)]
    tree, parent = {r[1]: r[0] for r in rows}, {r[1]: r[2] for r in rows}
    score = {r[1]: r[3] or 0.0 for r in rows}
    up = {n: p if p is not None and p != n and tree.get(p) == tree[n] else None for n, p in parent.items()}
    ways = {}
    for leaf in set(up) - set(up.values()):
        way, at = [], leaf
        while at is not None and len(way) <= len(up):
            way.append(at)
            at = up[at]
        if at is None:
            ways[leaf] = way
    ranked = {}
    for t in set(tree.values()):
        leaves = sorted((x for x in ways if tree[x] == t), key=lambda x: (-sum(score[n] for n in ways[x]), x))
        ranked.update({x: (t, i + 1) for i, x in enumerate(leaves)})
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, score double").repartition(5)
    for best in (None, 2):
        got = {}
        for r in C.branches(messages, best).collect():
            assert (r.tree, r["rank"]) == ranked[r.leaf] and r.score == sum(score[n] for n in ways[r.leaf])
            got.setdefault(r.leaf, {})[r.back] = r.node
        assert {x: [w[i] for i in range(len(w))] for x, w in got.items()} == {x: w for x, w in ways.items() if best is None or ranked[x][1] <= best}


def test_branches_share_messages(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "good"), (1, 3, 1, 0.0, "assistant", "bad"), (1, 4, 2, 0.0, "user", "more")]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    got = C.read_back(C.format_branches(C.branches(messages.select("tree", "node", "parent", "score")), messages)).orderBy("rank").collect()
    assert [[tuple(t) for t in r.turns] for r in got] == [[("user", "q"), ("assistant", "good"), ("user", "more")], [("user", "q"), ("assistant", "bad")]]
    assert [r.loss_text for r in got] == ["good", "bad"]
    assert got[1].formatted == "<s>[INST]user[/INST]q</s><s>[INST]assistant[/INST]bad</s>"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digest(C.conversations(docs)).count() == 0


def test_no_python_in_the_plan(spark, talks):
    docs = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    plan = C.digest(C.conversations(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
