import pytest
from graphloom.operators import trees as T
from hypothesis import given, settings
from hypothesis import strategies as st

WHY = "(ROOT (SBARQ (WHADVP (WRB Why)) (SQ (VBD did) (NP (NNS cases)) (VP (VB rise)))))"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


label = st.sampled_from(["S", "NP", "VP", "X"])
tree = st.recursive(st.tuples(label, st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=3)), lambda t: st.tuples(label, st.lists(t | st.sampled_from(["a", "b"]), min_size=1, max_size=3)), max_leaves=12)


@given(tree)
@settings(max_examples=60, deadline=None)
def test_actions_build_the_tree(t):
    text = T.written(t)
    assert T.parse(text) == t
    actions = T.action_list(t)
    assert T.replay(actions) == (text, None)
    for n in range(1, len(actions)):
        part, front = T.replay(actions[:n])
        assert part is None and front is not None
        step = actions[n]
        assert front == ("reduce" if step == "reduce" else "*" if step.startswith("word") else step.split()[1])


@pytest.mark.parametrize("text", [None, "", "(", "(S (a)", "S a", "(S a) b", "()", "(S a))"])
def test_what_is_no_tree(text):
    assert T.parse(text) is None


def test_tables_of_trees(spark):
    data = spark.createDataFrame([(1, WHY, "x"), (2, "(S)", "x"), (3, None, "x"), (4, "(S (", "x")], "tree_id long, tree string, note string")
    table = T.nodes(data).cache()
    assert rows(T.shapes(table)) == [(1, 14, 4, 5, "Why did cases rise"), (2, 1, 0, 0, "<None>")]
    assert rows(T.sane(table)) == [(1, True), (2, True)]
    assert rows(T.sane(table.where("not (tree_id = 1 and node = 3)")))[0] == (1, False)
    built = T.actions(data)
    g = T.grammar(built)
    assert ("SQ -> VBD NP VP", "SQ") in {(r["rule"], r["lhs"]) for r in g.collect()} and {r["id"] for r in g.collect()} == set(range(g.count()))
    kinds = {r["type"]: r["kind"] for r in T.types(g).collect()}
    assert kinds["WRB"] == "terminal" and kinds["SQ"] == "composite"
    same = T.equal(data, spark.createDataFrame([(1, WHY.replace(" ", "\n ")), (2, "(S a)"), (9, "(S)")], "tree_id long, tree string"))
    assert rows(same) == [(1, True), (2, False), (3, False), (4, False), (9, False)]
    assert T.nodes(data.limit(0)).count() == 0 == T.actions(data.limit(0)).count()


def test_hypotheses_go_on(spark):
    data = spark.createDataFrame([(1, "(S (N a) (V b))"), (2, "(S (N c))")], "tree_id long, tree string")
    g = T.grammar(T.actions(data))
    h = spark.createDataFrame([(1, ["apply S -> N V"]), (2, ["apply S -> N V", "apply N -> *"]), (3, ["apply N -> *", "word a"]), (4, ["word a"]), (5, None)], "hyp long, actions array<string>")
    fronts = T.replayed(h)
    assert rows(fronts) == [(1, None, "N"), (2, None, "*"), (3, None, "reduce"), (4, None, None), (5, None, None)]
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    assert rows(T.continuations(fronts, g, words)) == [(1, "apply N -> *"), (2, "word a"), (2, "word b"), (3, "reduce")]
    hyps = spark.createDataFrame([(7, 1, ["x"], -1.0), (7, 2, ["y"], -2.0)], "sample long, hyp long, actions array<string>, score double")
    nxt = spark.createDataFrame([(7, 1, "p", -3.0), (7, 1, "q", -0.5), (7, 2, "p", -0.1)], "sample long, hyp long, action string, score double")
    assert rows(T.beam(hyps, nxt, 2)) == [(7, ["x", "q"], -1.5), (7, ["y", "p"], -2.1)]


def test_training_rows(spark):
    data = spark.createDataFrame([(i, f"(S (N w{i % 3}) (V go))") for i in range(40)], "tree_id long, tree string")
    found, g, v = T.dataset(data, {"train": 70, "test": 30})
    assert found.count() == 40 and {r["part"] for r in found.collect()} == {"train", "test"} and g.count() == 3
    src = spark.createDataFrame([(0, ["w0", "go"])], "tree_id long, tokens array<string>")
    got = {r["step"]: r for r in T.steps(found.where("tree_id < 2"), src, g, v).where("tree_id = 0").collect()}
    assert got[0]["rule_id"] is not None and got[2]["copied"] and got[2]["copy_at"] == 0 and got[5]["copy_at"] == 1 and got[3]["rule_id"] is None is got[3]["token_id"]
    assert not any(r["copied"] for r in T.steps(found, src, g, v).where("tree_id = 1 and token_id is not null").collect())
    s = T.action_statistics(found, 7).first()
    assert (s["most"], s["mean"], s["long"]) == (8, 8.0, 40)
    b = T.batches(data, 10, "tree_id").collect()
    assert len(b) == 40 and max(r["batch"] for r in b) <= 3
    p = T.predicted_class(spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 1.0]), (3, None)], "id long, logits array<double>"))
    assert [(r["id"], r["label"]) for r in p.orderBy("id").collect()] == [(1, 1), (2, 0), (3, None)]


def test_pointers(spark):
    lines = spark.createDataFrame([(1, [2, 0, 2, 3]), (2, [-1, 0]), (3, [2, 1]), (4, [])], "tree_id long, parents array<int>")
    assert rows(T.pointer_depths(lines)) == [(1, 1, 2, 1), (1, 2, 0, 0), (1, 3, 2, 1), (1, 4, 3, 2), (2, 2, 0, 0), (3, 1, 2, None), (3, 2, 1, None)]


@given(tree)
@settings(max_examples=60, deadline=None)
def test_checks_of_one_tree(t):
    table = list(T.walk(t))
    assert T.is_sane(table) and T.shape(table)[:2] == (len(table), sum(r[5] for r in table))
    lost = [(n + 100, p, *rest) if p is None else (n, p, *rest) for n, p, *rest in table]  # the root's children have no parent left
    gap = [(n, p, o + 1 if p == 0 else o, *rest) for n, p, o, *rest in table]
    for bad in (lost, gap, [*table, table[0]], table[1:], [(0, 0, *r[2:]) if r[1] is None else r for r in table]):
        assert not T.is_sane(bad)


def test_trees_are_checked_each_by_itself(spark):
    data = spark.createDataFrame([(1, WHY, "x"), (2, "(S)", "x"), (3, None, "x"), (4, "(S (", "x")], "tree_id long, tree string, note string")
    assert rows(T.shapes_of(data)) == rows(T.shapes(T.nodes(data)))
    assert rows(T.sane_of(data)) == rows(T.sane(T.nodes(data)))
    for f in (T.shapes_of, T.sane_of):  # no shuffle of node rows
        assert "Exchange" not in f(data)._jdf.queryExecution().executedPlan().toString()


def test_small_batches_hold_all_nodes(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS", 20)
    data = spark.range(50).selectExpr("id as tree_id", f"'{WHY}' as tree").coalesce(1)
    assert T.nodes(data).groupBy("tree_id").count().where("count = 14").count() == 50
