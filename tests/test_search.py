from matchledger.operators import search


def test_phrases_of_any_length_and_from_their_middle_on(spark):
    opening = "one two three four five six seven eight"
    passages = [(1, opening + " nine ten"), (2, opening + " other end"), (3, "Goal Keeper"), (4, "keeper"), (5, "")]
    docs = [(1, f"so {opening} nine ten."), (2, "three four five six seven eight nine ten"), (3, "the goal-keeper stood"), (4, "goal, no keeper"), (5, None), (None, "a goal keeper")]
    p = spark.createDataFrame(passages, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in search.whole_phrases(d, "doc_id", "text", p, "item_id", "text").collect()}
    assert got == {(1, 1), (3, 3), (3, 4), (4, 4), (None, 3), (None, 4)}
    runs = {tuple(r) for r in search.shared_runs(d, "doc_id", "text", p, "item_id", "text", 8).collect()}
    assert runs == {(1, 1, 3), (2, 1, 1), (1, 2, 1)}


def test_shared_runs_are_brought_together_only_where_both_sides_have_them(spark):
    p = spark.createDataFrame([(1, "a b c d"), (1, "b c d e"), (2, "x y z")], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b c d e"), (1, "b c d"), (None, "so x y z x y z"), (3, "no run of it")], "doc_id long, text string")
    got = search.shared_runs(d, "doc_id", "text", p, "item_id", "text", 3)
    assert {tuple(r) for r in got.collect()} == {(1, 1, 3), (None, 2, 1)}
    sides = got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1].splitlines()
    assert not any("Aggregate" in x and ":" in x.split("Aggregate")[0] for x in sides)
