"""Row families: chains followed inside a context, and joins dealt by counted rows."""

from collections import Counter

from ledgerloom.operators import families


def test_auxiliary_chains_follow_links_without_a_join_for_each_step(spark):
    sets = {  # context: (links target -> next, targets of rows)
        1: ([(1, 2), (2, 9)], [9]), 2: ([(1, 2), (2, 1), (3, 4), (4, 9)], [9]), 3: ([(1, 2), (2, 1)], [1]), 4: ([(1, 1), (2, 9)], [9]),
        5: ([(i, i + 1) for i in range(1, 6)] + [(6, 9)], [9, 8]), 6: ([(1, 2), (2, 3), (3, 9)], [9]), 7: ([(1, 2), (2, None)], [9]), 8: ([(i, i + 1) for i in range(1, 8)] + [(8, 9)], [9]), 9: ([(1, 8), (2, 9)], [8, 9]),
    }
    nodes = spark.createDataFrame([(m, 1, 1, t, n, 0) for m, (own, _) in sets.items() for t, n in own] + [(None, 1, 1, 1, 2, 0), (None, 1, 1, 2, 9, 0), (10, 1, 1, 1, 2, 5)], "master long, date int, view int, target long, next long, account long")
    rows = spark.createDataFrame([(m, 1, 1, t, 0, 0) for m, (_, ends) in sets.items() for t in ends] + [(None, 1, 1, 9, 0, 0), (10, 1, 1, 7, 5, 0)], "master long, date int, view int, target long, account long, cents long")
    made = families.auxiliary_chains(nodes, rows)
    assert "transform" in made._jdf.queryExecution().optimizedPlan().toString()  # no checkpoint in between
    chains = {1, 3, 5}
    assert {r.master: r.outcome for r in made.collect()} == {m: "chain" if m in chains else "broken" for m in sets} | {None: "broken", 10: "metadata"}


def test_alias_joins_are_dealt_by_counted_rows(spark, monkeypatch):
    monkeypatch.setattr(families, "DEALT", 4)
    rows = spark.createDataFrame([(p, r, r % 3 > 0) for p in range(4) for r in range(5)] + [(0, 0, True), (None, 1, True)], "page long, record long, is_posting boolean")
    aliases = spark.createDataFrame([(9, 1, 0, 1), (9, 1, 0, 2), (9, 2, 0, 2), (9, 3, 0, 3), (9, 4, 7, 7), (1, 1, 1, 1), (9, 5, 0, 0), (None, 1, 2, 2)], "page long, record long, to_page long, to_record long")
    made = families.alias_violations(aliases, rows)
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
    wanted = [("self_alias", "1:1"), ("source_is_retained", "1:1"), ("duplicate_source", "9:1"), ("duplicate_destination", "0:2"), ("no_posting_there", "9:3"), ("no_posting_there", "9:4"), ("no_posting_there", "9:5")]
    assert Counter(map(tuple, made.collect())) == Counter(wanted)
