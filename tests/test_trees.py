from brookloom.operators import trees


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, parent long, kept boolean, at long")


def test_a_chain_deeper_than_any_recursion_limit(spark):
    n = 3000
    got = {r.id: (r.root, r.depth) for r in trees.rooted(frame(spark, [(i, i - 1 if i else None, False, 0) for i in range(n)])).collect()}
    assert got == {i: (0, i) for i in range(n)}


def test_cycles_orphans_repeats(spark):
    rows = [(1, 2, False, 0), (2, 3, False, 0), (3, 1, False, 0), (4, 3, False, 0), (5, 4, False, 0), (7, 99, False, 0), (8, 7, False, 0), (8, 7, False, 0), (9, 9, False, 0), (None, 1, False, 0)]
    got = {r.id: (r.root, r.depth) for r in trees.rooted(frame(spark, rows)).collect()}
    assert got == {1: (1, 0), 3: (1, 1), 2: (1, 2), 4: (1, 2), 5: (1, 3), 7: (7, 0), 8: (7, 1), 9: (9, 0)}
    assert trees.rooted(frame(spark, rows).limit(0)).count() == 0


def test_kept_and_active(spark):
    rows = [(1, None, True, 0), (2, 1, False, 1), (3, 2, False, 9), (4, 1, True, 2), (5, 4, False, 8), (6, None, False, 3)]
    assert {r.id: r.ancestor for r in trees.kept_ancestors(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: None}
    assert sorted((r.root, r.id, r.depth) for r in trees.active_paths(frame(spark, rows), "at").collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (6, 6, 0)]


def test_staging_scope_cleans_up(spark):
    import pathlib

    from brookloom.session import scratch, staged, staging_scope

    with staging_scope(spark):
        df = staged(spark.range(5), "scope")
        assert df.count() == 5
        at = pathlib.Path(df.staged_at.removeprefix("file://"))
        assert at.exists() and str(at).startswith(scratch(spark).removeprefix("file://"))
    assert not at.exists()
