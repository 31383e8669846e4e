from corpusflow.plans import fixtures as fx


def test_roots_are_those_of_the_tree(spark, sf, monkeypatch):
    stored = fx.tree(spark, sf).where("chunk_level = 1")
    roots = fx.roots(spark, sf)
    assert roots.columns == stored.columns and roots.count() == stored.count() > 0
    assert roots.exceptAll(stored).isEmpty()
