"""A mix of more sources than are broadcast, one of which holds a third of the rows."""

from corpuslens.llm import common, mixing


def test_hot_sources_are_split_and_give_the_same_mix(spark, monkeypatch):
    rows = [(i, ("hot" if i % 3 == 0 else f"s{i % 40}" if i % 7 else None if i % 2 else ""), "word " * (5 + i % 30)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    order = ["doc_id", "source", "size", "source_size", "target", "taken"]
    want = sorted(map(str, mixing.taken_words(mixing.mix(df, block_words=16)).select(order).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    monkeypatch.setattr(common, "HOT_KEY_ROWS", 100)
    split = mixing.taken_words(mixing.mix(df, block_words=16)).select(order)
    assert sorted(map(str, split.collect())) == want and len(want) == 900
    assert {r.source for r in split.collect()} >= {None, "", "hot"}
