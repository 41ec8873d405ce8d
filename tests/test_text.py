import math

from assaya.operators import text


def test_pairs_and_trigrams_are_counted_within_the_row(spark):
    docs = spark.createDataFrame([(1, "a b A b c"), (2, "one"), (3, ""), (4, "x y z x y z")], "doc_id long, text string")
    found = text.perplexity(docs)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    logs = 2 * math.log(3 / 5) + math.log(2 / 5) + math.log(2 / 5)  # a b twice, b a, b c, over three words
    other = 2 * math.log(3 / 5) + 2 * math.log(3 / 5) + math.log(2 / 4)  # x y and y z twice, z x
    assert {r.doc_id: r.perplexity for r in found.collect()} == {1: round(math.exp(-logs / 4), 6), 2: None, 3: None, 4: round(math.exp(-other / 5), 6)}
    found = text.trigrams(docs)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    assert sorted(map(tuple, found.collect())) == [(1, 3, 0), (2, 0, 0), (3, 0, 0), (4, 4, 2)]
