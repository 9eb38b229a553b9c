"""Steps of the text parser and the bridge that run once."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import textcodec as X
from tessera.sources import wire


def test_bridge_runs_each_step_once(spark, tmp_path):
    texts = ['{"k":1,"l":[1.5,null,true]}', "{", None, '{"k":1,"l":[1.5,null,true]}', '{"t":"a b"}']
    given = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    found = {r.id: tuple(r.b) for r in given.select("id", wire.bridged("j").alias("b")).collect()}
    assert found == {0: (True, True), 1: (None, None), 2: (None, None), 3: (True, True), 4: (True, True)}
    from tessera.plans.catalogue import queries

    spark.createDataFrame([(1, '{"k": 7}', "view")], "event_id long, props string, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    plan = queries()["value_bridge"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_encoded") == 0 and "RoundRobinPartitioning" in plan


def test_a_token_is_matched_once(monkeypatch):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.n = pattern, 0

        def match(self, *a):
            self.n += 1
            return self.pattern.match(*a)

    counted = Counted(X._PATTERNS[True])
    monkeypatch.setitem(X._PATTERNS, True, counted)
    assert X.parse("{a=1 b=[x y]}", loose=True) == {"a": 1, "b": ["x", "y"]} and counted.n == 11


@pytest.mark.parametrize("text", ["@pool.str id=S1 [a b]\n{x=^S1:1}", "@pool.str id=S1 [a\nb]\n{x=^S1:1}", "@pool.str id=S1 [a b] // two\n{x=^S1:1}"])
def test_pools_on_one_line_or_more(text):
    for _ in range(2):
        assert X.parse_document(text) == {"x": "b"}


def test_packed_and_pooled_inputs_are_spread(spark):
    from tessera.session import spread

    assert spread(spark.range(1)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert spread(spark.range(10)).agg(F.sum("id")).first()[0] == 45
