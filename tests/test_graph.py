"""Components by contraction: few rounds, whatever the order of ids."""

import random

from posora.operators.graph import components
from posora.operators.relational import connected_components_by_nation
from posora.scratch import Scratch


class Counting(Scratch):
    saved = 0

    def save(self, df):
        self.saved += 1
        return super().save(df)


def test_a_chain_in_the_order_of_its_ids_takes_few_rounds(spark):
    scratch = Counting(spark)
    found = components(spark.range(400).selectExpr("id AS a", "id + 1 AS b"), scratch).collect()
    assert sorted(found) == [(i, 0) for i in range(401)]
    assert scratch.saved < 70  # six a round; with ids in place of hashes it takes about 200 rounds


def test_components_equal_those_of_a_plain_search(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400, 400), (401, 402), (402, None)] + [(500, i) for i in range(501, 530)]
    least = {x: x for e in edges if None not in e for x in e}
    for _ in least:
        for a, b in edges:
            if a is not None and b is not None:
                least[a] = least[b] = min(least[a], least[b])
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len(least) and dict(found) == least


def test_components_by_nation_take_every_supplier(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 8)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (3, 8), (5, 9)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    found = sorted(map(tuple, connected_components_by_nation(spark, str(tmp_path)).collect()))
    assert found == [(1, 1), (2, 2), (1000000001, 1), (1000000002, 1), (1000000003, 2)]
