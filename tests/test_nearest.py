"""Nearest neighbours of many questions against plain Python."""

import math
import random

from sedimenta import catalog
from sedimenta.operators.retrieval import nearest_each


def test_every_question_has_its_neighbours(spark):
    r = random.Random(2)
    vectors = {i: [float(r.randint(-3, 3)) for _ in range(4)] for i in range(120)}
    vectors[7], vectors[9] = [0.0] * 4, vectors[50]
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(3)
    q = df.filter("vec_id % 50 = 0").selectExpr("vec_id AS qid", "embedding AS q")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = set()
    for i in (0, 50, 100):
        far = [(1 - dot(v, vectors[i]) / (math.sqrt(dot(v, v)) * math.sqrt(dot(vectors[i], vectors[i]))), j) for j, v in vectors.items() if j != i and any(v)]
        want |= {(i, j, n) for n, (_, j) in enumerate(sorted(far)[:10], 1)}
    assert all(any(vectors[i]) for i in (0, 50, 100))
    for block in (16, 2048):
        assert {(x.qid, x.vec_id, x.rank) for x in nearest_each(q, df, 10, block=block).collect()} == want


def test_all_questions_of_the_table_take_part(spark):
    got = catalog.QUERIES["r02_vector_knn_all"](spark, "/root/testdata/sf0.001").groupBy("qid").count().collect()
    assert {(x.qid, x["count"]) for x in got} == {(i, 50) for i in range(0, 500, 50)}


def test_a_pair_takes_one_product(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<float>").localCheckpoint()
    q = spark.createDataFrame([(0, [1.0, 2.0])], "qid long, q array<double>").localCheckpoint()
    plan = nearest_each(q, df, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert [line.count("aggregate(") for line in plan.splitlines() if "explode(" in line] == [1]
