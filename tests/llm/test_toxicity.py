import random

import numpy as np

from trackloom.llm import toxicity


def test_thresholds_are_ordered_and_severity_follows():
    rng = random.Random(1)
    plain = [f"word{k}" for k in range(200)]
    texts, grades = [], []
    for _ in range(600):
        g = rng.choice((0, 0, 0, 1, 2))
        texts.append(" ".join(rng.choice(plain) for _ in range(30)) + " nasty" * (g > 0) + " vile" * (g > 1))
        grades.append(g)
    doc, bucket = toxicity.features(texts)
    m = toxicity.Model.fit(np.array(grades), doc, bucket)
    assert len(m.thresholds) == 2 and m.thresholds[0] <= m.thresholds[1]
    p = m.predict(["word1 word2", "word1 nasty", "Nasty! and VILE."]).sum(1)
    assert p[0] < 0.3 < p[1] < p[2]


def test_held_out(spark):
    """Fit on one half of the labels, judge the other."""
    sf = "/root/testdata/sf0.01"
    docs, labels = toxicity.documents(spark, sf), toxicity.documents(spark, sf, "labels")
    model = toxicity.fit(toxicity.graded(docs, labels.where("doc_id % 2 = 0")))
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r.id: r for r in toxicity.grade(docs, model).collect() if r.id in truth}
    order = sorted((r.severity, truth[i]) for i, r in got.items())
    n = sum(y for _, y in order)
    auc = (sum(k for k, (_, y) in enumerate(order, 1) if y) - n * (n + 1) / 2) / (n * (len(order) - n))
    assert auc > 0.75, auc
    clean = [r for i, r in got.items() if not truth[i]]
    assert sum(r.toxic for r in clean) <= 0.03 * len(clean)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "bad bad words", 1, 1), (2, None, 0, 1), (3, "", None, 1), (None, "bad", 1, 1), (4, "good", 0, 0), (4, "good", 0, 0)], "doc_id long, text string, grade int, toxic int")
    rows = toxicity.grade(df, toxicity.fit(df)).collect()
    assert len(rows) == 6 and all(0 <= r.severity <= 1 for r in rows)
    none = toxicity.fit(df.limit(0))
    assert {(r.severity, r.grade, r.toxic) for r in toxicity.grade(df, none).collect()} == {(0.0, 0, False)}
    assert toxicity.grade(df.limit(0), none).count() == 0
