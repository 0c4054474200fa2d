"""Long secrets are masked; a bounded sample keeps the classes' shares."""

import numpy as np

from lightfold.llm import pii, toxicity


def test_long_secrets_are_found():
    secret = "aB3dE5fG7hJ9kL1mN2pQ" * 10
    text = f"bearer {secret} end"
    assert pii.extra_spans(text, []) == [("secret", 7, 207)]


def test_prior_does_not_depend_on_the_sample(spark):
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(4000)], "doc_id long, toxic int")
    n = {r["toxic"]: r["count"] for r in toxicity.training_labels(labels).groupBy("toxic").count().collect()}
    assert toxicity.stand_for(labels) == (1.0, 1.0)
    each = toxicity.stand_for(labels, 100)
    assert each == (n[0] / 100, n[1] / 100)
    r = np.random.default_rng(5)

    def some(n0, n1):
        y = np.array([0.0] * n0 + [1.0] * n1)
        return [np.flatnonzero(r.random(40) < np.where(np.arange(40) < 20, 0.3 + 0.05 * c, 0.3)) for c in y], y

    whole = toxicity.fit(*some(3200, 400))
    even = toxicity.fit(*some(400, 400), (8.0, 1.0))
    plain = toxicity.fit(*some(400, 400))
    mean = lambda m: np.mean([m.score(set(x)) for x in some(800, 100)[0]])
    assert abs(mean(even) - mean(whole)) < 0.08 < mean(plain) - mean(whole)
