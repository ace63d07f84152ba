"""A toxicity model without features."""

import numpy as np

from moraine.llm import toxicity


def test_labels_that_tell_nothing():
    texts = ["a nice day", "b fine word", "c good thing", "d bad day", "e poor word", "f sad thing"]
    even = toxicity.fit([toxicity.features_of(t) for t in texts], np.array([0, 0, 0, 1, 1, 1]))
    assert not even.weights.any() and abs(toxicity.score_text("any", even.weights, even.bias) - 3 / 7) < 1e-9
    most = toxicity.fit([toxicity.features_of(t) for t in texts], np.array([0, 1, 1, 1, 1, 1]))
    assert toxicity.score_text("any", most.weights, most.bias) > 0.5
