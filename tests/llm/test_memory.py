"""What the driver holds while it fits a model."""

import tracemalloc

import numpy as np

from tessera.llm.langid import BINS, LanguageModel, train_ftrl


def test_training_on_languages_makes_one_vector_at_a_time():
    draw = np.random.default_rng(5)
    rows = [(np.sort(draw.choice(BINS, 20_000, replace=False)).astype("<u2"), draw.integers(1, 9, 20_000).astype("<u4"), i % 2) for i in range(60)]
    model = LanguageModel(["a", "b"], np.ones(BINS, np.float32))
    tracemalloc.start()
    train_ftrl(model, rows, epochs=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12_000_000  # all 60 vectors are 19 MB
    assert np.isfinite(model.weights).all() and model.weights.any()
