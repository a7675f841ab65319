"""The registered runs are whole ones."""

from trustfold import constants as C
from trustfold.checks import queries


def _settings_of(monkeypatch, spark, sf_dir, name):
    seen = []
    monkeypatch.setattr(queries.runs, name, lambda train, test, settings, **_: seen.append(settings))
    queries.QUERIES[name](spark, sf_dir)
    return seen[0]


def test_the_fit_runs_all_rounds(monkeypatch, spark, sf_dir):
    settings = _settings_of(monkeypatch, spark, sf_dir, "federated_fit")
    assert (settings.rounds, settings.trainer, settings.subset_rows) == (C.ROUNDS, "minibatch", C.SUBSET_ROWS)


def test_the_grid_runs_all_rounds(monkeypatch, spark, sf_dir):
    settings = _settings_of(monkeypatch, spark, sf_dir, "experiment_grid")
    assert (settings.rounds, settings.trainer, settings.subset_rows) == (C.ROUNDS, "minibatch", C.SUBSET_ROWS)
