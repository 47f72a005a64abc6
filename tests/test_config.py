import pytest

from citeweave import cli
from citeweave.plans import config


def test_presets_fill_defaults_only():
    assert config.with_preset(config.Generation(rows=7), "dev") == config.Generation(7, 50, 2)
    assert config.with_preset(config.Generation(), "smoke") == config.PRESETS["smoke"]
    assert config.with_preset(config.Generation(rows=3), None) == config.Generation(3)


def test_validation():
    for bad in ({"mode": "avg"}, {"direction": "up"}, {"seed_k": 0}, {"weight": -1}, {"cap": -1}):
        with pytest.raises(ValueError):
            config.Expansion(**bad)
    with pytest.raises(ValueError):
        config.Sampling(mode="all")


def test_files(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("retrieval:\n  top_k: 5\n  cutoffs: [1, 3]\nfinal_basis: answer_valid\nsplit: {train: 0.5}\n")
    found = config.load(str(path))
    assert (found.retrieval.top_k, found.retrieval.cutoffs, found.retrieval.rrf_k, found.split.train, found.split.dev, found.final_basis) == (5, (1, 3), 60, 0.5, 0.15, "answer_valid")
    for bad in ({"nothing": {}}, {"retrieval": {"topk": 3}}, {"final_basis": "all"}, {"split": {"train": 0.9, "dev": 0.2}}):
        with pytest.raises(ValueError):
            config.from_dict(bad)
    assert config.from_dict({}) == config.Config()
    assert config.corpus_of({"adapter": {"corpus": "a"}, "corpus": "b"}) == "a" and config.corpus_of({"corpus": "b"}, ("b",)) == "b"
    with pytest.raises(ValueError):
        config.corpus_of({"corpus": "c"}, ("b",))


def test_command_line(capsys):
    assert cli.main(["list"]) == 0 and "ir_votes" in capsys.readouterr().out
    assert cli.main(["sql", "ir_votes"]) == 0 and "WITH" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "--tables", "x", "--out", "y"]) == 2
