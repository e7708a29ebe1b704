import json

import pytest
from model_fixture import REPORT, TMDL

from weftline import __main__ as cli
from weftline.plans import config
from weftline.sources import dispatch


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("w")
    for name, text in TMDL.items():
        p = root / "M.SemanticModel/definition" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    for name, value in REPORT.items():
        p = root / "R.Report" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps(value))
    (root / "M.SemanticModel/.platform").write_text(json.dumps({"metadata": {"displayName": "Shown"}}))
    (root / "M.SemanticModel/.pbi").mkdir()
    (root / "M.SemanticModel/.pbi/cache.abf").write_bytes(b"x")
    (root / "notes.txt").write_text("not read")
    return root


def test_scan_search_and_deps_from_a_folder(spark, folder, capsys, monkeypatch):
    held = cli.load(spark, f"file:{folder}")
    monkeypatch.setattr(cli, "load", lambda *_: held)  # one analysis for all commands
    assert cli.main(["scan", str(folder)], spark) == 1
    out = capsys.readouterr().out.splitlines()
    assert "'Shop'[Dead]" in out and "broken: 'Shop'[Missing]" in out and "'Shop'[Total]" not in out
    assert cli.main(["search", str(folder), "Dead Too"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["id"] == "'Shop'[Dead]"
    assert cli.main(["deps", str(folder), "Totla"], spark) == 1
    assert "did you mean" in capsys.readouterr().err


def test_dispatch(spark, folder):
    facts = dispatch.model_facts(spark, f"file:{folder}")
    assert facts.where("kind = 'table'").count() == 4 and facts.select("model").distinct().count() == 1
    assert [r.display_name for r in dispatch.named_models(spark, facts).collect()] == ["Shown"]
    assert dispatch.report_facts(spark, f"file:{folder}").where("kind = 'visual'").count() == 1
    assert dispatch.cached_backups(spark, facts).first().model == facts.first().model


def test_settings(tmp_path):
    inner = tmp_path / "a/b"
    inner.mkdir(parents=True)
    assert config.load(inner).path is None
    (tmp_path / config.FILE).write_text('[scan]\nignore = ["*x*"]\n[apps]\nsales = "M"\n')
    s = config.load(inner)
    assert s.ignore == ["*x*"] and s.apps == {"sales": "M"} and s.path.parent == tmp_path
    (tmp_path / config.FILE).write_text("[scan]\nignored = []\n")
    with pytest.raises(ValueError, match="knows no ignored"):
        config.load(inner)
