import json

import pytest

from lexiloom.__main__ import main

GOOD = {"phoneme": "a", "language": "zh", "surface_tone": 1, "labels": {"viseme_id": 1, "strength": 5.0}}


def test_validate(spark, tmp_path, capsys):
    f = tmp_path / "x.jsonl"
    f.write_text(json.dumps({"tokens": [GOOD]}) + "\n")
    assert main(["validate", str(f), "--report", str(tmp_path / "r.json")]) == 0 and json.loads((tmp_path / "r.json").read_text())["records"] == 1
    f.write_text(json.dumps({"tokens": [GOOD]}) + "\n{\n")
    assert main(["validate", str(f)]) == 1 and json.loads(capsys.readouterr().out.splitlines()[-1])["violations"] == {"unreadable": 1}


def test_gate(spark, tmp_path):
    (tmp_path / "training_summary.json").write_text(json.dumps({"global_step": 3, "saw_non_finite_loss": False, "final_train_loss": 0.1, "final_train_viseme_accuracy": 0.99, "final_train_strength_mae": 1.0, "validation": {"val_viseme_accuracy": 0.99, "val_strength_mae": 2.0}}))
    assert main(["gate", str(tmp_path)]) == 0 and main(["gate", str(tmp_path), "--max-mae", "1.5"]) == 1
    assert main(["gate", str(tmp_path), "--checkpoints", str(tmp_path / "none")]) == 1
    assert main(["gate", str(tmp_path / "missing")]) == 2


def test_split(spark, tmp_path):
    toks = [(f"s{i:02d}", k, p) for i in range(40) for k, p in enumerate(f"{i // 2:05b}" * 3)]
    spark.createDataFrame(toks, "sample_id string, token_index long, phoneme string").write.parquet(str(tmp_path / "all.tokens.parquet"))
    spark.createDataFrame([(f"s{i:02d}", None) for i in range(40)], "sample_id string, text string").write.parquet(str(tmp_path / "all.samples.parquet"))
    assert main(["split", str(tmp_path / "all.tokens.parquet"), str(tmp_path / "out"), "--ratios", "0.8", "0.1", "0.1"]) == 0
    parts = [{r.sample_id for r in spark.read.parquet(str(tmp_path / f"out/{n}.samples.parquet")).collect()} for n in ("train", "validation", "test")]
    assert sum(map(len, parts)) == 40
    assert all((f"s{i:02d}" in p) == (f"s{i + 1:02d}" in p) for p in parts for i in range(0, 40, 2))
    with pytest.raises(SystemExit):
        main(["nothing"])
