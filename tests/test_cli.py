from weir.__main__ import main


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    f = tmp_path / "a.json"
    f.write_text('{"a":1,"s":"x"}\n{"a":2,"s":"y"}\n')
    assert main(["where a>1 | cut s", str(f)]) == 0
    assert capsys.readouterr().out.strip() == '{s:"y"}'
    assert main(["--any", "yield typeof(this)", str(f)]) == 0
    assert capsys.readouterr().out.split() == ["<{a:int64,s:string}>"] * 2
    assert main(["-f", "json", "-o", str(tmp_path / "out"), "count() by s", str(f)]) == 0
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert main(["where (", str(f)]) == 1
