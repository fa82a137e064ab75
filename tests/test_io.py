"""Sources, sinks, archives, the command line, response times."""

import gzip
import json

import numpy as np
import pytest

from plumbline import cli
from plumbline.operators import timing
from plumbline.plans import screen as S
from plumbline.sources import archive, files, sinks


def rows(f):
    return [r["responses"] for r in f.df.orderBy("ord").collect()]


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,q1,q2\nx,1,NA\ny,,2.5\n")
    f = files.read_delimited(spark, str(p), id_column="id", missing_tokens=["NA"])
    assert f.item_names == ("q1", "q2") and rows(f) == [[1.0, None], [None, 2.5]]
    assert [r[0] for r in f.df.orderBy("ord").select("respondent_id").collect()] == ["x", "y"]
    assert rows(files.read_delimited(spark, str(p), id_column="id", item_columns=["q2"], missing_tokens=["NA"])) == [[None], [2.5]]
    g = tmp_path / "b.txt.gz"
    with gzip.open(g, "wt") as out:
        out.write("1 2\n3 4\n")
    assert rows(files.read_delimited(spark, str(g))) == [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "c.csv").write_text("1;2\n3;4\n")
    assert rows(files.read_delimited(spark, str(tmp_path / "c.csv"))) == [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "d.csv").write_text("1,2\n3\n")
    with pytest.raises(Exception):
        rows(files.read_delimited(spark, str(tmp_path / "d.csv")))
    (tmp_path / "e.csv").write_text("id,q\na,1\na,2\n")
    with pytest.raises(ValueError):
        files.read_delimited(spark, str(tmp_path / "e.csv"), id_column="id")
    with pytest.raises(ValueError):
        files.check_missing_tokens(["NA", "NA"])


def test_npy_and_parquet(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1, 2], [3, 4]]))
    assert rows(files.read_frame(spark, str(tmp_path / "a.npy"))) == [[1.0, 2.0], [3.0, 4.0]]
    np.save(tmp_path / "b.npy", np.array([1.0]))
    with pytest.raises(ValueError):
        files.read_npy(spark, str(tmp_path / "b.npy"))
    spark.createDataFrame([("a", 1.0, float("nan"))], "id string, q1 double, q2 double").write.parquet(str(tmp_path / "c.parquet"))
    f = files.read_frame(spark, str(tmp_path / "c.parquet"), id_column="id")
    assert rows(f) == [[1.0, None]]


def test_archives(spark, frame, tmp_path):
    f = frame([[1, 2, 3], [2, 2, 2], [5, 1, 5]], ids=["a", "b", "c"])
    r = S.screen(f, ["irv", "longstring"])
    path = str(tmp_path / "scores")
    for _ in range(2):  # the second replaces the first
        archive.save_score_archive(r.table, path, errors={"mahad": "too few rows"})
    back = archive.load_score_archive(spark, path)
    assert back.names == ["irv", "longstring"] and back.errors == {"mahad": "too few rows"} and back.table.count() == 3
    assert S.screen_scores(back.table).table.count() == 3
    with pytest.raises(ValueError):
        archive.save_score_archive(r.table, path, "other")
    with pytest.raises(ValueError):
        archive.save_score_archive(r.table.union(r.table), path)
    with pytest.raises(ValueError):
        archive.load_response_time_archive(spark, path)
    times = timing.response_time_score_flags(f.with_scores(score=timing.response_time(f, "mean")), threshold=2.0)
    archive.save_response_time_archive(times, str(tmp_path / "times"), "mean", 2.0)
    assert archive.load_response_time_archive(spark, str(tmp_path / "times")).metadata["threshold"] == 2.0
    with pytest.raises(ValueError):
        archive.save_response_time_archive(times, path, "mixture", 2.0)
    with pytest.raises(ValueError):
        archive.save_response_time_archive(times, path, "mean", 4.0)


def test_json_is_strict(spark):
    df = spark.createDataFrame([(0, float("nan"), True), (1, 2.0, False)], "ord bigint, x double, b boolean")
    assert json.loads("".join(sinks.json_pieces(df, {"a": float("inf")}))) == {"a": None, "columns": {"ord": [0, 1], "x": [None, 2.0], "b": [True, False]}}


def test_command_line(spark, tmp_path, capsys):
    p = tmp_path / "a.csv"
    rng = np.random.default_rng(1)
    p.write_text("\n".join(",".join(map(str, r)) for r in rng.integers(1, 6, (40, 6))))
    assert cli.main(["screen", str(p), "--indices", "irv,longstring,evenodd", "--format", "json", "--output", str(tmp_path / "o.json")]) == 0
    made = json.loads((tmp_path / "o.json").read_text())
    assert len(made["columns"]["flag_count"]) == 40 and "evenodd" in made["errors"]
    assert "evenodd" in capsys.readouterr().err
    assert cli.main(["screen", str(p), "--threshold", "irv=0.5"]) == 0 and "irv" in capsys.readouterr().out
    assert cli.main(["composite", str(p), "--indices", "irv,longstring", "--include-probability", "--percentile", "90", "--format", "csv"]) == 0
    assert capsys.readouterr().out.splitlines()[0].endswith("composite,probability,flag")
    assert cli.main(["response-time", str(p), "--metric", "mean", "--format", "npz", "--output", str(tmp_path / "o.npz")]) == 0
    assert len(np.load(tmp_path / "o.npz")["score"]) == 40
    assert cli.main(["indices"]) == 0 and "guttman" in capsys.readouterr().out
    assert cli.main(["screen", str(p), "--format", "npz"]) == 1
    assert cli.main(["screen", str(p), "--indices", "nothing"]) == 1


def test_mixture(spark, frame):
    rng = np.random.default_rng(5)
    x = np.exp(np.concatenate([rng.normal(0, 0.2, 60), rng.normal(2, 0.2, 60)]))
    f = frame(np.stack([x, x, x], axis=1))
    got = [r["score"] for r in timing.response_time_mixture(f, random_seed=3).orderBy("ord").collect()]
    assert min(got[:60]) > 0.9 and max(got[60:]) < 0.1
    with pytest.raises(ValueError):
        timing.response_time_mixture(frame([[1.0, 1.0]]), 2)


def test_plots_say_what_they_need(frame):
    from plumbline import plots

    r = S.screen(frame([[1, 2, 3], [2, 2, 2]]), ["irv"])
    assert sum(x["n"] for x in plots.histogram(r.table, "score__irv").collect()) == 2
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            plots.plot_flag_counts(r)


def test_quotes_and_header_by_place(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,q1,q2\n"Doe, J",1,2\n"O""Brien",3,"4"\n')
    f = files.read_delimited(spark, str(tmp_path / "a.csv"), id_column="id")
    assert rows(f) == [[1.0, 2.0], [3.0, 4.0]]
    assert [r[0] for r in f.df.orderBy("ord").select("respondent_id").collect()] == ["Doe, J", 'O"Brien']
    (tmp_path / "b.csv").write_text("1,2\n3,4\n1,2\n")  # said to be a header: one row of that text goes, not both
    assert rows(files.read_delimited(spark, str(tmp_path / "b.csv"), header="present")) == [[3.0, 4.0], [1.0, 2.0]]
    (tmp_path / "c").mkdir()
    for k in range(2):
        (tmp_path / "c" / f"{k}.csv").write_text(f"x|y\n{k}|2\n")
    assert sorted(rows(files.read_delimited(spark, str(tmp_path / "c"), delimiter="|"))) == [[0.0, 2.0], [1.0, 2.0]]


def test_archive_replacement_keeps_the_mode_and_the_old_one_on_failure(spark, frame, tmp_path):
    import os

    f = frame([[1, 2, 3], [2, 2, 2]], ids=["a", "b"])
    r, path = S.screen(f, ["irv"]), str(tmp_path / "scores")
    archive.save_score_archive(r.table, path)
    os.chmod(path, 0o750)
    archive.save_score_archive(r.table, path)
    assert os.stat(path).st_mode & 0o777 == 0o750
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["scores"]
