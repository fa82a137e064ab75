"""The command line: each command, its formats, cutoffs, columns and errors."""

import csv
import glob
import gzip
import io
import json

import numpy as np
import pytest

from plumbline import cli


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    """Forty respondents with names and a column that is no item."""
    folder, rng = tmp_path_factory.mktemp("cli"), np.random.default_rng(11)
    x = rng.integers(1, 6, (40, 8)).astype(float)
    x[3] = 4  # one straight line
    lines = ["id,note," + ",".join(f"q{k}" for k in range(8))]
    lines += [f"p{i},{i % 3}," + ",".join(f"{v:g}" for v in r) for i, r in enumerate(x)]
    path = folder / "a.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path), x, folder


COLUMNS = ["--id-column", "id", "--item-columns", ",".join(f"q{k}" for k in range(8))]


def run(spark, capsys, *argv):
    code = cli.main(list(argv))
    said = capsys.readouterr()
    return code, said.out, said.err


def test_screen_json_names_sources_of_cutoffs(spark, capsys, data):
    path, x, _ = data
    code, out, _ = run(spark, capsys, "screen", path, *COLUMNS, "--indices", "irv,longstring,onset", "--threshold", "longstring=8", "--index-percentile", "irv=90", "--format", "json")
    made = json.loads(out)
    assert code == 0 and made["cutoff_sources"] == {"irv": "percentile", "longstring": "fixed", "onset": "presence"} and made["percentiles"] == {"irv": 90.0, "longstring": None, "onset": None}
    assert made["cutoffs"]["longstring"] == 8 and made["cutoffs"]["irv"] == pytest.approx(np.percentile(x.std(axis=1), 10))
    assert made["columns"]["respondent_id"] == [f"p{i}" for i in range(40)]
    assert np.allclose(made["columns"]["score__irv"], x.std(axis=1)) and made["columns"]["flag__longstring"] == [i == 3 for i in range(40)]


def test_screen_text_tells_where_cutoffs_come_from(spark, capsys, data):
    code, out, _ = run(spark, capsys, "screen", data[0], *COLUMNS, "--indices", "irv,longstring", "--threshold", "longstring=8", "--min-flags", "1", "--top", "2")
    assert code == 0 and "fixed" in out and "percentile 95" in out and "at least 1 flags" in out and out.count("\n  p") == 2


def test_missing_options_are_soft_errors_unless_strict(spark, capsys, data):
    code, out, err = run(spark, capsys, "screen", data[0], *COLUMNS, "--indices", "irv,mad", "--format", "json")
    assert code == 0 and "mad" in err and "mad" in json.loads(out)["errors"]
    code, _, err = run(spark, capsys, "screen", data[0], *COLUMNS, "--indices", "irv,mad", "--strict")
    assert code == 1 and err.startswith("error: ")


def test_composite_reports_weights_and_components(spark, capsys, data):
    path, x, _ = data
    code, out, _ = run(spark, capsys, "composite", path, *COLUMNS, "--indices", "irv,longstring", "--weight", "irv=2", "--include-components", "--include-probability", "--threshold", "1", "--format", "json")
    made = json.loads(out)
    c = np.array(made["columns"]["composite"])
    z = lambda v: (v - v.mean()) / v.std()
    runs = np.array([max(len(s) for s in "".join("=" if a == b else " " for a, b in zip(r, r[1:], strict=False)).split(" ")) + 1 for r in x], float)
    assert code == 0 and made["weights"] == {"irv": 2.0} and np.allclose(c, (-2 * z(x.std(axis=1)) + z(runs)) / 3)
    assert np.allclose(made["columns"]["probability"], 1 / (1 + np.exp(-c))) and made["columns"]["flag"] == (c >= 1).tolist()
    assert np.allclose(made["columns"]["component__longstring"], z(runs))
    code, out, _ = run(spark, capsys, "composite", path, *COLUMNS, "--indices", "irv", "--standardize", "false", "--format", "csv")
    rows = list(csv.DictReader(io.StringIO(out)))
    assert code == 0 and np.allclose([float(r["composite"]) for r in rows], -x.std(axis=1)) and "component__irv" not in rows[0]


def test_percentile_flags_are_strict(spark, capsys, data):
    _, out, _ = run(spark, capsys, "composite", data[0], *COLUMNS, "--indices", "irv,longstring", "--percentile", "90", "--format", "json")
    made = json.loads(out)
    c = np.array(made["columns"]["composite"])
    assert made["columns"]["flag"] == (c > np.percentile(c, 90)).tolist() and made["percentile"] == 90


@pytest.mark.parametrize("metric", ["mean", "median", "sd", "min", "consistency", "mixture"])
def test_response_times(spark, capsys, data, metric):
    path, x, _ = data
    code, out, _ = run(spark, capsys, "response-time", path, *COLUMNS, "--metric", metric, "--random-seed", "1", "--format", "json")
    made = json.loads(out)
    want = {"mean": x.mean(axis=1), "median": np.median(x, axis=1), "sd": x.std(axis=1), "min": x.min(axis=1), "consistency": x.std(axis=1) / x.mean(axis=1)}
    assert code == 0 and made["flag_direction"] == ("high" if metric == "mixture" else "low") and len(made["columns"]["flag"]) == 40
    if metric in want:
        assert np.allclose(made["columns"]["score"], want[metric])


def test_compressed_input_and_output(spark, capsys, data):
    path, _, folder = data
    with gzip.open(folder / "a.csv.gz", "wt") as f:
        f.write(open(path).read())
    assert cli.main(["screen", str(folder / "a.csv.gz"), *COLUMNS, "--indices", "irv", "--format", "json", "--output", str(folder / "o.json.gz")]) == 0
    assert len(json.loads(gzip.open(folder / "o.json.gz", "rt").read())["columns"]["score__irv"]) == 40
    assert cli.main(["screen", path, *COLUMNS, "--indices", "irv", "--format", "csv", "--output", str(folder / "o.csv.gz")]) == 0
    parts = glob.glob(str(folder / "o.csv.gz" / "*.csv.gz"))
    assert sum(len(gzip.open(p, "rt").read().splitlines()) - 1 for p in parts) == 40


def test_standard_input(spark, capsys, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO('id,a,b\n"x\ny",1,NA\nz,2,3\n'))
    code, out, _ = run(spark, capsys, "screen", "-", "--id-column", "id", "--missing-value", "NA", "--indices", "missing_rate", "--format", "json")
    assert code == 0 and json.loads(out)["columns"]["score__missing_rate"] == [0.5, 0.0] and json.loads(out)["columns"]["respondent_id"] == ["x\ny", "z"]


def test_headers(spark, capsys, tmp_path):
    (tmp_path / "n.csv").write_text("1,2,3\n4,5,6\n7,8,9\n")
    shapes = {}
    for mode in ("auto", "present", "absent"):
        _, out, _ = run(spark, capsys, "screen", str(tmp_path / "n.csv"), "--header", mode, "--indices", "irv", "--format", "json")
        shapes[mode] = len(json.loads(out)["columns"]["ord"])
    assert shapes == {"auto": 3, "present": 2, "absent": 3}
    code, out, _ = run(spark, capsys, "screen", str(tmp_path / "n.csv"), "--header", "present", "--item-columns", "3,1", "--indices", "irv", "--format", "json")
    assert code == 0 and np.allclose(json.loads(out)["columns"]["score__irv"], [1.0, 1.0])
    code, _, err = run(spark, capsys, "screen", str(tmp_path / "n.csv"), "--header", "absent", "--item-columns", "3", "--indices", "irv")
    assert code == 1 and "error" in err


@pytest.mark.parametrize(
    "argv",
    [
        ["--workers", "0"], ["--indices", "nothing"], ["--percentile", "101"], ["--min-flags", "0"], ["--min-valid-indices", "9"], ["--threshold", "irv=nan"], ["--threshold", "mahad=1"],
        ["--threshold", "irv=1", "--index-percentile", "irv=5"], ["--threshold", "irv=1", "--threshold", "irv=2"], ["--delimiter", ",,"], ["--id-column", "none"], ["--item-columns", "q1,q1"],
        ["--item-columns", "id,q1"], ["--missing-value", " "],
    ],
)
def test_invalid_settings_end_with_an_error_line(spark, capsys, data, argv):
    base = [] if "--indices" in argv else ["--indices", "irv,longstring"]
    columns = [] if "column" in argv[0] else COLUMNS
    code, out, err = run(spark, capsys, "screen", data[0], *columns, *base, *argv)
    assert code == 1 and "error: " in err and not out


def test_rows_that_executors_refuse_end_with_an_error_line(spark, capsys, tmp_path):
    for k, text in enumerate(("1,2\n3\n", "1,2\n3,x\n", "a,a\n1,2\n", "")):
        (tmp_path / f"{k}.csv").write_text(text)
        code, _, err = run(spark, capsys, "screen", str(tmp_path / f"{k}.csv"), "--indices", "irv", "--format", "csv")
        assert code == 1 and "error: " in err, text


def test_parsers():
    assert cli.pair_list("0:1,2:3") == [(0, 1), (2, 3)] and cli.named_float("irv=0.5") == ("irv", 0.5)
    for parse, text in ((cli.pair_list, "0:1:2"), (cli.pair_list, "a:b"), (cli.named_float, "irv")):
        with pytest.raises(Exception):
            parse(text)
    with pytest.raises(SystemExit):
        cli.main(["composite", "x", "--threshold", "1", "--percentile", "5"])


def test_indices_in_every_format(spark, capsys):
    code, out, _ = run(spark, capsys, "indices", "--format", "json")
    assert code == 0 and len(json.loads(out)["columns"]["index"]) == 21
    code, out, _ = run(spark, capsys, "indices", "--format", "csv")
    assert code == 0 and len(out.splitlines()) == 22
