"""Command line: python -m plumbline.cli screen | composite | response-time | indices."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import ResponseFrame
from .functions.exprs import logistic
from .operators import flags, timing
from .operators.indices import summary
from .plans import composite as C
from .plans import registry as R
from .plans import screen as S
from .sources import files, sinks


def _list(kind: Callable) -> Callable[[str], list]:
    def parse(text: str) -> list:
        try:
            return [kind(x.strip()) for x in text.split(",")]
        except ValueError as e:
            raise argparse.ArgumentTypeError(str(e)) from e

    parse.__name__ = f"list of {kind.__name__}"
    return parse


def pair_list(text: str) -> list[tuple[int, int]]:
    """0:1,2:3"""
    try:
        pairs = [tuple(int(y) for y in x.split(":")) for x in text.split(",")]
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e
    if any(len(p) != 2 for p in pairs):
        raise argparse.ArgumentTypeError("pairs are written as a:b")
    return pairs


def named_float(text: str) -> tuple[str, float]:
    name, equal, value = text.partition("=")
    try:
        return name.strip(), float(value)
    except ValueError as e:
        raise argparse.ArgumentTypeError("expected INDEX=VALUE") from e


def _named(given: Sequence[tuple[str, float]] | None) -> dict[str, float] | None:
    out = dict(given or ())
    if len(out) != len(given or ()):
        raise ValueError("an index was given twice")
    return out or None


def _yes(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("expected true or false")
    return text.lower() == "true"


OPTIONS = {
    "na-rm": _yes, "psychsyn-critval": float, "psychant-critval": float, "evenodd-factors": _list(int), "mad-positive-items": _list(int), "mad-negative-items": _list(int),
    "mad-scale-min": float, "mad-scale-max": float, "scale-min": float, "scale-max": float, "acquiescence-positive-items": _list(int), "acquiescence-negative-items": _list(int),
    "longstring-max-pattern-length": int, "midpoint-tolerance": float, "guttman-normalize": _yes, "onset-window-size": int, "onset-min-items": int, "reliability-n-splits": int,
    "reliability-random-seed": int, "semantic-item-pairs": pair_list, "infrequency-item-indices": _list(int), "infrequency-expected-responses": _list(float),
    "infrequency-proportion": _yes, "missing-item-indices": _list(int),
}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline", description="Survey response quality on Spark")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str, data: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help_)
        p.add_argument("--format", choices=("text", "json", "csv", "npz", "parquet") if data else ("text", "json", "csv"), default="text")
        p.add_argument("--output")
        if data:
            p.add_argument("data", help="a table, or - for delimited text from standard input")
            p.add_argument("--delimiter")
            p.add_argument("--header", choices=files.HEADERS, default="auto")
            p.add_argument("--id-column")
            p.add_argument("--item-columns", type=_list(str))
            p.add_argument("--missing-value", action="append")
            p.add_argument("--top", type=int, default=10)
        return p

    for name, help_ in (("screen", "flags of several indices and their consensus"), ("composite", "one score of several indices")):
        p = add(name, help_)
        p.add_argument("--indices", type=_list(str))
        p.add_argument("--min-valid-indices", type=int)
        p.add_argument("--strict", action="store_true")
        p.add_argument("--workers", type=int, default=1)
        p.add_argument("--infrequency-missing", choices=("pass", "fail", "omit", "propagate"))
        for o, kind in OPTIONS.items():
            p.add_argument("--" + o, type=kind)
        if name == "screen":
            p.add_argument("--percentile", type=float, default=95.0)
            p.add_argument("--min-flags", type=int, default=2)
            p.add_argument("--threshold", type=named_float, action="append")
            p.add_argument("--index-percentile", type=named_float, action="append")
        else:
            p.add_argument("--method", choices=C.METHODS, default="mean")
            p.add_argument("--standardize", type=_yes, default=True)
            p.add_argument("--weight", type=named_float, action="append")
            p.add_argument("--include-components", action="store_true")
            p.add_argument("--include-probability", action="store_true")
            cut = p.add_mutually_exclusive_group()
            cut.add_argument("--threshold", type=float)
            cut.add_argument("--percentile", type=float)
    p = add("response-time", "response-time scores and flags")
    p.add_argument("--metric", choices=("mean", "median", "sd", "min", "consistency", "mixture"), default="median")
    p.add_argument("--log-transform", type=_yes, default=True)
    p.add_argument("--components", type=int, default=2)
    p.add_argument("--random-seed", type=int)
    cut = p.add_mutually_exclusive_group()
    cut.add_argument("--threshold", type=float)
    cut.add_argument("--percentile", type=float)
    add("indices", "the registered indices", data=False)
    return top


def _options(args: argparse.Namespace) -> R.IndexOptions:
    names = [o.replace("-", "_") for o in OPTIONS] + ["infrequency_missing"]
    return R.IndexOptions(**{n: getattr(args, n) for n in names if getattr(args, n) is not None})


def _frame(spark: SparkSession, args: argparse.Namespace) -> ResponseFrame:
    text = {} if args.data.endswith((".npy", ".parquet", ".orc", ".json")) else {"delimiter": args.delimiter, "header": args.header, "missing_tokens": args.missing_value}
    return files.read_frame(spark, args.data, args.id_column, args.item_columns, **text)


def _emit(args: argparse.Namespace, table: DataFrame, metadata: dict, report: Callable[[], list[str]]) -> None:
    if args.format in ("npz", "parquet") and not args.output:
        raise ValueError(f"{args.format} needs --output")
    if args.format == "parquet":
        table.write.mode("overwrite").parquet(args.output)
    elif args.format == "npz":
        sinks.write_npz(table, args.output, metadata)
    elif args.format == "csv" and args.output:
        sinks.write_csv(table, args.output)
    elif args.format == "json" and args.output:
        sinks.write_json(table, args.output, metadata)
    elif args.format == "json":
        sys.stdout.writelines(sinks.json_pieces(table, metadata))
    elif args.format == "csv":
        rows = sinks.plain(table)
        print(",".join(rows.columns))
        for r in (rows.orderBy("ord") if "ord" in rows.columns else rows).toLocalIterator():
            print(",".join("" if v is None else str(v) for v in r))
    else:
        text = "\n".join(report()) + "\n"
        if args.output:
            with sinks.text_file(args.output) as f:
                f.write(text)
        else:
            sys.stdout.write(text)


def _number(x) -> str:
    return "-" if x is None else f"{x:.4f}"


def _screen(spark: SparkSession, args: argparse.Namespace) -> None:
    found = S.screen(
        _frame(spark, args), args.indices, options=_options(args), percentile=args.percentile, min_flags=args.min_flags, min_valid_indices=args.min_valid_indices,
        thresholds=_named(args.threshold), percentiles=_named(args.index_percentile), strict=args.strict, workers=args.workers,
    )
    _soft(found.errors)

    def report() -> list[str]:
        lines = [f"{'index':24}{'cutoff':>12}  {'from':16}{'mean':>12}{'std':>12}{'flagged':>10}{'of':>8}"]
        for r in found.summary.collect():
            k = r["index"]
            source, p = found.settings["cutoff_sources"][k], found.settings["percentiles"][k]
            lines.append(f"{k:24}{_number(found.cutoffs[k]):>12}  {source if p is None else f'percentile {p:g}':16}{_number(r['mean']):>12}{_number(r['std']):>12}{r['n_flagged']:>10}{r['n_valid']:>8}")
        lines.append(f"respondents with at least {args.min_flags} flags: {found.table.filter('consensus_flag').count()}")
        return lines + [f"  {r['respondent_id']}: {r['flag_count']} of {r['valid_index_count']}" for r in sinks.top(found.table, "flag_count", args.top)]

    _emit(args, found.table, {**found.settings, "cutoffs": found.cutoffs, "errors": found.errors}, report)
    found.release()


def _composite(spark: SparkSession, args: argparse.Namespace) -> None:
    found = C.composite(
        _frame(spark, args), args.indices, args.method, args.standardize, options=_options(args), weights=_named(args.weight),
        min_valid_indices=args.min_valid_indices, strict=args.strict, workers=args.workers,
    )
    _soft(found.errors)
    table = found.table
    if args.include_probability:
        if not args.standardize:
            raise ValueError("a probability needs standardised scores")
        table = table.withColumn("probability", logistic(F.col("composite")))
    if args.threshold is not None or args.percentile is not None:
        table = flags.flag_scores(table, "composite", args.threshold, args.percentile, "high")
    kept = [c for c in table.columns if args.include_components or not c.startswith(("score__", "component__"))]
    table = table.select(*kept)

    def report() -> list[str]:
        s = summary(table, "composite").first()
        lines = [f"indices: {', '.join(found.names)}", f"respondents: {s['n_valid']} of {s['n_total']}; mean {_number(s['mean'])}, std {_number(s['std'])}"]
        return lines + [f"  {r['respondent_id']}: {_number(r['composite'])}" for r in sinks.top(table, "composite", args.top)]

    _emit(args, table, {
        "method": args.method, "indices": found.names, "standardize": args.standardize, "weights": _named(args.weight) or {}, "min_valid_indices": args.min_valid_indices,
        "threshold": args.threshold, "percentile": args.percentile, "errors": found.errors,
    }, report)
    found.release()


def _response_time(spark: SparkSession, args: argparse.Namespace) -> None:
    frame = _frame(spark, args)
    if args.metric == "mixture":
        scores, direction = timing.response_time_mixture(frame, args.components, args.log_transform, args.random_seed), "high"
    else:
        c = timing.response_time_consistency(frame) if args.metric == "consistency" else timing.response_time(frame, args.metric)
        scores, direction = frame.with_scores(score=c), "low"
    table = timing.response_time_score_flags(scores, args.threshold, args.percentile, direction)

    def report() -> list[str]:
        s = summary(table).first()
        return [f"{args.metric}: mean {_number(s['mean'])}, median {_number(s['median'])}; {table.filter('flag').count()} of {s['n_valid']} flagged"]

    _emit(args, table, {"metric": args.metric, "flag_direction": direction}, report)


def _indices(spark: SparkSession, args: argparse.Namespace) -> None:
    table = R.index_catalog(spark)
    rows = R.index_catalog()
    flat = table.withColumn("required_options", F.array_join("required_options", " "))
    _emit(args, flat, {}, lambda: [f"{k:24}{v['direction']:6}{'screen ' if v['screen_default'] else ''}{'composite' if v['composite_default'] else ''}" for k, v in rows.items()])


def _soft(errors: dict[str, str]) -> None:
    for k, v in errors.items():
        print(f"{k} wasn't scored: {v}", file=sys.stderr)


def main(argv: Sequence[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").config("spark.ui.enabled", "false").getOrCreate()
    run = {"screen": _screen, "composite": _composite, "response-time": _response_time, "indices": _indices}[args.command]
    try:
        run(spark, args)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except (PySparkException, Py4JJavaError) as e:  # a cell or a row that an executor refuses
        said = str(e.java_exception.getMessage()) if isinstance(e, Py4JJavaError) else str(e)
        print("error: " + next((x for x in said.splitlines() if x.strip()), "the job failed"), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
