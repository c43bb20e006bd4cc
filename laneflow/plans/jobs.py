"""Jobs to submit: section table, training sweep, replay, and the two real-time jobs.

    spark-submit --py-files laneflow.zip run_job.py sections --raw s3a://.../trajectories --out ...

``fit`` saves the parameters of the site, windows and samples with the weights; the real-time jobs
take theirs from the model, and fail where a flag says otherwise.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from laneflow.config import EXPERIMENTS, SampleConfig, SiteConfig, WindowConfig
from laneflow.operators import aggregate, clean, descent, grid, regression, series
from laneflow.plans import training
from laneflow.session import cluster_conf, fresh_path, materialize, pin, release
from laneflow.sources import files, increments, topics
from laneflow.streaming import realtime
from laneflow.streaming.late import LateRows
from laneflow.streaming.publish import OrderedPublisher, Slices


#: Speeds as decimals: sums are exact, so means don't depend on the order of the rows.
EXACT = "decimal(18,6)"


def exact(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(EXACT) for c in columns})


def site_points(
    raw: DataFrame, site: SiteConfig, hours: Sequence[int], in_mph: bool = False
) -> DataFrame:
    """Clean points of a site within the given local hours, elapsed from its first frame."""
    points = exact(clean.clean_points(raw, site, in_mph), "v_vel", "v_acc")
    return clean.hour_filter(points, hours, site.site_offset_ms)


def measured(points: DataFrame, site: SiteConfig) -> tuple[SiteConfig, int]:
    """The site with its largest observed distance, and the last full second: one aggregate."""
    row = points.agg(F.max("distance"), F.max("elapsed_time")).head()
    return replace(site, max_dist=row[0]), row[1] // 1000


def build_sections(
    spark: SparkSession,
    raw_path: str,
    out: str,
    site: SiteConfig,
    hours: Sequence[int] = (7, 8),
    fmt: str = "csv",
    in_mph: bool = False,
) -> DataFrame:
    """Section table of a raw trajectory table, written unless it is already there."""
    points = site_points(files.read_trajectories(spark, raw_path, fmt), site, hours, in_mph)
    path = _section_path(out, site, hours, in_mph)
    table = files.section_table(aggregate.section_agg(points, site), path)
    return exact(table, "avg_vel", "avg_acc")


def _section_path(out: str, site: SiteConfig, hours: Sequence[int], in_mph: bool) -> str:
    return files.section_path(out, site, "mph" if in_mph else "raw", tuple(hours))


def absorb_sections(
    spark: SparkSession,
    raw_path: str,
    out: str,
    batch: str,
    site: SiteConfig,
    hours: Sequence[int] = (7, 8),
    fmt: str = "csv",
    in_mph: bool = False,
) -> DataFrame:
    """Add a batch of raw files to the section table; a batch of a name it knows is replaced."""
    points = site_points(files.read_trajectories(spark, raw_path, fmt), site, hours, in_mph)
    table = increments.absorb(points, absorbed_path(out, site, hours, in_mph), batch, site)
    return exact(table, "avg_vel", "avg_acc")


def absorbed_path(out: str, site: SiteConfig, hours: Sequence[int] = (7, 8), in_mph: bool = False) -> str:
    return f"{_section_path(out, site, hours, in_mph)}.absorbed"


def train(
    sections: DataFrame,
    site: SiteConfig,
    window: WindowConfig,
    log: str,
    models: Sequence[str] = ("regression",),
) -> DataFrame:
    """Run the parameter sets of the study and append their errors to the log."""
    metrics = training.run_experiments(sections, site, EXPERIMENTS, models, window)
    files.append_metrics(metrics, log)
    return files.read_metrics(sections.sparkSession, log)


def fit_for_stream(
    sections: DataFrame,
    config: realtime.RealtimeConfig,
    window: WindowConfig,
    path: str,
    iterative: descent.Descent | None = None,
) -> regression.LagModel:
    """Fit the forecaster of the real-time pipeline on all but the last windows, and save it.

    Least squares, or in epochs under the robust error with the settings of ``iterative``. Where the
    jobs fill silent windows, the model learns from a series with the same windows.
    """
    site, sample = config.site, config.sample
    grids = materialize(training.window_grids(sections, site, window, config.with_ramp), "grids")
    if config.fill:
        filled = series.gap_filled(grids, grid.empty_matrix(site, config.with_ramp))
        grids = materialize(filled, "filled-grids")
    inputs = training.sample_inputs(grids, sample, window.num_windows, realtime=True)
    per_step = site.lanes(config.with_ramp) * site.sections
    if iterative:
        model = descent.fit(inputs, per_step, iterative).model
    else:
        rows = materialize(regression.lag_rows(inputs, per_step), "lag-rows")
        model = regression.fit(rows, per_step)
    model.save(path)
    told = sections.sparkSession.createDataFrame([(config.to_json(),)], "value string")
    told.coalesce(1).write.mode("overwrite").text(parameters_path(path))
    return model


def parameters_path(model: str) -> str:
    return f"{model}.parameters"


def saved_config(spark: SparkSession, model: str) -> realtime.RealtimeConfig:
    """The parameters that a saved model was fitted with."""
    return realtime.RealtimeConfig.from_json(spark.read.text(parameters_path(model)).head().value)


def transmit(
    points: DataFrame,
    start_ms: int,
    end_ms: int,
    fmt: str,
    path: str | None = None,
    slice_ms: int | None = 10_000,
    parts: int = 1,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    **options: str,
) -> None:
    """Publish the frames of a time range, silent ones included, to a topic.

    Tasks write in parallel, so one write keeps no order. The range is published slice after slice by
    one query (:class:`OrderedPublisher`): a consumer whose watermark waits ``slice_ms`` drops
    nothing. The messages are encoded once and lie sorted by time beside the ``checkpoint``; a job
    that is started again with it goes on where it has stopped. Without ``slice_ms`` all go out in one
    write, for a consumer that reads them when they are all there.
    """
    spark = points.sparkSession
    inside = points.filter(F.col("global_time").between(start_ms, end_ms))
    clock = topics.frame_clock(spark, start_ms, end_ms)
    messages = topics.frames_to_messages(inside, clock, parts)
    if slice_ms is None:
        writer = messages.select("key", "value").write.format(fmt).options(**options).mode("append")
        writer.save(path) if path else writer.save()
        return
    checkpoint = checkpoint or fresh_path(spark, "transmit")
    by_time = messages.repartitionByRange("global_time").sortWithinPartitions("global_time")
    sorted_messages = files.written_once(by_time, f"{checkpoint}.messages")
    slices = Slices(start_ms, end_ms, slice_ms)
    OrderedPublisher(sorted_messages, slices, fmt, checkpoint, path, **options).run(trigger)


def _source(spark: SparkSession, args: argparse.Namespace, topic: str) -> DataFrame:
    if args.format == "kafka":
        options = topics.kafka_source_options(args.servers, topic)
        return topics.read_stream(spark, "kafka", **options)
    return topics.read_stream(spark, args.format, topic)


def _sink(args: argparse.Namespace, topic: str) -> dict[str, str]:
    if args.format == "kafka":
        return topics.kafka_sink_options(args.servers, topic)
    return {"path": topic}


#: Flags that change what a model's weights mean: name, type, and where it is kept.
SITE_FLAGS = {"location": str, "max_dist": float, "splits": int}
SAMPLE_FLAGS = {"window_ms": int, "history": int, "skip": int, "predict": int}
BOOLEAN_FLAGS = ("with_ramp", "fill")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="laneflow")
    parser.add_argument("--executors", type=int, help="with --cores: size the session for a cluster")
    parser.add_argument("--cores", type=int)
    parser.add_argument("--largest-shuffle", type=int, default=0, help="bytes")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *options: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        for option in options:
            sub.add_argument(f"--{option}", required=True)
        for flag, kind in (SITE_FLAGS | SAMPLE_FLAGS).items():
            sub.add_argument(f"--{flag.replace('_', '-')}", type=kind)
        for flag in BOOLEAN_FLAGS:
            sub.add_argument(f"--{flag.replace('_', '-')}", action=argparse.BooleanOptionalAction)
        return sub

    for name, options in (
        ("sections", ("raw", "out")),
        ("train", ("raw", "out", "log")),
        ("fit", ("raw", "out", "model")),
    ):
        sub = job(name, *options)
        sub.add_argument("--raw-format", default="csv")
        sub.add_argument("--hours", type=int, nargs="+", default=[7, 8])
        sub.add_argument("--in-mph", action="store_true")
        sub.add_argument("--start", type=float, default=45)
        sub.add_argument("--end", type=float)
        if name == "sections":
            sub.add_argument("--absorb", metavar="BATCH", help="add the files to the table as this batch")
        if name == "fit":
            sub.add_argument("--epochs", type=int, help="fit in epochs under the robust error, so many at most")
            sub.add_argument("--patience", type=int, default=2, help="epochs without a better validation error")
    sub = job("transmit", "raw", "topic")
    sub.add_argument("--start-ms", type=int, required=True)
    sub.add_argument("--end-ms", type=int, required=True)
    sub.add_argument("--slice-ms", type=int, default=10_000, help="publish in time order, slice after slice")
    sub.add_argument("--unordered", action="store_true", help="publish everything in one write")
    sub.add_argument("--parts", type=int, default=1, help="messages that a frame is dealt to")
    sub.add_argument("--checkpoint", help="where a transmission that is started again goes on")
    sub.add_argument("--paced", action="store_true", help="publish at the pace of the recording")
    aggregate_job = job("aggregate", "source", "topic", "checkpoint")
    aggregate_job.add_argument("--model", help="take the parameters of this model")
    forecast_job = job("forecast", "topic", "out", "checkpoint", "model")
    forecast_job.add_argument("--by-site", action="store_true", help="forecast each site by its own weights, read anew for each batch")
    forecast_job.add_argument("--versions", help="folder of versions of the weights; --model gives the parameters only")
    aggregate_job.add_argument("--silence", type=int, help="with --fill: windows in a row that are filled at most")
    for stream_job in (aggregate_job, forecast_job):
        stream_job.add_argument("--late", help="folder to count rows in that come behind the watermark")
    for sub in (sub, aggregate_job, forecast_job):
        sub.add_argument("--format", default="kafka")
        sub.add_argument("--servers", default="localhost:9092")
        sub.add_argument("--available-now", action="store_true")
    return parser


def _flags(args: argparse.Namespace) -> tuple[dict, dict]:
    """The site's and the other parameters that were given on the command line."""
    given = {k: v for k, v in vars(args).items() if v is not None}
    site = {k: given[k] for k in SITE_FLAGS if k in given}
    return site, {k: given[k] for k in (*SAMPLE_FLAGS, *BOOLEAN_FLAGS) if k in given}


def job_config(spark: SparkSession, args: argparse.Namespace) -> realtime.RealtimeConfig:
    """Parameters of a job: of the model it uses, if any, or the defaults with the given flags."""
    site, rest = _flags(args)
    if getattr(args, "model", None) and args.job != "fit":
        config = saved_config(spark, args.model)
        wrong = [k for k, v in site.items() if getattr(config.site, k) != v]
        wrong += [k for k, v in rest.items() if getattr(config, k) != v]
        if wrong:
            raise ValueError(f"the model was fitted with another {', '.join(wrong)}")
        return config
    config = realtime.RealtimeConfig()
    return replace(config, site=replace(config.site, **site), **rest)


def _batch(spark: SparkSession, args: argparse.Namespace, config: realtime.RealtimeConfig) -> None:
    """The largest distance and the end of the range are measured where they aren't given."""
    site, end = config.site, args.end
    if args.max_dist is None or end is None:
        raw = files.read_trajectories(spark, args.raw, args.raw_format)
        found, last = measured(site_points(raw, site, args.hours, args.in_mph), site)
        site = found if args.max_dist is None else site
        end = last if end is None else end
    if args.job == "sections" and args.absorb:
        absorb_sections(spark, args.raw, args.out, args.absorb, site, args.hours, args.raw_format, args.in_mph)
        return
    window = WindowConfig(seconds=config.window_ms / 1000, start=args.start, end=end)
    sections = build_sections(
        spark, args.raw, args.out, site, args.hours, args.raw_format, args.in_mph
    )
    if args.job == "train":
        train(sections, site, window, args.log)
    elif args.job == "fit":
        SampleConfig(config.history, config.skip, config.predict).num_samples(window.num_windows)
        iterative = None if args.epochs is None else descent.Descent(epochs=args.epochs, patience=args.patience)
        fit_for_stream(sections, replace(config, site=site), window, args.model, iterative)


def _start_stream(spark: SparkSession, args: argparse.Namespace, config: realtime.RealtimeConfig) -> StreamingQuery:
    trigger = {"availableNow": True} if args.available_now else None
    if args.job == "aggregate":
        return realtime.start_first_job(
            _source(spark, args, args.source), replace(config, patience=args.silence), args.format,
            args.checkpoint, trigger=trigger, **_sink(args, args.topic),
        )
    messages = _source(spark, args, args.topic)
    if args.by_site:
        versions = args.versions or args.model
        return realtime.start_site_job(messages, config, versions, args.out, args.checkpoint, trigger)
    site = config.site.location
    factory = regression.load_predictor(spark, args.model, site)
    return realtime.start_second_job(messages, config, factory, args.out, args.checkpoint, trigger, site)


def main(argv: Sequence[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    builder = SparkSession.builder.appName(f"laneflow-{args.job}")
    if args.executors and args.cores:
        builder = builder.config(map=cluster_conf(args.executors, args.cores, args.largest_shuffle))
    spark = pin(builder.getOrCreate())
    config = job_config(spark, args)
    if args.job in ("sections", "train", "fit"):
        _batch(spark, args, config)
    elif args.job == "transmit":
        points = files.read_replay_points(spark, args.raw)
        slice_ms = None if args.unordered else args.slice_ms
        pace = {"processingTime": f"{args.slice_ms} milliseconds"} if args.paced else None
        transmit(
            points, args.start_ms, args.end_ms, args.format, slice_ms=slice_ms, parts=args.parts,
            checkpoint=args.checkpoint, trigger=pace, **_sink(args, args.topic),
        )
    elif args.late:
        with LateRows(spark, args.late) as late:
            query = _start_stream(spark, args, config)
            query.awaitTermination()
            late.settled(query)
    else:
        _start_stream(spark, args, config).awaitTermination()
    release(spark)


if __name__ == "__main__":
    main()
