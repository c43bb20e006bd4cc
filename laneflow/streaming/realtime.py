"""The two real-time jobs, as one chained query or as two joined by a topic."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DataType, DecimalType

from laneflow.config import SampleConfig, SiteConfig
from laneflow.operators import forecast, regression
from laneflow.session import timer_state
from laneflow.sources import topics
from laneflow.streaming import silence, stages


#: Speeds of messages are decimals: their means don't depend on the order they are added in.
SPEED = DecimalType(18, 6)


@dataclass(frozen=True)
class RealtimeConfig:
    """Windows of the real-time pipeline, in milliseconds of event time."""

    site: SiteConfig = field(default_factory=SiteConfig)
    window_ms: int = 10_000
    history: int = 6
    skip: int = 1
    predict: int = 1
    with_ramp: bool = False
    delay_ms: int | None = None  # one window by default
    align_to_origin: bool = True
    speed: DataType | None = SPEED
    dedup: bool = False
    fill: bool = False  # a default matrix for each window that a site is silent in
    patience: int | None = None  # so many in a row at most; None: up to the watermark

    def to_json(self) -> str:
        """Everything the meaning of a model's weights depends on, and the rest of the settings."""
        told = asdict(replace(self, speed=None))
        return json.dumps(told | {"speed": self.speed.simpleString() if self.speed else None})

    @classmethod
    def from_json(cls, text: str) -> RealtimeConfig:
        told = json.loads(text)
        site = told.pop("site")
        site = SiteConfig(**site | {"merged_lanes": tuple(site["merged_lanes"])})
        speed = told.pop("speed")
        return cls(**told, site=site, speed=DataType.fromDDL(speed) if speed else None)

    @property
    def sample(self) -> SampleConfig:
        return SampleConfig(self.history, self.skip, self.predict)

    @property
    def window(self) -> str:
        return f"{self.window_ms} milliseconds"

    @property
    def length(self) -> str:
        return f"{self.window_ms * self.history} milliseconds"

    @property
    def delay(self) -> str:
        return f"{self.window_ms if self.delay_ms is None else self.delay_ms} milliseconds"

    @property
    def start_time(self) -> str:
        origin = self.site.origin_ms if self.align_to_origin else 0
        return stages.window_alignment(origin, self.window_ms)


def section_stream(messages: DataFrame, config: RealtimeConfig) -> DataFrame:
    """Frame messages to mean speed per frame x section x lane."""
    points = topics.parse_frames(messages, config.speed).drop("v_acc")
    points = stages.add_event_time(points, config.site, config.delay)
    if config.dedup:
        points = stages.dedup_points(points)
    return stages.frame_sections(points, config.site)


def window_stream(messages: DataFrame, config: RealtimeConfig) -> DataFrame:
    return stages.tumbling_sections(
        section_stream(messages, config), config.window, config.start_time
    )


def matrix_stream(messages: DataFrame, config: RealtimeConfig) -> DataFrame:
    """First job: frame messages to one matrix per window."""
    matrices = stages.window_matrices(window_stream(messages, config), config.site, config.with_ramp)
    if not config.fill:
        return matrices
    return silence.filled_matrices(
        matrices, config.site, config.with_ramp, config.window_ms, config.patience
    )


def history_stream(messages: DataFrame, config: RealtimeConfig) -> DataFrame:
    """Both jobs in one query: the second aggregate runs on the first one's windows.

    Filled windows carry no watermark of their own, so ``fill`` takes two jobs joined by a topic.
    """
    if config.fill:
        raise ValueError("histories over filled windows are read from a topic")
    return stages.histories(
        matrix_stream(messages, config),
        "timewindow",
        config.length,
        config.window,
        config.start_time,
    )


def history_from_topic(messages: DataFrame, config: RealtimeConfig) -> DataFrame:
    """Second job on its own: window messages to ordered histories."""
    received = stages.received_matrices(topics.parse_matrices(messages), config.length)
    return stages.histories(
        received, "datetime", config.length, config.window, config.start_time
    )


def forecast_stream(
    history: DataFrame,
    config: RealtimeConfig,
    factory: forecast.PredictorFactory,
    unready: str = "zeros",
) -> DataFrame:
    """Forecasts per history window, labelled with its own start and with the target's.

    One row for each target window, numbered by ``step``. ``based_timewindow`` is on the site's wall
    clock, the other two times are epoch milliseconds; the names are fixed values of the contract.
    """
    lanes, sections = config.site.lanes(config.with_ramp), config.site.sections
    out = forecast.forecast_matrix(
        history, factory, config.history, lanes, sections, unready=unready, predict=config.predict
    )
    return _labelled(out, config)


def _labelled(out: DataFrame, config: RealtimeConfig) -> DataFrame:
    ahead = (F.col("step") + F.lit(config.skip)) * F.lit(config.window_ms)
    return out.select(
        "location",
        stages.wall_clock("based_timewindow", config.site.tz).alias("based_timewindow"),
        F.unix_millis("based_timewindow.start").alias("global_time"),
        (F.unix_millis("based_timewindow.end") + ahead).alias("target_start"),
        "step",
        "prediction",
    )


def site_forecasts(history: DataFrame, config: RealtimeConfig, models: DataFrame) -> DataFrame:
    """The same from a table of models by site (``forecast.site_models``), on a batch or as a stream-static
    join: each history is forecast by its own site's weights.

    Histories of sites without a model give no row; the observed metric ``unmodelled`` counts them.
    """
    lanes, sections = config.site.lanes(config.with_ramp), config.site.sections
    out = forecast.forecast_by_site(history, models, config.history, lanes, sections, config.predict)
    missing = F.coalesce(F.sum(F.col("step").isNull().cast("long")), F.lit(0)).alias("histories")
    return _labelled(out.observe("unmodelled", missing).filter(F.col("step").isNotNull()), config)


def start_site_job(
    messages: DataFrame,
    config: RealtimeConfig,
    model: str,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    histories: Callable[[DataFrame, RealtimeConfig], DataFrame] = history_from_topic,
) -> StreamingQuery:
    """Forecast every site of the first job's topic by its own model and append JSON files.

    The newest version of the weights is read once per micro-batch, so a version saved while the job runs is
    used from the next batch on, without a restart. A batch that is repeated after a failure overwrites its
    own folder ``batch=N`` of ``path``. The ``unmodelled`` folder beside the forecasts has the number of
    histories of each batch and site that had no model.
    """

    def forecast_batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        # Once for both outputs; small, as histories are windows and not points.
        held = rows.persist()
        models = forecast.site_models(regression.newest_weights(spark, model))
        site_forecasts(held, config, models).write.mode("overwrite").json(f"{path}/forecasts/batch={number}")
        known = models.select(F.struct("location").alias("_at"))
        without = held.withColumn("_at", F.struct("location")).join(known, "_at", "left_anti")
        counts = without.groupBy("location").agg(F.count(F.lit(1)).alias("histories"))
        counts.write.mode("overwrite").json(f"{path}/unmodelled/batch={number}")
        held.unpersist()

    writer = histories(messages, config).writeStream.foreachBatch(forecast_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


FORECASTS = "location string, global_time long, target_start long, step int, prediction array<array<int>>, batch long"


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`start_site_job` has written, with the batch that each row is of."""
    return spark.read.schema(FORECASTS).json(f"{path}/forecasts")


def read_unmodelled(spark: SparkSession, path: str) -> DataFrame:
    """``location, histories``: histories without a model over the job's life."""
    found = spark.read.schema("location string, histories long, batch long").json(f"{path}/unmodelled")
    return found.groupBy("location").agg(F.sum("histories").alias("histories"))


def start_first_job(
    messages: DataFrame, config: RealtimeConfig, fmt: str, checkpoint: str, **sink
) -> StreamingQuery:
    """Publish one matrix per closed window to a topic."""
    encoded = topics.encode_matrices(matrix_stream(messages, config))
    with timer_state(messages.sparkSession) if config.fill else nullcontext():
        return topics.write_stream(encoded, fmt, checkpoint, **sink)


def _site_of(messages: DataFrame) -> Column:
    return F.get_json_object(messages["key"].cast("string"), "$.location")


def start_second_job(
    messages: DataFrame,
    config: RealtimeConfig,
    factory: forecast.PredictorFactory,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    location: str | None = None,
) -> StreamingQuery:
    """Forecast from the first job's topic and append JSON files, once a minute by default.

    With a ``location`` messages of other sites are left out, for a model of one site; without one
    ``factory`` forecasts every site alike. See :func:`start_site_job` for a model of each.
    """
    if location is not None:
        messages = messages.filter(_site_of(messages) == location)
    out = forecast_stream(history_from_topic(messages, config), config, factory)
    return topics.write_stream(
        out, "json", checkpoint, path=path, trigger=trigger or {"processingTime": "1 minute"}
    )
