"""Parameters of a road site, of its time windows and of the samples cut from them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SiteConfig:
    """One instrumented road.

    The defaults are fixed values of the US-101 site and must stay as they are for equal results.
    """

    location: str = "us-101"
    tz: str = "America/Los_Angeles"
    data_origin_ms: int = 1113433135300  # first frame of the whole data set, all sites
    site_offset_ms: int = 5413844400  # first frame of this site, counted from data_origin_ms
    offset_ms: int = 0  # extra shift before the time-zone conversion
    max_dist: float = 2224.6633212502065
    splits: int = 9
    crs: str = "EPSG:2227"
    main_lanes: int = 5
    ramp_lane: int = 6
    merged_lanes: tuple[int, ...] = (7, 8)  # counted as the ramp lane
    default_speed: int = 60  # mph, cells nobody drove through

    @property
    def origin_ms(self) -> int:
        """Epoch milliseconds of the site's first frame."""
        return self.data_origin_ms + self.site_offset_ms

    @property
    def section_width(self) -> float:
        return self.max_dist // self.splits

    @property
    def sections(self) -> int:
        """Flooring the width leaves a sliver behind the last full section, hence one more."""
        return self.splits + 1

    def lanes(self, with_ramp: bool = True) -> int:
        return self.ramp_lane if with_ramp else self.main_lanes


@dataclass(frozen=True)
class WindowConfig:
    """Time windows of ``seconds`` over ``[start, end)`` seconds of elapsed time."""

    seconds: float = 10
    start: float = 0
    end: float | None = None
    trim_ms: int = 45

    def __post_init__(self) -> None:
        if self.seconds <= 0:
            raise ValueError("a time window must be longer than 0 seconds")
        if self.end is not None and self.end - self.start < self.seconds:
            raise ValueError("the range [start, end) is shorter than one time window")

    @property
    def millis(self) -> int:
        return int(self.seconds * 1000)

    @property
    def num_windows(self) -> int | None:
        """Number of windows in the range, or None when the range is open-ended."""
        if self.end is None:
            return None
        return round((self.end - self.start) // self.seconds)


@dataclass(frozen=True)
class SampleConfig:
    """Windows in the model input, in the gap behind it, and in the target."""

    history: int = 6
    skip: int = 1
    predict: int = 1

    def __post_init__(self) -> None:
        if self.history < 1 or self.predict < 1 or self.skip < 0:
            raise ValueError("history and predict must be >= 1, skip >= 0")

    @property
    def span(self) -> int:
        return self.history + self.skip + self.predict

    def num_samples(self, num_windows: int) -> int:
        n = num_windows - self.span
        if n < 1:
            raise ValueError(f"{num_windows} windows are too few for one sample of {self.span}")
        return n


@dataclass(frozen=True)
class ExperimentConfig:
    """One row of a parameter sweep."""

    window_seconds: float
    sample: SampleConfig
    with_ramp: bool

    def model_name(self, model: str, sections: int, features: int = 1) -> str:
        # Fixed value: the order of the parts of a run's name.
        ramp = "w" if self.with_ramp else "wo"
        s = self.sample
        return f"{model}_{ramp}_{self.window_seconds:g}_{sections}_{s.history}_{features}_{s.skip}"


# The six parameter sets of the study.
EXPERIMENTS = (
    ExperimentConfig(10, SampleConfig(6, 1), True),
    ExperimentConfig(10, SampleConfig(6, 2), True),
    ExperimentConfig(10, SampleConfig(6, 1), False),
    ExperimentConfig(10, SampleConfig(6, 2), False),
    ExperimentConfig(0.5, SampleConfig(120, 20), True),
    ExperimentConfig(0.5, SampleConfig(120, 20), False),
)
