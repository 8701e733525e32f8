"""Settings of the detectors and exporters, validated once on the driver."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields


def _positive(settings, names: str, least: float = 0.0, whole: bool = False) -> None:
    for name in names.split():
        value = getattr(settings, name)
        if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)) or value <= least:
            raise ValueError(f"{name} must be {'a whole number' if whole else 'a number'} over {least}")


def fingerprint(settings: dict, length: int = 12) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:length]


@dataclass(frozen=True)
class DenseConfig:
    """Dense-bar detector: grid minutes, horizon, rolling median/MAD baseline."""

    bin_minutes: int = 5
    horizon_minutes: int = 15
    baseline_hours: int = 24
    min_baseline_bins: int = 24
    jump_pp: float = 3.0
    rv_pp: float = 3.0
    z_threshold: float = 4.0
    scale_floor_pp: float = 0.5
    merge_minutes: int = 30

    def __post_init__(self):
        _positive(self, "bin_minutes horizon_minutes baseline_hours min_baseline_bins merge_minutes", whole=True)
        _positive(self, "jump_pp rv_pp z_threshold scale_floor_pp")
        if self.horizon_minutes % self.bin_minutes or self.baseline_hours * 60 % self.bin_minutes:
            raise ValueError("horizon and baseline must be multiples of the bin")

    @property
    def steps(self) -> int:
        return self.horizon_minutes // self.bin_minutes

    @property
    def window(self) -> int:
        return self.baseline_hours * 60 // self.bin_minutes


@dataclass(frozen=True)
class SparseConfig:
    """Multi-horizon detector over sparse bars with a past-only median/IQR baseline."""

    bin_seconds: int = 30
    horizons_seconds: tuple[int, ...] = (30, 60, 180, 300, 900)
    min_change_pp: float = 1.0
    min_tail_change_pp: float = 0.2
    min_log_odds_change: float = 0.35
    min_variation_pp: float = 1.5
    logit_clip: float = 0.001
    min_transactions: int = 2
    min_shares: float = 5.0
    corroboration_pp: float = 0.5
    min_coverage: float = 0.6
    baseline_hours: int = 24
    min_baseline_samples: int = 30
    z_threshold: float = 4.0
    pp_scale_floor: float = 0.15
    logit_scale_floor: float = 0.05
    news_merge_seconds: int = 120
    news_max_span_seconds: int = 600

    def __post_init__(self):
        _positive(self, "bin_seconds min_transactions baseline_hours min_baseline_samples news_merge_seconds news_max_span_seconds", whole=True)
        _positive(self, "min_change_pp min_tail_change_pp min_log_odds_change min_variation_pp logit_clip min_shares corroboration_pp min_coverage z_threshold pp_scale_floor logit_scale_floor")
        if not self.horizons_seconds or any(isinstance(h, bool) or h <= 0 or h % self.bin_seconds for h in self.horizons_seconds) or len(set(self.horizons_seconds)) < len(self.horizons_seconds):
            raise ValueError("horizons must be distinct positive multiples of the bin")
        if self.min_coverage > 1 or self.logit_clip >= 0.5:
            raise ValueError("min_coverage is at most 1, logit_clip under one half")

    @property
    def fingerprint(self) -> str:
        return fingerprint({k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()})


@dataclass(frozen=True)
class Market:
    market_id: str
    question: str = ""
    outcome1_label: str = "Yes"
    outcome2_label: str = "No"
    search_queries: tuple[str, ...] = ()
    required_term_groups: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True)
class NewsConfig:
    lookback_hours: int = 24
    post_hours: int = 2
    calendar_window_days: int = 14
    max_episodes_per_market: int = 10
    max_requests: int = 80

    def __post_init__(self):
        _positive(self, "lookback_hours calendar_window_days max_episodes_per_market", whole=True)
        _positive(self, "post_hours", least=-1)


@dataclass(frozen=True)
class ContextConfig:
    """Windows of the decision export."""

    news_lookback_hours: int = 72
    max_news_items: int = 8
    max_price_age_minutes: int = 60

    def __post_init__(self):
        _positive(self, "news_lookback_hours max_news_items max_price_age_minutes", whole=True)


@dataclass(frozen=True)
class RunConfig:
    data_path: str
    output_dir: str
    markets: tuple[Market, ...]
    input_kind: str = "trades"
    dense: DenseConfig = field(default_factory=DenseConfig)
    sparse: SparseConfig = field(default_factory=SparseConfig)
    news: NewsConfig = field(default_factory=NewsConfig)
    context: ContextConfig = field(default_factory=ContextConfig)
    review_windows: tuple[dict, ...] = ()

    @staticmethod
    def load(path: str) -> RunConfig:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        markets = tuple(
            Market(str(m["market_id"]), m.get("question", ""), m.get("outcome1_label", "Yes"), m.get("outcome2_label", "No"), tuple(m.get("search_queries", ())), tuple(map(tuple, m.get("required_term_groups", ()))))
            for m in raw["markets"]
        )
        if not markets or len({m.market_id for m in markets}) < len(markets) or any(not m.question.strip() for m in markets):
            raise ValueError("markets need distinct ids and questions")

        def of(kind, values: dict):
            known = {f.name for f in fields(kind)}
            return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})

        return RunConfig(
            raw["data_path"], raw["output_dir"], markets, raw.get("input_kind", "trades"), of(DenseConfig, raw.get("detector", {})), of(SparseConfig, raw.get("fine_detector", {})),
            of(NewsConfig, raw.get("news", {})), of(ContextConfig, raw.get("dc", {})), tuple(raw.get("review_windows", ())),
        )

    @property
    def hash(self) -> str:
        return fingerprint(asdict(self), 64)
