"""Run configuration: plain values on the driver, literals in the plans."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from barloom.functions.canonical import stable_hash

SECONDS_PER_YEAR = 365.25 * 86400


@dataclass(frozen=True)
class Costs:
    cost_bps: float = 1.0
    slippage_bps: float = 0.5

    @property
    def rate(self) -> float:
        return (self.cost_bps + self.slippage_bps) / 10_000.0


@dataclass(frozen=True)
class SearchSpace:
    """What genomes are made of (fixed values)."""

    features: tuple[str, ...] = ("mom_ir", "mr_z", "vol_s", "volu_z")
    windows: tuple[int, ...] = (5, 10, 20, 40, 80, 160, 320)
    gate_windows: tuple[int, ...] = (40, 80, 160)
    gate_modes: tuple[str, ...] = ("any", "high", "low")
    min_parts: int = 2
    max_parts: int = 4
    weight_range: tuple[float, float] = (-2.5, 2.5)
    threshold_range: tuple[float, float] = (0.15, 1.5)


@dataclass(frozen=True)
class EvalConfig:
    """Evaluation parameters; the defaults are fixed values that results depend on."""

    score_version: str = "score_v4_cv_regime"
    costs: Costs = field(default_factory=Costs)
    stress_cost_mult: float = 3.0
    holdout_frac: float = 0.20
    min_train_bars: int = 5000
    min_holdout_bars: int = 1500
    mdd_floor: float = 0.02
    calmar_cap: float = 25.0
    n_walkforward_splits: int = 4
    min_exposure_train: float = 0.02
    min_exposure_holdout: float = 0.01
    min_active_bars_train: int = 300
    min_active_bars_holdout: int = 80
    min_trades_train: int = 60
    min_trades_holdout: int = 10
    max_turnover_mean_train: float = 1.2
    max_turnover_mean_holdout: float = 1.5
    max_drawdown_abs_train: float = 0.75
    max_drawdown_abs_holdout: float = 0.75
    min_train_sharpe: float = 0.25
    min_holdout_sharpe: float = 0.05
    min_holdout_stress_sharpe: float = 0.0
    min_wf_positive_segments: int = 2
    max_wf_dominance: float = 0.85
    deep_validation: bool = True
    cv_folds: int = 5
    cv_delay_bars: int = 1
    cv_min_fold_bars: int = 800
    cv_min_positive_folds_frac: float = 0.60
    cv_min_positive_folds: int = 0
    cv_min_sharpe: float = -0.20
    cv_min_median_sharpe_base: float = 0.20
    cv_min_median_sharpe_delay1: float = 0.10
    cv_min_median_sharpe_coststress: float = 0.05
    cv_min_sharpe_delay1: float = -0.10
    cv_min_sharpe_coststress: float = -0.10
    cv_min_positive_folds_coststress_frac: float = 0.60
    cv_min_positive_folds_coststress: int = 0
    regime_enabled: bool = True
    regime_vol_window: int = 160
    regime_trend_window: int = 160
    regime_min_bars: int = 600
    regime_min_exposure: float = 0.03

    @property
    def eval_id(self) -> str:
        return "eval_" + stable_hash(asdict(self))[:12]


@dataclass(frozen=True)
class ResearchConfig:
    dataset_id: str
    store: str
    seed: int = 1234
    generations: int = 4
    generation_size: int = 96
    search_mode: str = "evo"
    elite_size: int = 512
    elite_load: int = 128
    seen_max: int = 200_000
    space: SearchSpace = field(default_factory=SearchSpace)
    evaluation: EvalConfig = field(default_factory=EvalConfig)
