"""Run configuration and grid descriptors."""

import hashlib
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class GridSpec:
    """Regular grid of cell centres, row-major from north-west to south-east."""

    x_min: float
    y_min: float
    x_max: float
    y_max: float
    res_x: float
    res_y: float
    variables: tuple[str, ...] = ()

    def __post_init__(self):
        if self.res_x <= 0 or self.res_y <= 0:
            raise ValueError("grid resolution must be positive")
        if self.x_min > self.x_max or self.y_min > self.y_max:
            raise ValueError("grid minimum lies above its maximum")

    @property
    def n_rows(self) -> int:
        return int(round((self.y_max - self.y_min) / self.res_y)) + 1

    @property
    def n_cols(self) -> int:
        return int(round((self.x_max - self.x_min) / self.res_x)) + 1

    @property
    def n_cells(self) -> int:
        return self.n_rows * self.n_cols


# The two published climate grids (cell centres, degrees) and their variables.
DROUGHT_INDEX = GridSpec(
    x_min=-178.75, y_min=-58.75, x_max=178.75, y_max=76.25, res_x=2.5, res_y=2.5,
    variables=("sc_PDSI_pm_filled",),
)
LAND_SURFACE = GridSpec(
    x_min=-179.875, y_min=-59.875, x_max=179.875, y_max=89.875, res_x=0.25, res_y=0.25,
    variables=(
        "Albedo_inst", "AvgSurfT_inst", "CanopInt_inst", "ECanop_tavg", "ESoil_tavg",
        "Evap_tavg", "LWdown_f_tavg", "Lwnet_tavg", "PotEvap_tavg", "Psurf_f_inst",
        "Qair_f_inst", "Qg_tavg", "Qh_tavg", "Qle_tavg", "Qs_acc", "Qsb_acc", "Qsm_acc",
        "Rainf_tavg", "RootMoist_inst", "SnowDepth_inst", "Snowf_tavg",
        "SoilMoi0_10cm_inst", "SoilMoi10_40cm_inst", "SoilMoi40_100cm_inst",
        "SoilMoi100_200cm_inst", "SoilTMP0_10cm_inst", "SoilTMP10_40cm_inst",
        "SoilTMP40_100cm_inst", "SoilTMP100_200cm_inst", "SWdown_f_tavg", "SWE_inst",
        "Swnet_tavg", "Tair_f_inst", "Tveg_tavg", "Wind_f_inst",
    ),
)

# Land-surface variables used as model features, and the water stores summed up.
FEATURE_VARIABLES = (
    "Psurf_f_inst", "Wind_f_inst", "Qair_f_inst", "Qh_tavg", "Qsb_acc", "PotEvap_tavg",
    "Tair_f_inst", "Rainf_tavg", "SoilMoi0_10cm_inst", "SoilMoi10_40cm_inst",
    "SoilMoi40_100cm_inst", "SoilMoi100_200cm_inst", "CanopInt_inst", "SWE_inst",
    "Lwnet_tavg", "Swnet_tavg",
)
SURFACE_WATER_VARIABLES = (
    "SoilMoi0_10cm_inst", "SoilMoi10_40cm_inst", "SoilMoi40_100cm_inst",
    "SoilMoi100_200cm_inst", "CanopInt_inst", "SWE_inst",
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December")
# Names of the fit metrics in the compatible wide output.
METRIC_NAMES = tuple(
    f"{split} {m}" for split in ("Train", "Validation", "Test")
    for m in ("ME", "RMSE", "MAE", "Points", "r2")
) + ("Comp R2",)


@dataclass(frozen=True)
class RunConfig:
    """All parameters of a full run, with the documented defaults."""

    # cleaning
    start: str = "1948-01-01"
    end: str = "2020-01-01"
    max_std: float = 3.0
    min_months: int = 50
    gap_days: int = 365
    pad_days: int = 90
    # priors and models
    fractions: tuple[float, ...] = (0.10, 0.15, 0.25, 0.5, 1.0)
    intercept_fraction: float = 0.10
    windows: tuple[int, ...] = (18, 24, 36, 60)
    anchor: str = "range_start"
    folds: int = 5
    validation_split: float = 0.3
    batch_size: int = 128
    epochs: int = 700
    seed: int = 42
    estimator: str = "linear"
    # refinement
    n_iterations: int = 2
    refine_fractions: tuple[float, ...] = (0.10, 0.25, 0.5, 1.0)
    refine_windows: tuple[int, ...] = (24,)
    weight_correlation: float = 0.70
    num_features: int = 5
    feature_threshold: float = 0.60
    chain: bool = True
    despike_window: int | None = None
    # surface
    n_x_cells: int = 100
    influence: float = 0.125
    stable_alpha: float = 1.5
    monthly_step: int = 1
    # storage
    units: str = "English"
    storage_coefficient: float = 0.2
    date_filter: tuple[str, str] | None = ("1948-01-01", "1978-01-01")

    def key(self, *names: str) -> str:
        """Fingerprint of the parameters up to the last of `names` (all, without names): what a stored stage depends on."""
        every = [f.name for f in fields(self)]
        upto = max((every.index(n) for n in names), default=len(every) - 1) + 1
        return hashlib.sha256(repr([(n, getattr(self, n)) for n in every[:upto]]).encode()).hexdigest()[:16]

    def __post_init__(self):
        if not 0 <= self.storage_coefficient <= 1:
            raise ValueError("the storage coefficient must be between 0 and 1")
        if self.units != "English":
            raise ValueError("only English units are supported")
        if self.n_iterations < 1 or self.folds < 2:
            raise ValueError("need at least one iteration and two folds")
        if self.max_std <= 0:
            raise ValueError("max_std must be greater than 0")
        if self.anchor not in ("range_start", "boundary"):
            raise ValueError("anchor must be 'range_start' or 'boundary'")
