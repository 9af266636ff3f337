"""Settings of a run: a tree of dataclass-like models, read from YAML, overridden from the environment."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Any, Literal

import yaml
from pydantic import BaseModel, Field, field_validator

from fathom.errors import ConfigurationError
from fathom.functions.periods import Period


class DataSettings(BaseModel):
    input_path: str | None = None
    resample_period: str = "1W"
    max_zeros_ratio: float = Field(0.7, ge=0, le=1)
    fill_gaps: bool = False
    date_column: str = "date"
    sku_column: str = "sku"
    store_column: str = "store_id"
    quantity_column: str = "qty"
    product_id_column: str = "product_id"
    sales_qty_column: str = "sales_qty"
    categorical_columns: list[str] | None = None
    onehot_columns: list[str] | None = None
    outlier_deviations: float = Field(5.0, gt=0)
    cache_dir: str | None = None

    @field_validator("resample_period")
    @classmethod
    def _period(cls, value: str) -> str:
        Period.parse(value)
        return value


class TimeSeriesSettings(BaseModel):
    window: int = Field(52, ge=1)
    n_out: int = Field(16, ge=1)
    test_size: float = Field(0.2, ge=0, lt=1)
    block_rows: int | None = Field(None, ge=1)


class ModelSettings(BaseModel):
    model_type: Literal["seasonal_naive", "mean", "ridge", "linear", "effects"] = "ridge"
    season: int = Field(4, ge=1)
    ridge: float = Field(1.0, ge=0)
    quantiles: list[float] = [0.1, 0.5, 0.9]

    @field_validator("quantiles")
    @classmethod
    def _inside(cls, value: list[float]) -> list[float]:
        if any(not 0 < q < 1 for q in value):
            raise ValueError("quantiles lie between 0 and 1")
        return value


class TrainingSettings(BaseModel):
    num_epochs: int = Field(10, ge=1)
    batch_size: int = Field(128, ge=1)
    early_stop_patience: int = Field(3, ge=1)
    learning_rate: float = Field(1e-2, gt=0)
    weight_decay: float = Field(1e-2, ge=0)
    steps_per_epoch: int = Field(16, ge=1)
    flatten_loss: bool = True


class TuningSettings(BaseModel):
    n_trials: int = Field(9, ge=1)
    learning_rates: tuple[float, float] = (1e-4, 1e-1)
    weight_decays: tuple[float, float] = (1e-6, 1e-1)
    warm_up: int = Field(0, ge=0)
    rung: int = Field(1, ge=0)
    eta: int = Field(3, ge=2)

    @field_validator("learning_rates", "weight_decays")
    @classmethod
    def _range(cls, value: tuple[float, float]) -> tuple[float, float]:
        if not 0 < value[0] <= value[1]:
            raise ValueError("a range goes from a positive number to one at least as large")
        return value


class Settings(BaseModel):
    data: DataSettings = DataSettings()
    timeseries: TimeSeriesSettings = TimeSeriesSettings()
    model: ModelSettings = ModelSettings()
    training: TrainingSettings = TrainingSettings()
    tuning: TuningSettings = TuningSettings()
    output_dir: str = "output"
    seed: int = 42
    log_level: Literal["DEBUG", "INFO", "WARNING", "ERROR"] = "WARNING"

    @classmethod
    def from_yaml(cls, path: str | Path) -> Settings:
        with open(path) as f:
            return cls.of(yaml.safe_load(f) or {})

    @classmethod
    def of(cls, values: dict[str, Any]) -> Settings:
        try:
            return cls.model_validate(values)
        except ValueError as e:
            raise ConfigurationError(str(e)) from e

    def to_yaml(self, path: str | Path) -> None:
        with open(path, "w") as f:
            yaml.safe_dump(self.model_dump(), f, sort_keys=False)

    def with_environment(self, prefix: str = "FATHOM_", environ: dict[str, str] | None = None) -> Settings:
        """Overridden by variables such as FATHOM_TIMESERIES__WINDOW=26."""
        values = self.model_dump()
        for key, text in (os.environ if environ is None else environ).items():
            if key.startswith(prefix):
                *path, last = key[len(prefix) :].lower().split("__")
                at = values
                for part in path:
                    at = at.get(part, {})
                if last in at:
                    at[last] = yaml.safe_load(text)
        return Settings.of(values)
