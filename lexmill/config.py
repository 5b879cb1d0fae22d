"""Arguments of a training run and of a scoring job, as plain dataclasses."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class TrainingConfig:
    """One training run. Field names and sample values follow the documented config keys."""

    model_type: str = "softmax"
    experiment_location: str = "default"
    train_table_name: str = "train"
    test_table_name: str = "test"
    database_name: str | None = None
    feature_col: str = "text"
    label_col: str = "label"
    row_key: str = "doc_id"
    num_labels: int = 2
    streaming_read: bool = False
    max_token_length: int = -1
    eval_steps: int | None = None
    batch_size: int = 64
    num_train_epochs: int = 3
    save_total_limit: int = 10
    metric_for_best_model: str = "f1"
    seed: int = 123
    weight_decay: float = 0.01
    learning_rate: float = 10.0
    parallelism: int | None = None
    max_vocab: int | None = None
    feature_bits: int = 14

    def __post_init__(self) -> None:
        if self.model_type not in MODEL_TYPES:
            raise ValueError(f"model_type must be one of {MODEL_TYPES}, got {self.model_type!r}")
        if self.num_labels < 1 or self.batch_size < 1 or self.num_train_epochs < 1:
            raise ValueError("num_labels, batch_size and num_train_epochs must be at least 1")

    def as_params(self) -> dict[str, str]:
        """The parameters as logged with a run: every field, as strings."""
        return {name: str(value) for name, value in asdict(self).items()}


@dataclass(frozen=True)
class ScoringJob:
    """One scoring job over a table."""

    model_name: str
    input_table: str
    output_table: str
    stage: str = "Production"
    input_database: str | None = None
    output_database: str | None = None
    feature_col: str = "text"
    batch_size: int = 1000
    batch_inference: bool = True
    df_repartition_num: int | None = None
    write_mode: str = "overwrite"

    @classmethod
    def from_params(cls, params: dict[str, str]) -> "ScoringJob":
        """Build from string job parameters, e.g. ``{"batch_inference": "True", ...}``."""
        values = dict(params)
        if "batch_size" in values:
            values["batch_size"] = int(values["batch_size"])
        if "batch_inference" in values:
            values["batch_inference"] = parse_flag("batch_inference", values["batch_inference"])
        if "df_repartition_num" in values:
            raw = values["df_repartition_num"]
            values["df_repartition_num"] = None if raw in ("None", "", None) else int(raw)
        return cls(**values)


MODEL_TYPES = ("bayes", "softmax")


def parse_flag(name: str, value: str | bool) -> bool:
    """'True' or 'False'; anything else is refused rather than silently doing nothing."""
    if isinstance(value, bool):
        return value
    if value not in ("True", "False"):
        raise ValueError(f"{name} must be 'True' or 'False', got {value!r}")
    return value == "True"
