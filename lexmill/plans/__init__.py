from lexmill.plans.inference import run_scoring
from lexmill.plans.training import run_sweep, run_training

__all__ = ["run_scoring", "run_sweep", "run_training"]
