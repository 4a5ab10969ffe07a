"""Differential-privacy release of tables, written as Spark DataFrame operators."""

from veilframe.plans.anonymize import AnonymizationPlan, fit
from veilframe.functions.rng import KeyedNoise, TaskNoise

__all__ = ["AnonymizationPlan", "KeyedNoise", "TaskNoise", "fit"]
