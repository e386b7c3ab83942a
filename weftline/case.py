"""A case is one DataFrame per canonical dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Case:
    bank: DataFrame
    cdr: DataFrame
    ipdr: DataFrame
    complaints: DataFrame
    subscribers: DataFrame
