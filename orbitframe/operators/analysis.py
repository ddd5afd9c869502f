"""Analyses of trajectories with one way to run them: prepared once, applied to all frames as one plan."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from orbitframe.operators import aggregates, fitting


class Analysis(Protocol):
    """``prepare`` sees the whole trajectory and returns what runs; ``frames`` gives a row a frame (or an atom)."""

    def prepare(self, coords: DataFrame) -> Analysis: ...

    def frames(self, coords: DataFrame) -> DataFrame: ...


def run(analysis: Analysis, coords: DataFrame) -> DataFrame:
    """The result of an analysis over (frame_index, atom_index, x, y, z, ...); nothing runs before it is asked for."""
    return analysis.prepare(coords).frames(coords)


class _Plain:
    def prepare(self, coords: DataFrame):
        return self


@dataclass(frozen=True)
class Rmsd(_Plain):
    """RMSD of each frame to a reference, the first frame if none is given, with or without superposition."""

    reference: DataFrame | None = None
    superpose: bool = False
    weight: str | None = None

    def prepare(self, coords: DataFrame) -> Rmsd:
        return self if self.reference is not None else Rmsd(coords.where("frame_index = 0").drop("frame_index"), self.superpose, self.weight)

    def frames(self, coords: DataFrame) -> DataFrame:
        if self.superpose:
            return fitting.fit_to_reference(coords, self.reference, weight=self.weight).select("frame_index", "rmsd")
        return aggregates.rmsd(coords, self.reference, weight=self.weight)


@dataclass(frozen=True)
class Rmsf(_Plain):
    def frames(self, coords: DataFrame) -> DataFrame:
        return aggregates.rmsf(coords)


@dataclass(frozen=True)
class Msd(_Plain):
    """Mean square displacement from a reference, the first frame if none is given."""

    reference: DataFrame | None = None

    def prepare(self, coords: DataFrame) -> Msd:
        return self if self.reference is not None else Msd(coords.where("frame_index = 0").drop("frame_index"))

    def frames(self, coords: DataFrame) -> DataFrame:
        return aggregates.mean_square_displacement(coords, self.reference)


@dataclass(frozen=True)
class CenterOfMass(_Plain):
    weight: str = "mass"

    def frames(self, coords: DataFrame) -> DataFrame:
        return aggregates.center_of_mass(coords, weight=self.weight)
