"""Unit conversion: factors to Angstrom, ps, kJ/mol, elementary charge and amu, as driver numbers or a joinable table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
N_AVOGADRO = 6.02214129e23
ELEMENTARY_CHARGE = 1.602176565e-19
CALORIE = 4.184
BOLTZMANN = 8.314462159e-3
ELECTRIC_CONSTANT = 5.526350e-3
AKMA = 4.888821e-2

#: By name; the second spelling of Boltzmann's constant is an old one.
CONSTANTS = {"N_Avogadro": N_AVOGADRO, "elementary_charge": ELEMENTARY_CHARGE, "calorie": CALORIE, "Boltzmann_constant": BOLTZMANN, "electric_constant": ELECTRIC_CONSTANT, "Boltzman_constant": BOLTZMANN}

FACTORS: dict[str, dict[str, float]] = {
    "length": {"angstrom": 1.0, "nm": 10.0, "pm": 0.01, "fm": 1e-5, "m": 1e10},
    "time": {"ps": 1.0, "fs": 1e-3, "ns": 1e3, "us": 1e6, "ms": 1e9, "s": 1e12, "akma": AKMA},
    "energy": {"kj/mol": 1.0, "kcal/mol": CALORIE, "j": N_AVOGADRO / 1e3, "ev": ELEMENTARY_CHARGE * N_AVOGADRO / 1e3},
    "velocity": {"angstrom/ps": 1.0, "angstrom/fs": 1e3, "angstrom/ns": 1e-3, "angstrom/us": 1e-6, "angstrom/ms": 1e-9, "angstrom/akma": 1 / AKMA, "nm/ps": 10.0, "nm/ns": 1e-2, "pm/ps": 1e-2, "m/s": 1e-2},
    "force": {"kj/(mol*angstrom)": 1.0, "kj/(mol*nm)": 0.1, "newton": N_AVOGADRO * 1e-13, "j/m": N_AVOGADRO * 1e-13, "kcal/(mol*angstrom)": CALORIE},
    "charge": {"e": 1.0, "amber": 18.2223, "c": 1 / ELEMENTARY_CHARGE},
    "mass": {"amu": 1.0, "kg": 1 / 1.66053906660e-27, "g/mol": 1.0},
}


#: Words for parts of units; units are compared word by word.
WORDS = {"a": "angstrom", "angstroms": "angstrom", "\u00e5": "angstrom", "nanometer": "nm", "nanometers": "nm", "picometer": "pm", "picometers": "pm", "femtometer": "fm", "femtometers": "fm", "meter": "m", "meters": "m", "picosecond": "ps", "picoseconds": "ps", "femtosecond": "fs", "femtoseconds": "fs", "nanosecond": "ns", "nanoseconds": "ns", "\u03bcs": "us", "\u00b5s": "us", "microsecond": "us", "microseconds": "us", "millisecond": "ms", "milliseconds": "ms", "sec": "s", "second": "s", "seconds": "s", "kilojoule": "kj", "kilojoules": "kj", "kilocalorie": "kcal", "kilocalories": "kcal", "joule": "j", "joules": "j", "electronvolt": "ev", "n": "newton", "newtons": "newton", "electron charge": "e", "elementary_charge": "e", "coulomb": "c", "coulombs": "c", "as": "c", "u": "amu", "da": "amu", "dalton": "amu", "daltons": "amu", "kilogram": "kg", "kilograms": "kg", "gram": "g", "grams": "g"}


def unit(name: str) -> str:
    """A unit's spelling in ``FACTORS``, from any of its usual ones in any case."""
    key = name.strip().lower().replace(" mol-1", "/mol")
    whole = WORDS.get(key) or "".join(WORDS.get(w, w) for w in re.split(r"([/()*])", key))
    return "j" if whole == "j/mol" else whole


def constant(name: str) -> float | None:
    """A physical constant by its name, or None."""
    return CONSTANTS.get(name)


def kind_of(name: str) -> str:
    """What a unit measures; ValueError if it is unknown."""
    for kind, units in FACTORS.items():
        if unit(name) in units:
            return kind
    raise ValueError(f"unknown unit {name!r}")


def factor(source: str, target: str) -> float:
    """Value of one ``source`` in ``target``; ValueError for unknown units or different kinds."""
    a, b = unit(source), unit(target)
    for units in FACTORS.values():
        if a in units and b in units:
            return units[a] / units[b]
    raise ValueError(f"no conversion from {source!r} to {target!r}")


def convert(value: Column, source: str, target: str) -> Column:
    return value * F.lit(factor(source, target))


def unit_table(spark: SparkSession) -> DataFrame:
    """(kind, unit, factor) for conversions driven by a column."""
    return spark.createDataFrame([(kind, unit, f) for kind, units in FACTORS.items() for unit, f in units.items()], "kind string, unit string, factor double")
