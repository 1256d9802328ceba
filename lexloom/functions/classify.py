"""Classes of modifications and steps by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns in their order of precedence (fixed values).
MODIFICATIONS = (
    ("REPEAL", r"abrogat|soppress|eliminat|è\s+soppresso|sono\s+soppress"),
    ("SUBSTITUTION", r"sostitu[it]|rimpiazzat|è\s+così\s+modifica"),
    ("INSERTION", r"inserit|aggiunt|dopo\s+(il|l[ae']|i|gli|le)\s+(comma|articol|letter|parol)"),
)
STEPS = (
    ("VOTE", r"votazion|scrutinio|approvat|respint"),
    ("ASSIGNMENT", r"assegna|commission|conferit"),
    ("AMENDMENT", r"emendament|modific"),
    ("DISCUSSION", r"discuss|dibattit|esame"),
)


def _first(x: Column, patterns: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, pattern in reversed(patterns):
        out = F.when(x.rlike(f"(?iu){pattern}"), name).otherwise(out)
    return out


def modification_class(x: Column) -> Column:
    """Class of a modifying text, by precedence; AMENDMENT for anything else, null and '' included."""
    return _first(x, MODIFICATIONS, "AMENDMENT")


def step_class(x: Column) -> Column:
    """Class of a step's description; DDL_PRESENTATION for anything else, null and '' included."""
    return _first(x, STEPS, "DDL_PRESENTATION")
