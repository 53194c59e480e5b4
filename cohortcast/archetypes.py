"""Playing styles from measured columns: decision lists of typed conditions.

A style has one or more cases, each a set of conditions that must all hold; the first style of a list with
such a case is the answer. Cases that an earlier style always takes are not listed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortcast.functions.nulls import is_true


@dataclass(frozen=True)
class Condition:
    """A column at least or at most a cut; a missing value does not meet it. `holds=False` asks for the contrary."""
    column: str
    cut: float
    at_least: bool = True
    holds: bool = True

    def test(self, columns: Mapping[str, str]) -> Column:
        value = F.col(columns.get(self.column, self.column))
        met = is_true(value >= self.cut if self.at_least else value <= self.cut)
        return met if self.holds else ~met


@dataclass(frozen=True)
class Style:
    label: str
    cases: tuple[tuple[Condition, ...], ...]


def style_of(styles: Sequence[Style], default: str, columns: Mapping[str, str] | None = None) -> Column:
    """Label of the first style with a fulfilled case."""
    names = columns or {}
    out = F.lit(default)
    for style in reversed(styles):
        fulfilled = F.lit(False)
        for case in style.cases:
            every = F.lit(True)
            for condition in case:
                every = every & condition.test(names)
            fulfilled = fulfilled | every
        out = F.when(fulfilled, F.lit(style.label)).otherwise(out)
    return out


def _low(column: str, cut: float) -> Condition:
    return Condition(column, cut, at_least=False)


# Cuts and labels.
HEIGHT_74, HEIGHT_73, HEIGHT_71 = Condition("height_in", 74), Condition("height_in", 73), _low("height_in", 71)
WEIGHT_215, WEIGHT_220 = Condition("weight", 215), Condition("weight", 220)
SPRINT_442, SPRINT_438 = _low("forty", 4.42), _low("forty", 4.38)
GAIN_15, GAIN_16, GAIN_18 = Condition("ypr", 15), Condition("ypr", 16.5), Condition("ypr", 18)
CATCHES_70, SCORING_12 = Condition("rec_final", 70), Condition("rec_td_rate", 0.12)
FEW_CATCHES = Condition("rec_final", 70, holds=False)
SHORT_GAINS = Condition("ypr", 16.5, holds=False)
RECEIVING_1100, RECEIVING_800 = Condition("rec_yards_final", 1100), Condition("rec_yards_final", 800)
PICK_15, PICK_40, PICK_64 = _low("pick", 15), _low("pick", 40), _low("pick", 64)

RECEIVER_DEFAULT = "Developmental WR"
RECEIVER_STYLES = (
    Style("Alpha WR", ((RECEIVING_1100, HEIGHT_74, SPRINT_442), (RECEIVING_1100, HEIGHT_73, SCORING_12, PICK_15))),
    Style("Contested Catch", ((HEIGHT_74, WEIGHT_215, GAIN_16), (HEIGHT_74, WEIGHT_215, RECEIVING_800))),
    Style("Deep Threat", ((SPRINT_438, GAIN_18), (SPRINT_442, GAIN_16, FEW_CATCHES))),
    Style("Slot WR", ((CATCHES_70, HEIGHT_71),)),
    Style("Speed WR", ((SPRINT_442, RECEIVING_1100), (SPRINT_438, RECEIVING_800))),
    Style("Route Runner", ((CATCHES_70, SHORT_GAINS),)),
    Style("High-Volume WR", ((RECEIVING_1100,),)),
    Style("Big-Play WR", ((GAIN_16,),)),
    Style("Speed WR", ((SPRINT_442,),)),
    Style("Contested Catch", ((HEIGHT_74,),)),
    Style("Big-Play WR", ((GAIN_15, RECEIVING_800),)),
    Style("High-Volume WR", ((RECEIVING_800,),)),
    Style("Big-Play WR", ((SCORING_12,),)),
    Style("Alpha WR", ((PICK_15,),)),
    Style("High-Upside WR", ((PICK_40,),)),
)

SHARE_25, SHARE_15, CAUGHT_200 = Condition("recv_share", 0.25), Condition("recv_share", 0.15), Condition("rb_rec_yards", 200)
CARRIES_200, CARRIES_150 = Condition("carries_final", 200), Condition("carries_final", 150)
RUSH_6, RUSH_7 = Condition("ypc", 6.0), Condition("ypc", 7.0)
RUSHING_1200, RUSHING_900 = Condition("rush_yards_final", 1200), Condition("rush_yards_final", 900)

BACK_DEFAULT = "Developmental Back"
BACK_STYLES = (
    Style("Three-Down Back", ((RUSHING_900, SHARE_25),)),
    Style("Workhorse", ((RUSHING_1200, WEIGHT_220, CARRIES_200),)),
    Style("Explosive Back", ((RUSHING_1200, SPRINT_438, RUSH_6),)),
    Style("Speed Back", ((SPRINT_438, RUSH_6),)),
    Style("Power Back", ((RUSHING_1200, WEIGHT_220),)),
    Style("All-Purpose Back", ((RUSHING_1200, CAUGHT_200), (RUSHING_1200, SHARE_15))),
    Style("Workhorse", ((RUSHING_1200, CARRIES_200),)),
    Style("Speed Back", ((RUSHING_1200, SPRINT_442),)),
    Style("Receiving Back", ((SHARE_25,),)),
    Style("Big-Play Back", ((RUSHING_1200, RUSH_6),)),
    Style("Power Back", ((WEIGHT_220, CARRIES_150),)),
    Style("Speed Back", ((RUSHING_900, SPRINT_442),)),
    Style("All-Purpose Back", ((SPRINT_442, CAUGHT_200), (SPRINT_442, SHARE_15))),
    Style("Workhorse", ((RUSHING_900,),)),
    Style("Big-Play Back", ((RUSH_7,),)),
    Style("All-Purpose Back", ((CAUGHT_200,), (SHARE_15,))),
    Style("Workhorse", ((CARRIES_200,),)),
    Style("High-Upside Back", ((PICK_64,),)),
)
