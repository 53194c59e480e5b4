"""Points for and against a cohort member, as a table of rules.

A chain is a list of rules of which the first that fires gives its point, to its own side. Chains without a role serve everybody. A
missing input never fires a rule. Texts hold placeholders: `{x}` the whole part of a column, `{x:1}` it rounded to so many places, `{x:%}` a share in percent.
"""

from __future__ import annotations

from dataclasses import dataclass

FOR, AGAINST = "for", "against"
RECEIVER, BACK = "receiver", "back"


@dataclass(frozen=True)
class Test:
    column: str
    op: str  # <=, >=, <, > or =
    value: float | str


@dataclass(frozen=True)
class Rule:
    side: str
    text: str
    tests: tuple[Test, ...]


@dataclass(frozen=True)
class Chain:
    rules: tuple[Rule, ...]
    role: str | None = None


def chain(*rules: tuple, role: str | None = None) -> Chain:
    """A chain from (side, text, (column, op, value), ...) rows."""
    return Chain(tuple(Rule(side, text, tuple(Test(*t) for t in tests)) for side, text, *tests in rules), role)


# Cuts and the order of the chains.
CHAINS = (
    chain((FOR, "one of the first 15 picks (round {round}, #{slot})", ("slot", "<=", 15)),
          (FOR, "taken in the first round (round {round}, #{slot})", ("slot", "<=", 32)),
          (AGAINST, "picked late, so the ceiling is low", ("slot", ">=", 60)), role=RECEIVER),
    chain((FOR, "one of the first 15 picks (round {round}, #{slot})", ("slot", "<=", 15)),
          (FOR, "an early pick (round {round}, #{slot})", ("slot", "<=", 32)),
          (AGAINST, "picked late, so chances are few", ("slot", ">=", 80)), role=BACK),
    chain((FOR, "a {rec_yards}-yard final season, among the best", ("rec_yards", ">=", 1200)),
          (FOR, "a good final season of {rec_yards} yards", ("rec_yards", ">=", 800)),
          (AGAINST, "only {rec_yards} yards in the final season", ("rec_yards", ">", 0), ("rec_yards", "<", 600)), role=RECEIVER),
    chain((FOR, "gains {ypr:1} yards a catch", ("ypr", ">=", 17)),
          (AGAINST, "gains just {ypr:1} yards a catch", ("ypr", "<", 12)), role=RECEIVER),
    chain((FOR, "scores on a large share of catches", ("td_rate", ">=", 0.15)), role=RECEIVER),
    chain((FOR, "carried the team for {rush_yards} yards", ("rush_yards", ">=", 1400)),
          (FOR, "a good {rush_yards} yards on the ground", ("rush_yards", ">=", 1000)),
          (AGAINST, "few rushing yards ({rush_yards})", ("rush_yards", "<", 700)), role=BACK),
    chain((FOR, "breaks long runs, {ypc:1} yards a carry", ("ypc", ">=", 6.5)),
          (AGAINST, "short runs, {ypc:1} yards a carry", ("ypc", "<", 5)), role=BACK),
    chain((FOR, "catches passes as well as any back", ("share", ">=", 0.25)),
          (FOR, "{back_rec_yards} yards as a receiver besides", ("back_rec_yards", ">=", 300)), role=BACK),
    chain((FOR, "tall and fast as few are ({height_in} in, {forty:2} s)", ("height_in", ">=", 74), ("forty", "<=", 4.45)),
          (FOR, "runs the forty in {forty:2} s", ("forty", "<=", 4.38)),
          (FOR, "stands {height_in} in tall", ("height_in", ">=", 75)), role=RECEIVER),
    chain((FOR, "heavy and fast as few are ({weight} lbs, {forty:2} s)", ("weight", ">=", 220), ("forty", "<=", 4.45)),
          (FOR, "runs the forty in {forty:2} s", ("forty", "<=", 4.40)), role=BACK),
    chain((AGAINST, "a forty of {forty:2} s raises doubts", ("forty", ">=", 4.58)), role=RECEIVER),
    chain((AGAINST, "a forty of {forty:2} s is slow", ("forty", ">=", 4.58)), role=BACK),
    chain((FOR, "a five-star recruit", ("stars", ">=", 5)), (FOR, "a four-star recruit", ("stars", ">=", 4))),
    chain((AGAINST, "played against weaker teams", ("tier", "=", "G5"))),
    chain((FOR, "the model gives {p_made_it:%}%", ("p_made_it", ">=", 0.90)),
          (FOR, "the model is confident ({p_made_it:%}%)", ("p_made_it", ">=", 0.85)),
          (AGAINST, "the model gives only {p_made_it:%}%", ("p_made_it", "<", 0.80))),
    chain((AGAINST, "{bust_rate:%}% of similar players failed", ("bust_rate", ">=", 0.4)),
          (FOR, "no similar player failed", ("bust_rate", "=", 0))),
    chain((FOR, "similar players made {comp_ppg:1} a game", ("comp_ppg", ">=", 10)),
          (AGAINST, "similar players made only {comp_ppg:1} a game", ("comp_ppg", "<", 5)), role=RECEIVER),
    chain((FOR, "similar players made {comp_ppg:1} a game", ("comp_ppg", ">=", 12)),
          (AGAINST, "similar players made only {comp_ppg:1} a game", ("comp_ppg", "<", 6)), role=BACK),
)

# Used for a side on which nothing fired.
FALLBACKS = (
    chain((FOR, "similar players made {comp_ppg:1} a game", ("comp_ppg", ">=", 7)),
          (FOR, "the model gives {p_made_it:%}%", ("p_made_it", ">=", 0.80)),
          (FOR, "a round {round} pick", ("slot", ">=", 1))),
    chain((AGAINST, "similar players made only {comp_ppg:1} a game", ("comp_ppg", "<", 7)),
          (AGAINST, "the model gives only {p_made_it:%}%", ("p_made_it", "<", 0.85)),
          (AGAINST, "round {round} limits the chances", ("slot", ">", 32))),
)
LIMIT = 3
