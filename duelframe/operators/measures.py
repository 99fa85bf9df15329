"""What is counted for one side of a contest, and how the counts relate.

The stored columns, the rates of a history and the plausibility checks all follow from these declarations.
"""

from __future__ import annotations

#: Kinds of actions that are stored as landed out of attempted; the plain kind is contained in the total one.
ACTIONS = ("", "total_", "td_")
#: Single counts, and the times in seconds that a side can't exceed.
SINGLE = ("kd", "sub_att", "reversals")
CONTROL, DURATION = "ctrl_sec", "duration_sec"
#: Ways in which the plain landed actions are split up completely.
SPLITS = {"target": ("head", "body", "leg"), "position": ("distance", "clinch", "ground")}
#: Rates are per 15 minutes, or shares of the kinds whose attempts both sides need.
SPAN_SEC = 900
SHARED = ("", "td_")


def tried(kind: str) -> tuple[str, str]:
    return f"{kind}landed", f"{kind}attempted"


def split_columns(way: str) -> list[str]:
    return [f"{part}_landed" for part in SPLITS[way]]


def columns() -> list[str]:
    """Stored columns of a side."""
    pairs = [c for kind in ACTIONS for c in tried(kind)]
    return ["kd", *pairs, "sub_att", "reversals", CONTROL, *[c for way in SPLITS for c in split_columns(way)], DURATION]


def bounds() -> list[tuple[str, str]]:
    """(column, column it can't exceed)."""
    return [*map(tried, ACTIONS), ("landed", "total_landed"), (CONTROL, DURATION)]


def rates() -> dict[str, tuple[str, str, int]]:
    """rate -> (numerator, denominator, scale): counts per span, accuracy of own attempts, and the share of the opponent's attempts that missed."""
    paced = {"landed": "landed", "absorbed": "opp_landed", "td_landed": "td_landed", **{c: c for c in SINGLE if c != "reversals"}, "ctrl": CONTROL}
    out = {f"{name}_p15": (column, DURATION, SPAN_SEC) for name, column in paced.items()}
    for kind in SHARED:
        label = kind or "landed_"
        out |= {f"{label}acc": (*tried(kind), 1), f"{label}def": (f"opp_{kind}missed", f"opp_{kind}attempted", 1)}
    return out


def used_by_rates() -> tuple[list[str], list[str]]:
    """Columns of the own and of the opposing side that rates are made of."""
    named = [c for numerator, denominator, _ in rates().values() for c in (numerator, denominator)]
    return list(dict.fromkeys(c for c in named if not c.startswith("opp_"))), [c for kind in SHARED for c in tried(kind)]
