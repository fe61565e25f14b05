"""Parameters of the analyses: mark sets, phonetic profiles, feature sets and named presets."""

from __future__ import annotations

from dataclasses import dataclass, field

# Mark names and sets.
CORE_MARKS = (
    "meteg", "munah", "merkha", "tipeha", "mahapakh", "pashta", "tevir", "darga", "revia", "zaqef_qatan", "zaqef_gadol",
    "atnah", "atnah_hafukh", "sof_pasuq", "paseq", "qadma", "geresh", "telisha_qetana",
)
CADENCE_MARKS = ("revia", "zaqef_qatan", "zaqef_gadol", "atnah", "atnah_hafukh", "sof_pasuq", "paseq")
MAJOR_MARKS = ("atnah", "atnah_hafukh", "sof_pasuq")
MINOR_MARKS = ("revia", "zaqef_qatan", "zaqef_gadol", "shalshelet", "paseq")
# Pairs of segments that each profile treats as equal.
PROFILES: dict[str, tuple[tuple[str, str], ...]] = {
    "STRICT": (),
    "VF": (("v", "f"),),
    "DT": (("d", "t"),),
    "PB": (("p", "b"),),
    "QK": (("q", "k"),),
    "H_KH": (("h", "kh"),),
    "TS_S": (("ts", "s"),),
}
PROFILES["VOICING"] = PROFILES["VF"] + PROFILES["DT"] + PROFILES["PB"]
PROFILES["TRADITION"] = PROFILES["QK"] + PROFILES["H_KH"]
PROFILES["VOICING_TRADITION"] = PROFILES["VOICING"] + PROFILES["TRADITION"]
PROFILES["EXPANDED_ALL"] = PROFILES["VOICING_TRADITION"] + PROFILES["TS_S"]
PROFILE_ALIASES = {"NONE": "STRICT", "EXACT": "STRICT", "LEGACY_ALL": "EXPANDED_ALL", "ALL": "EXPANDED_ALL", "HKH": "H_KH", "TSS": "TS_S"}
# The null summary's gates for a Z score.
LEAST_SD_OF_COUNTS, LEAST_UNIQUE = 0.5, 3


def profile_name(name: str) -> str:
    """The canonical name of a phonetic profile; unknown names raise ValueError."""
    key = name.strip().upper().replace("-", "_")
    key = PROFILE_ALIASES.get(key, key)
    if key not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(PROFILES)}")
    return key


def profile_map(name: str) -> dict[str, str]:
    """Segment -> representative under a profile."""
    out: dict[str, str] = {}
    for pair in PROFILES[profile_name(name)]:
        for segment in pair:
            if segment in out:
                raise ValueError(f"{segment!r} is in several groups of {name}")
            out[segment] = "=".join(pair)
    return out


@dataclass(frozen=True)
class Boundaries:
    """Symbols that close a segment, by level; a level also closes where a wider one does."""

    verse: tuple[str, ...] = ("sof_pasuq",)
    major: tuple[str, ...] = MAJOR_MARKS
    minor: tuple[str, ...] = MAJOR_MARKS + MINOR_MARKS

    def levels(self) -> dict[str, tuple[str, ...]]:
        return {"verse": self.verse, "major": self.major, "minor": self.minor}


EVENT_BOUNDARIES = Boundaries(("purchase",), ("purchase", "signup"), ("purchase", "signup", "error"))


@dataclass(frozen=True)
class NullSpec:
    """How a null distribution is drawn: permutations, seed, and the kind of the draw."""

    permutations: int = 500
    seed: int = 1
    kind: str = "shuffle"

    def __post_init__(self):
        if self.permutations < 1 or self.kind not in ("shuffle", "cyclic", "run_preserving", "within"):
            raise ValueError("a null needs at least one permutation of a known kind")


@dataclass(frozen=True)
class Preset:
    """A named parameter set of an analysis family."""

    window: int = 20
    null: NullSpec = field(default_factory=NullSpec)
    block: int = 1000
    bins: int = 5
    profile: str = "STRICT"
    least_count: int = 20
    ngrams: tuple[int, ...] = (2, 3, 4, 5, 6)
    folds: int = 5


PRESETS = {
    "main": Preset(),
    "controls": Preset(null=NullSpec(kind="cyclic")),
    "explore": Preset(ngrams=(2, 3, 4, 5, 6, 7), profile="EXPANDED_ALL"),
}
