"""Settings of a resolution run. Frozen; change one with dataclasses.replace()."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

METHODS = ("phone_last10", "email_exact", "email_domain", "natid_exact", "dob_exact", "soundex_full", "soundex_first", "name_token", "city_exact", "dob_initial", "lsh_minhash")


@dataclass(frozen=True)
class BlockingConfig:
    """methods: which keys are made; suppress_pct: keys on more records than this share are dropped; max_block: larger blocks are dropped.

    frequency_factor: 1, or 2 for runs that count every key twice before the share is taken.
    """

    methods: tuple[str, ...] = tuple(m for m in METHODS if m != "lsh_minhash")
    suppress_pct: float = 5.0
    max_block: int = 200
    min_token: int = 2
    max_tokens: int = 5
    frequency_factor: int = 1
    max_pairs: int | None = None


@dataclass(frozen=True)
class ScoringConfig:
    """Field weights and decision thresholds."""

    weights: dict[str, float] = field(default_factory=lambda: {"name": 0.25, "phone": 0.20, "email": 0.20, "dob": 0.15, "natid": 0.15, "address": 0.05})
    auto: float = 0.90
    review: float = 0.55
    name_fuzzy: float = 0.85
    address_fuzzy: float = 0.80
    gray: tuple[float, float] = (0.45, 0.85)


#: Fixtures' values: hardly any suppression, large blocks.
OPEN_BLOCKING = BlockingConfig(suppress_pct=90.0, max_block=1000)


def plan_mode(new: int, total: int, delta_share: float = 0.2) -> str:
    """DELTA if the new records are a small share of all, else FULL."""
    return "DELTA" if total > 0 and new / total < delta_share else "FULL"


def from_policy(text: str) -> tuple[BlockingConfig, ScoringConfig]:
    """Settings of a policy file: thresholds, blocking guards and enabled methods, fuzzy thresholds and the referee's range.

    What the file doesn't name keeps its default; the first `min_token_length` of a method is the least token length.
    """
    import yaml

    policy = yaml.safe_load(text) or {}
    blocking, thresholds = policy.get("blocking") or {}, policy.get("thresholds") or {}
    methods = [m for m in blocking.get("methods") or [] if m.get("enabled", True)]
    unknown = [m["name"] for m in methods if m["name"] not in METHODS]
    if unknown:
        raise ValueError(f"unknown blocking methods: {', '.join(unknown)}")
    b, s = BlockingConfig(), ScoringConfig()
    b = replace(
        b, methods=tuple(m["name"] for m in methods) or b.methods, suppress_pct=float(blocking.get("suppress_keys_over_frequency_pct", b.suppress_pct)), max_block=int(blocking.get("max_block_size", b.max_block)),
        min_token=next((int(m["min_token_length"]) for m in methods if "min_token_length" in m), b.min_token),
    )
    signals = {x["name"]: x for x in ((policy.get("decisioning") or {}).get("signals_for_auto_link") or {}).get("signals") or []}
    fuzzy = lambda name, default: float(signals.get(name, {}).get("threshold", default))
    span = (policy.get("referee") or {}).get("score_range") or {}
    s = replace(
        s, auto=float(thresholds.get("auto_link_min_score", s.auto)), review=float(thresholds.get("review_min_score", s.review)), name_fuzzy=fuzzy("fuzzy_name_high", s.name_fuzzy), address_fuzzy=fuzzy("address_high", s.address_fuzzy),
        gray=(float(span.get("min", s.gray[0])), float(span.get("max", s.gray[1]))),
    )
    return b, s


@dataclass
class Live:
    """The settings in force; update() replaces single values and leaves runs that have begun alone, as settings are frozen."""

    blocking: BlockingConfig = field(default_factory=BlockingConfig)
    scoring: ScoringConfig = field(default_factory=ScoringConfig)

    def read(self) -> dict[str, float]:
        b, s = self.blocking, self.scoring
        return {"suppress_pct": b.suppress_pct, "max_block": b.max_block, "min_token": b.min_token, "auto": s.auto, "review": s.review} | {f"weight_{k}": v for k, v in s.weights.items()}

    def update(self, **changes: float) -> None:
        known = self.read()
        if unknown := sorted(set(changes) - set(known)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        weights = self.scoring.weights | {k.removeprefix("weight_"): v for k, v in changes.items() if k.startswith("weight_")}
        self.blocking = replace(self.blocking, **{k: v for k, v in changes.items() if k in ("suppress_pct", "max_block", "min_token")})
        self.scoring = replace(self.scoring, weights=weights, **{k: v for k, v in changes.items() if k in ("auto", "review")})
