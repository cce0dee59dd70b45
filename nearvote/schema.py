"""Data model: request schema, vector columns, fixed constants and search parameters."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, replace

DIMS = 14
K = 5
SCALE = 10000
# Bounds of the index, of a probe and of the merchants read.
MOST_LISTS = 16384
MOST_PROBE = 512
MOST_KNOWN = 32
V = [f"v{d}" for d in range(DIMS)]
Q = [f"q{d}" for d in range(DIMS)]

REQUEST = (
    "transaction struct<amount:double,installments:double,requested_at:string>, "
    "customer struct<avg_amount:double,tx_count_24h:double,known_merchants:array<string>>, "
    "merchant struct<id:string,mcc:string,avg_amount:double>, "
    "terminal struct<is_online:boolean,card_present:boolean,km_from_home:double>, "
    "last_transaction struct<timestamp:string,km_from_current:double>"
)
REFERENCES = "vector array<float>, label string"
ENTRIES = f"entries array<struct<request struct<{REQUEST.replace(' struct', ': struct')}>, expected_approved: boolean, expected_fraud_score: double>>"

# Risk of merchant category codes, and that of any other.
MCC_RISK = {
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
    "4511": 0.35,
    "5311": 0.25,
    "5999": 0.50,
}
MCC_DEFAULT = 0.5

# What each feature is divided by.
AMOUNT_MAX = 10000.0
INSTALLMENTS_MAX = 12
RATIO_MAX = 10.0
MINUTES_MAX = 1440
KM_MAX = 1000.0
COUNT_MAX = 20

BBOX_MODES = ("off", "ambiguous-only", "always", "boundary-only")


@dataclass(frozen=True)
class SearchParams:
    """How a search runs. ``bbox_mode`` says when lists outside the probed ones are repaired by their boxes."""

    base_nprobe: int = 20
    ambig_nprobe: int = 40
    bbox_mode: str = "ambiguous-only"
    exact_fallback: bool = False
    heuristic_only: bool = False
    fast_path: bool = False

    def __post_init__(self) -> None:
        if self.bbox_mode not in BBOX_MODES:
            raise ValueError(f"unknown bbox mode {self.bbox_mode}")


SERVER_DEFAULTS = SearchParams(12, 24)
VALIDATOR_DEFAULTS = SearchParams(256, 512)


@dataclass(frozen=True)
class BuildSettings:
    """How an index is built."""

    references: str = ""
    out: str = ""
    method: str = "balanced"
    nlist: int = 8192
    kmeans_sample: int = 131072
    kmeans_iters: int = 8


@dataclass(frozen=True)
class ValidateSettings:
    """How an index is validated. ``limit`` 0 takes all queries."""

    index: str = ""
    queries: str = ""
    limit: int = 0
    flat_only: bool = False
    dump_mismatches: bool = False
    out_json: str = ""
    params: SearchParams = VALIDATOR_DEFAULTS


def _flags(args: list[str], known: dict[str, type]) -> dict:
    """Values of the known ``--flags``; unknown ones are passed over, the last of a repeated one counts."""
    parser = argparse.ArgumentParser(add_help=False, allow_abbrev=False, argument_default=argparse.SUPPRESS)
    for name, kind in known.items():
        flag = "--" + name.replace("_", "-")
        parser.add_argument(flag, dest=name, **({"action": "store_true"} if kind is bool else {"type": kind}))
    return vars(parser.parse_known_args(args)[0])


def build_settings(args: list[str]) -> BuildSettings:
    return BuildSettings(**_flags(args, {"references": str, "out": str, "method": str, "nlist": int, "kmeans_sample": int, "kmeans_iters": int}))


def validate_settings(args: list[str], base: SearchParams = VALIDATOR_DEFAULTS) -> ValidateSettings:
    """An unknown box mode counts as ambiguous-only; of the two flags for the exact fallback the last one counts."""
    got = _flags(args, {"index": str, "queries": str, "limit": int, "flat_only": bool, "dump_mismatches": bool, "out_json": str})
    how = _flags(args, {"base_nprobe": int, "ambig_nprobe": int, "heuristic_only": bool, "fast_path": bool, "bbox_mode": str})
    if how.get("bbox_mode", "off") not in BBOX_MODES:
        how["bbox_mode"] = "ambiguous-only"
    asked = [a for a in args if a in ("--exact-fallback", "--no-exact-fallback")]
    if asked:
        how["exact_fallback"] = asked[-1] == "--exact-fallback"
    return ValidateSettings(**got, params=replace(base, **how))


def params_from_env(env: dict[str, str], base: SearchParams = SERVER_DEFAULTS) -> SearchParams:
    """Parameters from environment settings; what is missing keeps the base's value."""
    flag = lambda name, old: env[name].lower() in ("1", "true", "yes", "on") if name in env else old
    return SearchParams(
        int(env.get("IVF_NPROBE", base.base_nprobe)),
        int(env.get("IVF_NPROBE_AMBIG", base.ambig_nprobe)),
        env.get("BBOX_MODE", base.bbox_mode),
        flag("EXACT_FALLBACK", base.exact_fallback),
        flag("HEURISTIC_ONLY", base.heuristic_only),
        flag("FAST_PATH", base.fast_path),
    )
