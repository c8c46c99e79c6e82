"""Profiles: frozen, validated settings of each stage, held on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import lru_cache
from pathlib import Path

OPERATIONS = ("MATCH", "INSERT", "DELETE", "UPDATE", "MOVE", "REORDER")
EXTENDED = ("WRAP", "UNWRAP", "SPLIT", "MERGE")
FEATURES = ("PERSISTENT_ID", "SEMANTIC_SIGNATURE", "NORMALIZED_LABEL", "WEIGHTED_SIMILARITY")
PRESENCE_POLICIES = ("SUPPRESS_AMBIGUOUS_NODES", "SUPPRESS_UNRESOLVED_REGIONS", "EMIT_ALL")


class ProfileError(ValueError):
    """A profile that breaks a rule; ``code`` names which."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def _share(name: str, value: float) -> None:
    if not 0 <= value <= 1:
        raise ProfileError("INVALID_PROFILE", f"{name} must be between 0 and 1")


@dataclass(frozen=True)
class Normalization:
    collapse_whitespace: bool = True
    nonsemantic_metadata_keys: tuple[str, ...] = ()
    preserve_property_keys: tuple[str, ...] = ()

    def __post_init__(self):
        if both := set(self.nonsemantic_metadata_keys) & set(self.preserve_property_keys):
            raise ProfileError("INVALID_PROFILE", f"excluded and preserved at once: {sorted(both)}")


@dataclass(frozen=True)
class Matching:
    weights: tuple[tuple[str, float], ...] = (("PERSISTENT_ID", 0.5), ("SEMANTIC_SIGNATURE", 0.4), ("NORMALIZED_LABEL", 0.3), ("WEIGHTED_SIMILARITY", 0.2))
    evidence_priority: tuple[str, ...] = FEATURES
    authoritative_ids: bool = True
    hard_node_type: bool = True
    match_threshold: float = 0.6
    probable_threshold: float = 0.4
    ambiguity_margin: float = 0.05
    version: str = "v1"

    def __post_init__(self):
        for name in ("match_threshold", "probable_threshold", "ambiguity_margin"):
            _share(name, getattr(self, name))
        if self.probable_threshold > self.match_threshold:
            raise ProfileError("INVALID_PROFILE", "probable_threshold is above match_threshold")
        if any(w < 0 for _, w in self.weights):
            raise ProfileError("INVALID_PROFILE", "a weight is negative")
        if not self.evidence_priority or len(set(self.evidence_priority)) < len(self.evidence_priority):
            raise ProfileError("INVALID_PROFILE", "evidence_priority must be non-empty and without repeats")

    def weight(self, feature: str) -> float:
        """The first weight given for a feature, else 0."""
        return next((w for f, w in self.weights if f == feature), 0.0)


@dataclass(frozen=True)
class Alignment:
    strategy: str = "LCS"
    ordered: bool = True
    order_by_type: tuple[tuple[str, bool], ...] = ()


@dataclass(frozen=True)
class Operation:
    enabled: frozenset[str] = frozenset(OPERATIONS)
    move_confidence_threshold: float = 0.75
    presence_policy: str = "SUPPRESS_AMBIGUOUS_NODES"

    def __post_init__(self):
        _share("move_confidence_threshold", self.move_confidence_threshold)
        if bad := sorted(self.enabled & set(EXTENDED)):
            raise ProfileError("INVALID_PROFILE", f"extended operations can't be enabled: {bad}")
        if self.presence_policy not in PRESENCE_POLICIES:
            raise ProfileError("INVALID_PROFILE", f"no such policy: {self.presence_policy}")


@dataclass(frozen=True)
class SuppressionRule:
    rule_id: str
    root_operation: str
    effect_category: str
    threshold: float


@dataclass(frozen=True)
class Suppression:
    rules: tuple[SuppressionRule, ...] = ()

    def __post_init__(self):
        if len({r.rule_id for r in self.rules}) < len(self.rules):
            raise ProfileError("INVALID_PROFILE", "two suppression rules have one id")


@dataclass(frozen=True)
class Limits:
    max_node_count: int | None = None
    max_tree_depth: int | None = None
    max_candidates: int | None = None


_RULES = (
    SuppressionRule("insert-downstream-position-v1", "INSERT", "DOWNSTREAM_POSITION_CHANGED", 0.6),
    SuppressionRule("delete-downstream-position-v1", "DELETE", "DOWNSTREAM_POSITION_CHANGED", 0.6),
    SuppressionRule("move-descendant-path-v1", "MOVE", "DESCENDANT_PATH_CHANGED", 0.7),
    SuppressionRule("reorder-position-v1", "REORDER", "DOWNSTREAM_POSITION_CHANGED", 0.6),
)


@dataclass(frozen=True)
class Bundle:
    bundle_id: str
    version: str = "v1"
    normalization: Normalization = field(default_factory=Normalization)
    matching: Matching = field(default_factory=Matching)
    alignment: Alignment = field(default_factory=Alignment)
    operation: Operation = field(default_factory=Operation)
    suppression: Suppression = Suppression(_RULES)
    limits: Limits = Limits()

    def __post_init__(self):
        for v in validate(self):
            raise ProfileError("INVALID_PROFILE", f"{v[0]}: {v[1]}")

    def with_(self, **parts) -> Bundle:
        """A copy with other parts; ``matching__x=...`` changes one field of a part."""
        whole = {}
        for k, v in parts.items():
            part, _, name = k.partition("__")
            whole[part] = replace(whole.get(part, getattr(self, part)), **{name: v}) if name else v
        return replace(self, **whole)


def validate(bundle: Bundle) -> list[tuple[str, str]]:
    """Violations across the parts of a bundle: (code, message)."""
    out = [
        ("SUPPRESSION_RULE_DISABLED_OPERATION", f"{r.rule_id} reacts to {r.root_operation}, which is disabled")
        for r in bundle.suppression.rules
        if r.root_operation not in bundle.operation.enabled
    ]
    out += [
        ("WEIGHT_WITHOUT_PRIORITY", f"{f} has a weight but no place in evidence_priority")
        for f, w in bundle.matching.weights
        if w > 0 and f not in bundle.matching.evidence_priority
    ]
    return out


_GENERIC = Matching(
    weights=(("PERSISTENT_ID", 0.55), ("SEMANTIC_SIGNATURE", 0.3), ("WEIGHTED_SIMILARITY", 0.15)),
    evidence_priority=("PERSISTENT_ID", "SEMANTIC_SIGNATURE", "WEIGHTED_SIMILARITY"),
)
_DATA = dict(
    normalization=Normalization(nonsemantic_metadata_keys=("index",), preserve_property_keys=("key",)),
    matching=replace(_GENERIC, authoritative_ids=False),
    alignment=Alignment(order_by_type=(("data:document", False), ("data:object", False))),
)
BUNDLES = {
    "dita-map-v1": Bundle(
        "dita-map-v1",
        normalization=Normalization(nonsemantic_metadata_keys=("class", "ditaarch:DITAArchVersion", "domains"), preserve_property_keys=("keys", "href")),
        alignment=Alignment(order_by_type=(("reltable", False),)),
    ),
    "generic-xml-v1": Bundle("generic-xml-v1", normalization=Normalization(preserve_property_keys=("id", "xml:id")), matching=_GENERIC),
    "generic-json-v1": Bundle("generic-json-v1", **_DATA),
    "generic-yaml-v1": Bundle("generic-yaml-v1", **_DATA),
}


def from_dict(raw: dict) -> Bundle:
    """A bundle from nested settings with the names that bundle files use."""
    n, m, a, o, s = (raw.get(k) or {} for k in ("normalization", "matching", "alignment", "operation", "suppression"))
    base = Matching()
    return Bundle(
        raw["bundle_id"],
        str(raw.get("version", "v1")),
        Normalization(n.get("collapse_whitespace", True), tuple(n.get("nonsemantic_metadata_keys", ())), tuple(n.get("preserve_property_keys", ()))),
        Matching(
            tuple((w["feature"], float(w["weight"])) for w in m.get("feature_weights", ())), tuple(m.get("evidence_priority", FEATURES)),
            "PERSISTENT_ID" in m.get("authoritative_id_features", ()), bool(m.get("hard_constraint_node_type", True)),
            float(m.get("match_threshold", base.match_threshold)), float(m.get("probable_threshold", base.probable_threshold)),
            float(m.get("ambiguity_margin", base.ambiguity_margin)), str(m.get("version", "v1")),
        ),
        Alignment(a.get("strategy", "LCS"), a.get("default_order_semantics", "ORDERED") == "ORDERED", tuple((k, v == "ORDERED") for k, v in (a.get("order_semantics_by_type") or {}).items())),
        Operation(frozenset(o.get("enabled_operations", OPERATIONS)), float(o.get("move_confidence_threshold", 0.75)), o.get("unresolved_presence_policy", PRESENCE_POLICIES[0])),
        Suppression(tuple(SuppressionRule(r["rule_id"], r["root_operation"], r["effect_category"], float(r["threshold"])) for r in s.get("rules", ()))),
    )


@lru_cache
def load_bundle(path: str) -> Bundle:
    """A bundle from a YAML file."""
    import yaml

    return from_dict(yaml.safe_load(Path(path).read_text("utf-8")))


def named(bundle_id: str) -> Bundle:
    if bundle_id not in BUNDLES:
        raise ProfileError("UNSUPPORTED_CONTRACT", f"no profile is called {bundle_id}")
    return BUNDLES[bundle_id]
