from __future__ import annotations

from itertools import product

import pytest

from arboris.functions import scoring
from arboris.functions.lcs import edit_script
from arboris.profiles import BUNDLES, Matching, Normalization, Operation, ProfileError, Suppression, SuppressionRule, from_dict, named


def test_scores_of_the_bundles():
    m = BUNDLES["dita-map-v1"].matching
    assert scoring.score_of(scoring.SIGNATURE, m) == 0.666667
    assert scoring.score_of(scoring.ID_APPLIES | scoring.SIGNATURE | scoring.CHILDREN, m) == 0.545455
    assert scoring.score_of(scoring.ID_APPLIES | scoring.LABEL_APPLIES | scoring.ID | scoring.LABEL, m) == 0.571429
    assert scoring.blocking_keys(m) == [("label", "child_signature"), ("persistent_id",), ("signature",)]
    assert scoring.blocking_keys(BUNDLES["generic-xml-v1"].matching) == [("persistent_id",), ("signature",)]


def test_blocking_loses_nothing():
    for bundle in BUNDLES.values():
        keys = scoring.blocking_keys(bundle.matching)
        names = ("persistent_id", "signature", "label", "child_signature")
        for applies in range(4):
            for bits in product((0, 1), repeat=4):
                equal = sum(b for b, on in zip((scoring.ID, scoring.SIGNATURE, scoring.LABEL, scoring.CHILDREN), bits) if on)
                if (bits[0] and not applies & 1) or (bits[2] and not applies & 2):
                    continue
                if scoring.score_of(applies | equal, bundle.matching) >= bundle.matching.probable_threshold:
                    have = {n for n, on in zip(names, bits) if on}
                    assert any(set(k) <= have for k in keys)


def test_rules():
    with pytest.raises(ProfileError):
        Matching(probable_threshold=0.9)
    with pytest.raises(ProfileError):
        Normalization(nonsemantic_metadata_keys=("a",), preserve_property_keys=("a",))
    with pytest.raises(ProfileError):
        Operation(enabled=frozenset(("WRAP",)))
    with pytest.raises(ProfileError):
        Suppression((SuppressionRule("a", "MOVE", "x", 0.5),) * 2)
    with pytest.raises(ProfileError):
        BUNDLES["dita-map-v1"].with_(operation__enabled=frozenset(("MATCH",)))
    with pytest.raises(ProfileError) as e:
        named("nope")
    assert e.value.code == "UNSUPPORTED_CONTRACT"


def test_bundle_from_settings():
    b = from_dict({"bundle_id": "x", "matching": {"feature_weights": [{"feature": "PERSISTENT_ID", "weight": 1}]}, "alignment": {"order_semantics_by_type": {"t": "UNORDERED"}}})
    assert b.matching.weight("PERSISTENT_ID") == 1.0 and b.alignment.order_by_type == (("t", False),)


def test_lcs():
    assert edit_script(["a", "b", "c"], ["a", "c"]) == [("ALIGN", 0, 0), ("LEFT_ONLY", 1, None), ("ALIGN", 2, 1)]
    assert edit_script(["a"], ["b"]) == [("LEFT_ONLY", 0, None), ("RIGHT_ONLY", None, 0)]
    assert edit_script([], []) == []
