"""A short notation for trees: ``r[a#x{t:1}, b:item]`` is a root with two children; #id, :type, {content}."""

from __future__ import annotations

import re

_NODE = re.compile(r"\s*([\w.-]+)(?::([\w.-]+))?(?:#([\w.-]+))?(?:\{([^}]*)\})?")


def rows(pair: str, side: str, text: str) -> list[dict]:
    out: list[dict] = []
    pos = 0

    def node(parent, at):
        nonlocal pos
        m = _NODE.match(text, pos)
        pos = m.end()
        content = dict(x.split(":", 1) for x in (m[4] or "").split(",") if x)
        kind = m[2] or ("map" if parent is None else "topicref")
        out.append(dict(pair_id=pair, side=side, node_ref=m[1], node_type=kind, parent_ref=parent, child_pos=at, identity={"id": m[3]} if m[3] else {}, content=content))
        ref = m[1]
        if pos < len(text) and text[pos] == "[":
            i = 0
            while text[pos] != "]":
                pos += 1
                node(ref, i)
                i += 1
                while text[pos] == " ":
                    pos += 1
            pos += 1

    node(None, 0)
    return out


SCHEMA = "pair_id string, side string, node_ref string, node_type string, parent_ref string, child_pos long, identity map<string,string>, content map<string,string>"


def table(spark, **pairs: tuple[str, str]):
    from arboris.sources.edges import from_edges

    every = [r for name, (s, t) in pairs.items() for side, x in (("S", s), ("T", t)) for r in rows(name, side, x)]
    return from_edges(spark.createDataFrame([tuple(r.values()) for r in every], SCHEMA))
