"""Trees from XML, DITA map, JSON and YAML texts, parsed on the executors.

Each reader is a generator of node rows; errors are rows too (code, message), so
one bad document never stops a batch. Entities, external references, aliases,
tags and oversized or too deep documents are refused.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arboris.schema import NODES

MAX_BYTES, MAX_DEPTH, MAX_NODES = 10_000_000, 100, 100_000


class Refused(Exception):
    """A document that isn't read; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Caps:
    max_bytes: int = MAX_BYTES
    max_depth: int = MAX_DEPTH
    max_nodes: int = MAX_NODES


def _node(ref, kind, parent, pos, identity=None, content=None, structural=None, loc=None) -> dict:
    return {"node_ref": ref, "node_type": kind, "parent_ref": parent, "child_pos": pos, "identity": identity or {}, "content": content or {}, "structural": structural or {}, "loc": loc}


# --- XML ----------------------------------------------------------------------


class _Element:
    __slots__ = ("name", "attrs", "line", "column", "path", "text", "kids", "counts")

    def __init__(self, name, attrs, line, column, path):
        self.name, self.attrs, self.line, self.column, self.path, self.text, self.kids, self.counts = name, attrs, line, column, path, [], [], {}


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _attribute(name: str) -> str:
    space, _, local = name.rpartition("}")
    return "xml:id" if local == "id" and space == "http://www.w3.org/XML/1998/namespace" else local


def _xml_tree(text: str, caps: Caps) -> _Element:
    data = text.encode("utf-8", "surrogatepass")
    if len(data) > caps.max_bytes:
        raise Refused("UNSAFE_XML", f"more than {caps.max_bytes} bytes")
    parser = expat.ParserCreate(namespace_separator="}")
    stack: list[_Element] = []
    roots: list[_Element] = []
    seen = 0

    def refuse(*_):
        raise Refused("UNSAFE_XML", "entities and external references are refused")

    def start(name, attrs):
        nonlocal seen
        seen += 1
        if seen > caps.max_nodes:
            raise Refused("UNSAFE_XML", f"more than {caps.max_nodes} elements")
        if len(stack) >= caps.max_depth:
            raise Refused("UNSAFE_XML", f"deeper than {caps.max_depth}")
        local = _local(name)
        up = stack[-1] if stack else None
        n = 1
        if up is not None:
            n = up.counts[local] = up.counts.get(local, 0) + 1
        e = _Element(local, {_attribute(k): v for k, v in attrs.items()}, parser.CurrentLineNumber, parser.CurrentColumnNumber + 1, (up, local, n))
        (up.kids if up is not None else roots).append(e)
        stack.append(e)

    def data_(chunk):
        if stack and not stack[-1].kids:  # what follows a child is its tail, and is dropped
            stack[-1].text.append(chunk)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: stack.pop(), data_
    parser.EntityDeclHandler = parser.ExternalEntityRefHandler = parser.SkippedEntityHandler = refuse
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise Refused("INVALID_INPUT", f"malformed XML: {e}") from None
    return roots[0]


def _xpath(e: _Element) -> str:
    up, local, n = e.path
    if up is None:
        return f"/{local}"
    return f"{_xpath(up)}/{local}" + (f"[{n}]" if up.counts[local] > 1 else "")


def _walk_xml(root: _Element, uri: str | None, build, skip=lambda e: False) -> Iterator[dict]:
    stack = [(root, "n", None, 0)]
    while stack:
        e, ref, parent, pos = stack.pop()
        identity, content, structural = build(e)
        loc = {"document_uri": uri, "line": e.line, "column": e.column, "xpath": _xpath(e)}
        yield _node(ref, e.name, parent, pos, identity, content, structural, loc)
        kids = [k for k in e.kids if not skip(k)]
        stack.extend((k, f"{ref}.{i}", ref, i) for i, k in reversed(list(enumerate(kids))))


def _tag(props: dict) -> dict:
    return {k: f"s:{v}" for k, v in props.items()}


def xml_nodes(text: str, uri: str | None = None, caps: Caps = Caps()) -> Iterator[dict]:
    def build(e):
        identity = {}
        for name, value in e.attrs.items():
            if name in ("id", "xml:id"):
                identity["id"] = value
        own = "".join(e.text).strip()
        return _tag(identity), _tag({"text": own} if own else {}), _tag(e.attrs)

    yield from _walk_xml(_xml_tree(text, caps), uri, build)


def dita_nodes(text: str, uri: str | None = None, caps: Caps = Caps()) -> Iterator[dict]:
    """As XML, but topicmeta is folded into its topic and the id is id, else keys, else href."""

    def build(e):
        identity = {}
        if own := e.attrs.get("id") or e.attrs.get("xml:id"):
            identity["id"] = own
        if keys := " ".join((e.attrs.get("keys") or "").split()):
            identity["keys"] = keys
        if href := re.sub(r"^(\./)+", "", (e.attrs.get("href") or "").strip()):
            identity["href"] = href
        if "id" not in identity and ("keys" in identity or "href" in identity):
            identity["id"] = f"keys:{identity['keys']}" if "keys" in identity else f"href:{identity['href']}"
        title = (e.attrs.get("navtitle") or "").strip()
        if not title:
            texts = ("".join(t.text).strip() for m in e.kids if m.name == "topicmeta" for t in m.kids if t.name == "navtitle")
            title = next((t for t in texts if t), "")
        own = "".join(e.text).strip()
        return _tag(identity), _tag(({"navtitle": title} if title else {}) | ({"text": own} if own else {})), _tag(e.attrs)

    yield from _walk_xml(_xml_tree(text, caps), uri, build, lambda e: e.name == "topicmeta")


# --- JSON and YAML ------------------------------------------------------------


def _scalar(v, code: str) -> tuple[str, str, str]:
    """Type name, tagged literal and text of a scalar."""
    if v is None:
        return "null", "n:", ""
    if isinstance(v, bool):
        return "boolean", f"b:{str(v).lower()}", str(v)
    if isinstance(v, int):
        return "number", f"i:{v}", str(v)
    if isinstance(v, float):
        if not math.isfinite(v):
            raise Refused(code, "a number is not finite")
        return "number", f"f:{v!r}", str(v)
    if isinstance(v, str):
        return "string", f"s:{v}", v
    raise Refused(code, f"a {type(v).__name__} is refused")


def _content(v, code: str) -> dict:
    kind, literal, text = _scalar(v, code)
    return {"value": literal} if kind == "null" else {"value": literal, "text": f"s:{text}"}


def child_path(path: str, key: str | int) -> str:
    if isinstance(key, int):
        return f"{path}[{key}]"
    return f"{path}.{key}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key) else f"{path}[{json.dumps(key, ensure_ascii=False)}]"


def _data_nodes(value, form: str, uri: str | None, code: str) -> Iterator[dict]:
    def loc(path):
        return {"document_uri": uri, "line": None, "column": None, "xpath": path}

    yield _node("n", "data:document", None, 0, structural={"format": f"s:{form}"}, loc=loc("$"))
    stack = [("n.0", "n", 0, value, "$")]
    while stack:
        ref, parent, pos, v, path = stack.pop()
        if isinstance(v, dict):
            yield _node(ref, "data:object", parent, pos, loc=loc(path))
            pairs = [("data:property", k, x) for k, x in v.items()]
        elif isinstance(v, list):
            yield _node(ref, "data:array", parent, pos, loc=loc(path))
            pairs = [("data:item", i, x) for i, x in enumerate(v)]
        else:
            yield _node(ref, f"data:{_scalar(v, code)[0]}", parent, pos, content=_content(v, code), loc=loc(path))
            continue
        inner = []
        for i, (kind, key, x) in enumerate(pairs):
            at, here = f"{ref}.{i}", child_path(path, key)
            nested = isinstance(x, (dict, list))
            mark = {"key": f"s:{key}"} if kind == "data:property" else {}
            yield _node(at, kind, ref, i, mark, {} if nested else _content(x, code), mark or {"index": f"i:{key}"}, loc(here))
            if nested:
                inner.append((f"{at}.0", at, 0, x, here))
        stack.extend(reversed(inner))


def _measure(value, caps: Caps, code: str) -> None:
    stack, seen = [(value, 1)], 0
    while stack:
        v, depth = stack.pop()
        seen += 1
        if seen > caps.max_nodes or depth > caps.max_depth:
            raise Refused(code, "too many values" if seen > caps.max_nodes else f"deeper than {caps.max_depth}")
        if isinstance(v, float) and not math.isfinite(v):
            raise Refused(code, "a number is not finite")
        stack.extend((x, depth + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()))


def json_nodes(text: str, uri: str | None = None, caps: Caps = Caps()) -> Iterator[dict]:
    if len(text.encode("utf-8", "surrogatepass")) > caps.max_bytes:
        raise Refused("UNSAFE_JSON", f"more than {caps.max_bytes} bytes")

    def constant(name):
        raise Refused("INVALID_INPUT", f"{name} is not JSON")

    try:
        value = json.loads(text, parse_constant=constant)
    except RecursionError:
        raise Refused("UNSAFE_JSON", "nested too deep") from None
    except ValueError as e:
        raise Refused("INVALID_INPUT", f"malformed JSON: {e}") from None
    _measure(value, caps, "UNSAFE_JSON")
    yield from _data_nodes(value, "json", uri, "UNSAFE_JSON")


def yaml_nodes(text: str, uri: str | None = None, caps: Caps = Caps()) -> Iterator[dict]:
    import yaml

    if len(text.encode("utf-8", "surrogatepass")) > caps.max_bytes:
        raise Refused("UNSAFE_YAML", f"more than {caps.max_bytes} bytes")
    try:
        documents = depth = 0
        for event in yaml.parse(text, Loader=yaml.SafeLoader):
            if isinstance(event, yaml.DocumentStartEvent):
                documents += 1
            if isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None):
                raise Refused("UNSAFE_YAML", "anchors and aliases are refused")
            if getattr(event, "tag", None):
                raise Refused("UNSAFE_YAML", "tags are refused")
            if isinstance(event, yaml.ScalarEvent) and event.value == "<<" and not event.style:
                raise Refused("UNSAFE_YAML", "merge keys are refused")
            depth += isinstance(event, yaml.CollectionStartEvent) - isinstance(event, yaml.CollectionEndEvent)
            if depth > caps.max_depth:
                raise Refused("UNSAFE_YAML", f"deeper than {caps.max_depth}")
            if documents > 1:
                raise Refused("UNSAFE_YAML", "more than one document")
        value = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise Refused("INVALID_INPUT", f"malformed YAML: {e}") from None
    except RecursionError:
        raise Refused("UNSAFE_YAML", "nested too deep") from None

    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if not all(isinstance(k, str) for k in v):
                raise Refused("UNSAFE_YAML", "a key is not a string")
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)
        elif v is not None and not isinstance(v, (bool, int, float, str)):
            raise Refused("UNSAFE_YAML", f"a {type(v).__name__} is refused")
    _measure(value, caps, "UNSAFE_YAML")
    yield from _data_nodes(value, "yaml", uri, "UNSAFE_YAML")


READERS = {"generic-xml-v1": xml_nodes, "dita-map-v1": dita_nodes, "generic-json-v1": json_nodes, "generic-yaml-v1": yaml_nodes}

PARSED = T.StructType([*NODES, T.StructField("error_code", T.StringType()), T.StructField("error_message", T.StringType())])


_MAP = pa.map_(pa.string(), pa.string())
_ARROW = pa.schema([
    ("pair_id", pa.string()), ("side", pa.string()), ("node_ref", pa.string()), ("node_type", pa.string()), ("parent_ref", pa.string()), ("child_pos", pa.int64()), ("identity", _MAP), ("content", _MAP),
    ("structural", _MAP), ("loc", pa.struct([("document_uri", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("xpath", pa.string())])), ("error_code", pa.string()), ("error_message", pa.string()),
])
#: Node rows that are handed to Spark at a time.
BATCH_ROWS = 8192


def _batch(rows: list[dict]) -> pa.RecordBatch:
    maps = ("identity", "content", "structural")
    columns = [[r.get(f.name) for r in rows] if f.name not in maps else [list(m.items()) if (m := r.get(f.name)) is not None else None for r in rows] for f in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _dealt(documents: DataFrame) -> DataFrame:
    """``documents`` on enough partitions to keep the cluster parsing: small documents come by the thousands in a
    split that Spark takes to be small. Tables of more splits than cores stay as they are, and nothing is shuffled."""
    spark = documents.sparkSession
    size = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    cores = spark.sparkContext.defaultParallelism
    return documents if documents.isStreaming or size >= cores * split else documents.repartition(cores)


def parse(documents: DataFrame, profile_id: str, caps: Caps = Caps()) -> DataFrame:
    """Node rows of ``documents`` (pair_id, side, content, document_uri), and a row with error_code and
    error_message for each that is refused.

    Rows of many documents go to Spark together; a document is held whole until it is known to be sound,
    which ``caps`` bounds."""
    read = READERS[profile_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for pair_id, side, content, uri in zip(*(batch.column(i) for i in range(4))):
                own = {"pair_id": pair_id.as_py(), "side": side.as_py()}
                try:
                    if (text := content.as_py()) is None:
                        raise Refused("INVALID_INPUT", "no content")
                    made = [n | own for n in read(text, uri.as_py(), caps)]
                except Refused as e:
                    made = [own | {"error_code": e.code, "error_message": str(e)}]
                rows += made
                while len(rows) >= BATCH_ROWS:
                    yield _batch(rows[:BATCH_ROWS])
                    rows = rows[BATCH_ROWS:]
        yield _batch(rows)

    if "document_uri" not in documents.columns:
        documents = documents.withColumn("document_uri", F.lit(None).cast("string"))
    return _dealt(documents.select("pair_id", "side", "content", "document_uri")).mapInArrow(run, PARSED)


def nodes_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("error_code is null").select(*NODES.names)


def refused(parsed: DataFrame) -> DataFrame:
    return parsed.where("error_code is not null").select("pair_id", "side", "error_code", "error_message")
