"""API descriptions: reading YAML or JSON, the schemas and operations inside, and their text."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from typing import Any

#: Request methods in the order of operations, and the form of a schema reference.
METHODS = ("get", "put", "post", "patch", "delete", "head", "options", "trace")
REFERENCE = re.compile(r"\A([^#]*)#/components/schemas/([^/]+)\Z")

Lookup = Callable[[str, str], dict | None]


@functools.cache
def _loader() -> type:
    """A safe loader of YAML 1.2 scalars, built once in a process; the C one where there is one."""
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        pass

    changed = ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")
    Loader.yaml_implicit_resolvers = {first: [x for x in found if x[0] not in changed] for first, found in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver(changed[0], re.compile(r"\A(?:true|True|TRUE|false|False|FALSE)\Z"), list("tTfF"))
    return Loader


@functools.lru_cache(maxsize=65_536)
def _plain(value: str) -> Any:
    """What an unquoted scalar without a tag stands for."""
    import yaml

    loader = _loader()("")
    try:
        return loader.construct_object(yaml.ScalarNode(loader.resolve(yaml.ScalarNode, value, (True, False)), value))
    finally:
        loader.dispose()


def _built(text: str) -> Any:
    """The one document of a text, from the parser's events. What this doesn't tell (tags, merged keys,
    keys that have structure, several documents, faults) raises, and is left to the loader."""
    import yaml

    parser = _loader()(text)
    key, roots, anchors, stack = object(), [], {}, []
    try:
        while True:
            event = parser.get_event()
            kind = type(event)
            if kind is yaml.ScalarEvent:
                if event.tag is not None or event.implicit[0] and event.value == "<<":
                    raise ValueError("a tag or a merged key")
                value = _plain(event.value) if event.implicit[0] else event.value
            elif kind is yaml.AliasEvent:
                value = anchors[event.anchor]
            elif kind is yaml.MappingStartEvent or kind is yaml.SequenceStartEvent:
                if event.tag is not None:
                    raise ValueError("a tag")
                value = {} if kind is yaml.MappingStartEvent else []
            elif kind is yaml.MappingEndEvent or kind is yaml.SequenceEndEvent:
                stack.pop()
                continue
            elif kind is yaml.StreamEndEvent:
                (root,) = roots
                return root
            else:
                continue
            if kind is not yaml.AliasEvent and event.anchor is not None:
                if event.anchor in anchors:
                    raise ValueError("an anchor of two places")
                anchors[event.anchor] = value
            if not stack:
                roots.append(value)
            elif type(top := stack[-1][0]) is list:
                top.append(value)
            elif stack[-1][1] is key:
                hash(value)
                stack[-1][1] = value
            else:
                top[stack[-1][1]] = value
                stack[-1][1] = key
            if kind is yaml.MappingStartEvent or kind is yaml.SequenceStartEvent:
                stack.append([value, key])
    finally:
        parser.dispose()


def read(text: str) -> dict:
    """A YAML 1.2 mapping: only true and false are booleans, and dates stay text."""
    import yaml

    try:
        found = _built(text)
    except Exception:  # noqa: BLE001  the loader says what is wrong, if anything is
        found = yaml.load(text, _loader())  # noqa: S506  a safe loader
    if not isinstance(found, dict):
        raise ValueError("not a mapping")
    return found


def written(doc: dict) -> str:
    """A mapping as YAML, as the plain dumper writes it: the C one is as good but for empty strings, double
    quotes and what isn't ASCII."""
    import yaml

    if fast := getattr(yaml, "CSafeDumper", None):
        out = yaml.dump(doc, Dumper=fast, sort_keys=False, allow_unicode=True)
        if out.isascii() and '"' not in out and "''" not in out:
            return out
    return yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)


def schemas(doc: dict) -> Iterator[tuple[str, dict]]:
    components = doc.get("components")
    found = components.get("schemas") if isinstance(components, dict) else None
    for name in sorted(found if isinstance(found, dict) else ()):
        if isinstance(found[name], dict):
            yield name, found[name]


def operations(doc: dict) -> Iterator[tuple[str, str, dict]]:
    """``method, path, operation`` by path, then in the order of METHODS."""
    paths = doc.get("paths")
    for path in sorted(paths if isinstance(paths, dict) else ()):
        item = paths[path]
        for method in METHODS if isinstance(item, dict) else ():
            if isinstance(item.get(method), dict):
                yield method, path, item[method]


def reference(node: Any) -> tuple[str, str] | None:
    """``file, schema`` of a reference; an empty file is the same one."""
    text = node.get("$ref") if isinstance(node, dict) else None
    found = REFERENCE.match(text) if isinstance(text, str) else None
    return (found[1], found[2]) if found else None


def request_schema(operation: dict) -> tuple[str, str] | None:
    """What the first media type, by name, whose schema is a reference refers to. A body that is itself a
    reference names no schema."""
    body = operation.get("requestBody")
    content = body.get("content") if isinstance(body, dict) and not isinstance(body.get("$ref"), str) else None
    for kind in sorted(content if isinstance(content, dict) else (), key=str):
        schema = content[kind].get("schema") if isinstance(content[kind], dict) else None
        if isinstance(schema, dict) and isinstance(schema.get("$ref"), str) and schema["$ref"]:
            return reference(schema)
    return None


def references(node: Any) -> Iterator[tuple[str, str]]:
    """All schema references below a node, in order of sorted keys."""
    if isinstance(node, dict):
        if found := reference(node):
            yield found
        for key in sorted(node, key=str):
            yield from references(node[key])
    elif isinstance(node, list):
        for item in node:
            yield from references(item)


def _number(value: float) -> str:
    """The shortest digits, with an exponent below 1e-4 and from 1e6 on."""
    digits = Decimal(repr(value))
    if not digits.is_finite():
        return {"inf": "+Inf", "-inf": "-Inf"}.get(str(value), "NaN")
    if value and not -4 <= digits.adjusted() < 6:
        mantissa = format(digits.scaleb(-digits.adjusted()).normalize(), "f")
        return f"{mantissa}e{digits.adjusted():+03d}"
    return format(digits.normalize(), "f") if value else "0"


def _leaf(value: Any) -> str | None:
    """A scalar, or a list of nothing else, as text; null for what has structure."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, str | int):
        return str(value)
    if isinstance(value, list) and value:
        parts = [None if isinstance(v, list) else _leaf(v) for v in value]
        return None if None in parts else ", ".join(parts)
    return None


def _leaves(node: dict, keys: Iterable[str], before: str) -> list[str]:
    return [f"{before}{k}: {text}" for k in keys if (text := _leaf(node.get(k))) is not None]


def _indented(lines: list[str], by: int) -> list[str]:
    return [" " * by + line for text in lines for line in text.split("\n")]


def describe(name: str, schema: dict, find: Lookup, expand: bool = True) -> list[str]:
    """Lines that say what a schema is. What it refers to follows the reference, marked as expanded and
    told without its own references' contents; a reference that leads nowhere stands alone."""

    def link(node: Any) -> str:
        text = node.get("$ref") if isinstance(node, dict) else None
        return text if isinstance(text, str) else ""

    def expanded(node: dict, by: int) -> list[str]:
        """What a reference leads to, or nothing."""
        ref = reference(node) if expand else None
        inner = find(*ref) if ref else None
        return [] if inner is None else [" " * by + "# expanded:", *_indented(describe(ref[1], inner, find, expand=False), by)]

    out = [f"{name}:"]
    if link(schema):
        out += [f"  $ref: {link(schema)}", *expanded(schema, 2)]
    out += _leaves(schema, [k for k in ("type", "description") if isinstance(schema.get(k), str)] + ["enum", "required"], "  ")
    for kind in ("allOf", "oneOf", "anyOf"):
        if not isinstance(schema.get(kind), list):
            continue
        out.append(f"  {kind}:")
        for member in schema[kind]:
            if not isinstance(member, dict):
                continue
            if link(member):
                out += [f"    - $ref: {link(member)}", *expanded(member, 6)]
                continue
            out += _leaves(member, sorted(member, key=str), "    - ")
            fields = member.get("properties")
            out += [f"      property: {p}" for p in sorted(fields, key=str)] if isinstance(fields, dict) else []
    fields = schema.get("properties")
    if isinstance(fields, dict):
        out.append("  properties:")
        for field in sorted(fields, key=str):
            node = fields[field]
            out.append(f"    {field}:")
            if not isinstance(node, dict):
                continue
            if inner := expanded(node, 6) if link(node) else []:
                out += [f"      $ref: {link(node)}", *inner]
                continue
            out += _leaves(node, sorted(node, key=str), "      ")
            for wrapper in ("items", "additionalProperties"):
                if link(node.get(wrapper)):
                    out += [f"      {wrapper}:", f"        $ref: {link(node[wrapper])}", *expanded(node[wrapper], 8)]
    return out


def describe_operation(name: str, operation: dict, request: list[str] | None) -> list[str]:
    """Lines that say what an operation (``METHOD path``) does; ``request`` describes its body's schema."""
    out = [name]
    if isinstance(operation.get("summary"), str):
        out.append(f"  summary: {operation['summary']}")
    parameters = operation.get("parameters")
    for parameter in parameters if isinstance(parameters, list) else ():
        if isinstance(parameter, dict) and isinstance(parameter.get("name"), str):
            out.append(f"  parameter: {parameter['name']}")
    return out + (["  requestBody:", *_indented(request, 4)] if request is not None else [])


def restrict(doc: dict, path: str | None = None, schema: str | None = None) -> dict:
    """A description with the paths at or below one path, or one schema, alone; ``ValueError`` names
    what there is instead."""
    out = {k: v for k, v in doc.items() if k not in ("paths", "components")} if path or schema else doc
    if path:
        paths = doc.get("paths") or {}
        kept = {p: paths[p] for p in sorted(paths) if p == path or p.startswith(path.rstrip("/") + "/")}
        if not kept:
            raise ValueError("no such path; there are: " + ", ".join(sorted(paths)))
        out["paths"] = kept
    if schema:
        known = dict(schemas(doc))
        if schema not in known:
            raise ValueError("no such schema; there are: " + ", ".join(known))
        out["components"] = {"schemas": {schema: known[schema]}}
    return out
