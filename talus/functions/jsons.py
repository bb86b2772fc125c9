"""JSON operators and functions on JSON text. Containment and deletion, which recurse, are Arrow-batched functions in talus.functions.udfs."""

from __future__ import annotations

from . import macro, text_of


def json_path(*keys: str) -> str:
    """A constant path: names, or numbers of array members from 0."""
    return "$" + "".join(f"[{k}]" if k.isdigit() else f"['{k}']" for k in keys)


def _quoted(path: str) -> str:
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


@macro("json_get")
def json_get(x, *keys):
    """The member as JSON text; strings keep their quotes."""
    return f"to_json(try_variant_get(try_parse_json({x}), {_quoted(json_path(*keys))}, 'variant'))"


@macro("json_get_text")
def json_get_text(x, *keys):
    """The member as text; strings lose their quotes, null is null."""
    return f"get_json_object({x}, {_quoted(json_path(*keys))})"


@macro("json_extract_path_text", "jsonb_extract_path_text")
def json_extract_path_text(x, *keys):
    return json_get_text(x, *map(text_of, keys))


@macro("json_extract_path", "jsonb_extract_path")
def json_extract_path(x, *keys):
    return json_get(x, *map(text_of, keys))


@macro("json_array_length", "jsonb_array_length")
def json_array_length(x):
    return f"json_array_length({x})"


@macro("json_typeof", "jsonb_typeof")
def json_typeof(x):
    first = f"left(ltrim({x}), 1)"
    return f"CASE {first} WHEN '{{' THEN 'object' WHEN '[' THEN 'array' WHEN '\"' THEN 'string' WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' WHEN 'n' THEN 'null' ELSE CASE WHEN {x} IS NOT NULL THEN 'number' END END"


@macro("json_has_key")
def json_has_key(x, key):
    """A key of an object, or a string member of an array."""
    return f"coalesce(array_contains(json_object_keys({x}), {key}), array_contains(from_json(CASE WHEN ltrim({x}) LIKE '[%' THEN {x} END, 'array<string>'), {key}), false)"


@macro("json_has_any")
def json_has_any(x, keys):
    return f"coalesce(arrays_overlap(json_object_keys({x}), {keys}), false)"


@macro("json_has_all")
def json_has_all(x, keys):
    return f"coalesce(size(array_except({keys}, json_object_keys({x}))) = 0, false)"


@macro("json_build_object", "jsonb_build_object")
def json_build_object(*xs):
    """Null values stay."""
    pairs = [f"concat(to_json(CAST({k} AS VARIANT)), ':', coalesce(to_json(CAST({v} AS VARIANT)), 'null'))" for k, v in zip(xs[::2], xs[1::2], strict=True)]
    return f"concat('{{', concat_ws(',', {', '.join(pairs)}), '}}')" if pairs else "'{}'"


@macro("json_build_array", "jsonb_build_array")
def json_build_array(*xs):
    return f"concat('[', concat_ws(',', {', '.join(f'coalesce(to_json(CAST({x} AS VARIANT)), {chr(39)}null{chr(39)})' for x in xs)}), ']')" if xs else "'[]'"


@macro("to_jsonb", "to_json")
def to_json(x):
    return f"coalesce(to_json(CAST({x} AS VARIANT)), 'null')"


@macro("row_to_json")
def row_to_json(x):
    return f"to_json({x}, map('ignoreNullFields', 'false'))"


@macro("json_agg", "jsonb_agg")
def json_agg(x):
    """An array of the values that aren't null, in ascending order, so that the result is the same each time."""
    return f"to_json(array_sort(collect_list({x})))"


@macro("json_object_agg", "jsonb_object_agg")
def json_object_agg(k, v):
    return f"to_json(map_from_entries(array_sort(collect_list(struct(CAST({k} AS STRING) AS k, {v} AS v)))))"


@macro("json_contains")
def json_contains(x, y):
    return f"talus_json_contains({x}, {y})"


@macro("json_delete")
def json_delete(x, key):
    return f"talus_json_delete({x}, CAST({key} AS STRING))"


@macro("json_delete_path")
def json_delete_path(x, path):
    return f"talus_json_delete_path({x}, {path})"
