"""XML as text."""

from __future__ import annotations

from . import macro


@macro("xml_escape")
def xml_escape(x):
    return f"replace(replace(replace(CAST({x} AS STRING), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@macro("xml_element")
def xml_element(name, *content):
    """The name is a constant; the content is XML already."""
    from . import text_of

    tag = text_of(name)
    return f"concat('<{tag}>', coalesce(concat_ws('', {', '.join(f'CAST({c} AS STRING)' for c in content)}), ''), '</{tag}>')" if content else f"'<{tag}/>'"


@macro("xmlconcat")
def xmlconcat(*xs):
    return f"concat_ws('', {', '.join(xs)})"


@macro("xmlagg")
def xmlagg(x):
    return f"concat_ws('', array_sort(collect_list({x})))"
