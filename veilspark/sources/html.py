"""Stored markup to nodes: the one step that needs a small Python helper.

One page in, one row out. Everything after it (candidate bands, visibility, texts,
types, ids) is column expressions over the node list.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .styles import Cascade, Sheet

# Nodes are numbered in document order; those below a node are ``ord + 1 .. last``, so an
# ancestor test is a comparison of numbers. -1 stands for none in parent, label_in (the
# nearest label around the node) and label_for (the first label for its id). ``place`` is the
# same for nodes of two snapshots that lie at the same path of tags and counts.
NODE = (
    "struct<ord:int,parent:int,last:int,depth:int,tag:string,nth:int,attrs:map<string,string>,"
    "text:string,hidden:boolean,off:boolean,label_in:int,label_for:int,place:bigint>"
)
NODE_ARROW = pa.struct([
    ("ord", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()),
    ("tag", pa.string()), ("nth", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("text", pa.string()), ("hidden", pa.bool_()), ("off", pa.bool_()),
    ("label_in", pa.int32()), ("label_for", pa.int32()), ("place", pa.int64()),
])
FIELDS = [f.name for f in NODE_ARROW]
SLICE_LETTERS = 1 << 18  # of markup whose nodes are held as Python objects at once

# Fixed values of the HTML standard: void elements, raw-text elements, elements that end
# an open paragraph, and elements whose end tag is implied by a sibling.
VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
RAW_TEXT = ("script", "style", "textarea", "title")
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
ENDS_SIBLING = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
BOUNDARY_TAGS = ENDS_PARAGRAPH | {"br", "li", "dt", "dd", "tr", "td", "th", "option"}
SCOPES = frozenset("ul ol dl select table body".split())
# Nodes whose text is asked for later; other nodes carry none.
WITH_TEXT = frozenset(
    "button input select textarea a h1 h2 h3 h4 h5 h6 p li dt dd label option canvas img".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<[!?/][^>]*>",
    re.S,
)
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TEXT}
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found.setdefault(name.lower(), entities.unescape(value))
    return found


_MASK = (1 << 64) - 1
_STYLE = re.compile(r"<!--.*?(?:-->|\Z)|<style\b[^>]*>(.*?)(?:</style\s*>|\Z)", re.S | re.I)


def _place(above: int, tag: str, nth: int) -> int:
    """A 64-bit hash of the path that ends in this tag."""
    step = (zlib.crc32(tag.encode()) << 32 | nth & 0xFFFFFFFF) ^ (above & _MASK)
    step = (step ^ step >> 29) * 0xBF58476D1CE4E5B9 & _MASK
    step = (step ^ step >> 32) * 0x94D049BB133111EB & _MASK
    return step - (1 << 64) if step >> 63 else step


def parse_page(markup: str | None) -> tuple[str, list[dict]]:
    """(title, nodes in document order, with the fields of NODE).

    One pass; the work of a tag does not depend on how deep it lies. ``hidden`` is what the
    page's own styles, ``hidden`` and ``aria-hidden`` say of the node and those around it;
    ``off``: a disabled fieldset is around it.
    """
    markup = markup or ""
    sheet = Sheet([m[1] for m in _STYLE.finditer(markup) if m[1]] if "<style" in markup.lower() else [])
    cascade = Cascade(sheet)
    title, nodes, pieces = "", [], []
    stack: list[tuple] = []  # node number, tag, first piece, counts of child tags, hides its text
    open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    top_counts: dict[str, int] = {}
    labels: dict[str, int] = {}
    hidden = 0

    def close(depth: int) -> None:
        nonlocal hidden
        while len(stack) > depth:
            number, tag, first, _, hides = stack.pop()
            open_at[tag].pop()
            cascade.close()
            hidden -= hides
            node = nodes[number]
            node["last"] = len(nodes) - 1
            if node["text"] is not None:
                node["text"] = "".join(pieces[first:])
            if tag in BOUNDARY_TAGS:
                pieces.append("\n")

    def nearest(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    def close_open(tags: tuple[str, ...], scopes: frozenset[str]) -> None:
        depth = nearest(tags)
        if depth >= 0 and depth >= nearest(scopes):
            close(depth)

    def add_text(chunk: str) -> None:
        if chunk and not hidden:
            pieces.append(entities.unescape(chunk))

    at = 0
    while True:
        found = _TAG.search(markup, at)
        if found is None:
            add_text(markup[at:])
            break
        add_text(markup[at:found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if open_at.get(tag):
                close(open_at[tag][-1])
            continue
        if tag in ENDS_PARAGRAPH:
            close_open(("p",), frozenset({"button", "table", "body"}))
        if tag in ENDS_SIBLING:
            close_open(ENDS_SIBLING[tag], SCOPES)
        attrs = _attributes(found[3])
        counts = stack[-1][3] if stack else top_counts
        counts[tag] = counts.get(tag, 0) + 1
        if tag in BOUNDARY_TAGS:
            pieces.append("\n")
        wanted = tag in WITH_TEXT or "role" in attrs
        number = len(nodes)
        above = nodes[stack[-1][0]] if stack else None
        unseen, untold = cascade.open(tag, attrs)
        nodes.append({
            "ord": number, "parent": above["ord"] if above else -1, "last": number, "depth": len(stack), "tag": tag,
            "nth": counts[tag], "attrs": attrs, "text": "" if wanted else None, "hidden": unseen,
            "off": above is not None and (above["off"] or (above["tag"] == "fieldset" and "disabled" in above["attrs"])),
            "label_in": -1 if above is None else above["ord"] if above["tag"] == "label" else above["label_in"],
            "label_for": -1, "place": _place(above["place"] if above else 0, tag, counts[tag]),
        })
        if tag == "label" and "for" in attrs:
            labels.setdefault(attrs["for"], number)
        if tag in RAW_TEXT:
            end = _END[tag].search(markup, at)
            body = markup[at: end.start() if end else len(markup)]
            at = end.end() if end else len(markup)
            if tag == "title" and not title:
                title = entities.unescape(body).strip()
            elif tag == "textarea":
                nodes[number]["text"] = entities.unescape(body)
            cascade.close()
            continue
        if tag in VOID:
            cascade.close()
            continue
        hidden += untold
        open_at[tag].append(len(stack))
        stack.append((number, tag, len(pieces), {}, untold))
    close(0)
    if labels:
        for node in nodes:
            if node["attrs"].get("id"):
                node["label_for"] = labels.get(node["attrs"]["id"], -1)
    return title, nodes


def parse_pages(df: DataFrame, markup: str = "html") -> DataFrame:
    """Replace ``markup`` by ``title`` and ``nodes``. Narrow: pages stay where they are."""
    keep = [f for f in df.schema.fields if f.name != markup]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep])
    schema += f", title string, nodes array<{NODE}>"
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(markup))
            kept = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names], names=names) if names else None
            start, size, titles, nodes = 0, 0, [], []
            for i in range(batch.num_rows):
                value = source[i].as_py()
                title, found = parse_page(value)
                titles.append(title)
                for n in found:
                    n["attrs"] = list(n["attrs"].items())
                nodes.append(found)
                size += len(value or "")
                if size >= SLICE_LETTERS or i + 1 == batch.num_rows:
                    columns = kept.slice(start, len(titles)).columns if names else []
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(titles, pa.string()), pa.array(nodes, pa.list_(NODE_ARROW))],
                        names=[*names, "title", "nodes"],
                    )
                    start, size, titles, nodes = i + 1, 0, [], []

    return df.mapInArrow(run, schema)
