r"""Chat formatting: schema fingerprints select a mapping to canonical turns; a template marks them.

A record's layout is the set of its nested field paths (``messages[].role``) that a mapping uses; what stands inside
such a field belongs to it, other fields (ids, metadata) are ignored. The hash of the sorted paths is the
layout's fingerprint and selects a declarative mapping. Lists of messages go before single fields (``prompt``),
which often repeat their first message; records that fit several mappings otherwise have none. Mapped records become
turns (role, text), and turns become one text by the template

    ### role: text</turn>

Inside roles and texts a backslash goes before each of ``\ # < :`` (``:`` in roles only), so
no text can end a turn or begin one, and reading back restores it exactly. The loss mask lists the
stretches (start, length in code points) of assistants' texts in the formatted text.

Null or missing text or role counts as empty; an empty list of messages has no turns. Parts of a text that is a list are joined by
blank lines, parts that hold no text as JSON. Turns are ordered by turn, then role, then text, null turns
first; repeated rows are turns of their own. Rows with a null conversation id are one conversation. Records
without a mapping, with messages that aren't objects or none of which has a role or text, or that aren't JSON objects, have null turns. Extra columns of
rows by turn are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C

#: Layouts: the field paths, those that may be missing, and where turns come from. ``each`` names a list with the fields of
#: role and text; ``roles`` gives each role with the fields whose texts, joined by blank lines, it says.
LAYOUTS = [
    {"paths": ["conv_id", "role", "text", "turn"], "rows": {"key": "conv_id", "order": "turn", "role": "role", "text": "text"}},
    {"paths": [], "optional": ["messages[]", "messages[].content", "messages[].role", "system"], "each": ("messages", "role", "content")},
    {"paths": [], "optional": ["conversations[]", "conversations[].from", "conversations[].value", "system"], "each": ("conversations", "from", "value")},
    {"paths": ["completion", "prompt"], "optional": ["system"], "roles": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    {"paths": ["prompt", "response"], "optional": ["system"], "roles": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"paths": ["instruction", "output"], "optional": ["input", "system"], "roles": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
]
#: Other names of the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


def field_paths(value: object, at: str = "") -> set[str]:
    """The nested paths of a record's leaves; lists add ``[]``."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({f"{at}[]"} if not value else set(), *(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _registered(layout: dict) -> Iterator[list[str]]:
    """The sets of paths that a layout may have: a list's layout has at least one path of the list."""
    some = layout.get("optional", [])
    for n in range(len(some) + 1):
        for more in combinations(some, n):
            if "each" not in layout or any(p.startswith(f"{layout['each'][0]}[]") for p in more):
                yield layout["paths"] + list(more)


MAPPINGS = {fingerprint(paths): layout for layout in LAYOUTS for paths in _registered(layout)}


def _within(path: str, field: str) -> bool:
    """Whether ``path`` is the field or stands inside it; ``x[]`` is only itself, an element without fields."""
    return path == field or not field.endswith("[]") and path.startswith((f"{field}.", f"{field}[]"))


def layout_of(paths: set[str], by_rows: bool = False) -> tuple[str, dict | None]:
    """The fingerprint of the paths that a mapping uses, and this mapping; without one, the fingerprint of all paths."""
    fits = {}
    for layout in LAYOUTS:
        used = [field for field in layout["paths"] + layout.get("optional", []) if any(_within(p, field) for p in paths)]
        if ("rows" in layout) == by_rows and MAPPINGS.get(key := fingerprint(used)) is layout:
            fits.setdefault("roles" not in layout, []).append((key, layout))
    found = fits.get(True) or fits.get(False) or []
    return found[0] if len(found) == 1 else (fingerprint(paths), None)


def _say(x: object) -> str:
    if isinstance(x, list):
        return "\n\n".join(filter(None, (_say(p["text"]) if isinstance(p, dict) and isinstance(p.get("text"), str) else _say(p) for p in x)))
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def turns_of(record: object) -> tuple[str, list[dict] | None]:
    """A record's fingerprint and its turns."""
    key, layout = layout_of(field_paths(record))
    if layout is None:
        return key, None
    if "each" in layout:
        name, role, text = layout["each"]
        said = record[name]
        if not isinstance(said, list) or not all(isinstance(m, dict) for m in said) or said and not any(role in m or text in m for m in said):
            return key, None
        first = [{"role": "system", "text": _say(record["system"])}] if "system" in record else []
        return key, first + [{"role": ROLES.get(_say(m.get(role)), _say(m.get(role))), "text": _say(m.get(text))} for m in said]
    told = ((role, [f for f in fields if f in record]) for role, fields in layout["roles"])
    return key, [{"role": role, "text": "\n\n".join(filter(None, (_say(record[f]) for f in fields)))} for role, fields in told if fields]


def canonical(records: DataFrame, json_col: str = "record") -> DataFrame:
    """``records`` with ``layout`` (the fingerprint) and ``turns``, from a column of JSON texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts, turns = [], []
            for text in batch.column(json_col).to_pylist():
                try:
                    record = json.loads(text or "null")
                except ValueError:
                    record = None
                layout, found = turns_of(record) if isinstance(record, dict) else (None, None)
                layouts.append(layout)
                turns.append(found)
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.record_batch([*batch.columns, pa.array(layouts, pa.string()), pa.array(turns, kind)], names=[*batch.schema.names, "layout", "turns"])

    kept = records.drop("layout", "turns")
    return kept.mapInArrow(run, _with(kept, f"layout string, turns {TURNS}"))


def _with(df: DataFrame, more: str):
    for field in df.sparkSession.createDataFrame([], more).schema:
        df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.schema


# --------------------------------------------------------------------------- template

#: The repetitions are possessive: what they took is never tried again, so long turns need no memory of the way.
_TURN = re.compile(r"### ((?:[^\\:#<]++|\\.)*+): ((?:[^\\#<]++|\\.)*+)</turn>\n", re.S)


def escape(text: str, also: str = "") -> str:
    return re.sub(rf"([\\#<{also}])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and its loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, ':')}: ", escape(text)
        if role == "assistant":
            mask.append((at + len(head), len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(parts), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def format_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) from rows by turn, whose layout is found by the schema's fingerprint."""
    names = set(rows.columns)
    _, layout = layout_of(names, by_rows=True)
    if layout is None:
        raise ValueError(f"no mapping for rows with {sorted(names)}")
    key, order, role, text = (layout["rows"][k] for k in ("key", "order", "role", "text"))
    picked = rows.select(F.col(key).cast("long").alias("conv_id"), F.col(order).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation yet
        turns: list[tuple[str, str]] = []
        done: list[tuple] = []
        size = 0
        for batch in batches:
            for conv, _, who, what in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    if turns:
                        done.append((now, *format_turns(turns)))
                        size += len(done[-1][1])
                        if size > 4_000_000:
                            yield _formatted(done)
                            done, size = [], 0
                    now, turns = conv, []
                turns.append((who, what))
        if turns:
            done.append((now, *format_turns(turns)))
        yield _formatted(done)

    dealt = picked.repartition(C.shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, formatted string, loss array<struct<start:long,length:long>>")


def _formatted(done: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    return pa.record_batch([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([[{"start": s, "length": n} for s, n in d[2]] for d in done], kind)], names=["conv_id", "formatted", "loss"])


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars), read from the formatted text and its loss mask alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for start, end in C.slices(pc.fill_null(pc.utf8_length(batch.column("formatted")), 0).to_pylist(), 1_000_000):
                part = batch.slice(start, end - start)
                texts, masks = part.column("formatted").to_pylist(), part.column("loss").to_pylist()
                turns = [[{"role": r, "text": t} for r, t in read_turns(text)] for text in texts]
                loss = ["".join(unescape(text[m["start"] : m["start"] + m["length"]]) for m in mask) for text, mask in zip(texts, masks, strict=True)]
                yield pa.record_batch([part.column("conv_id"), pa.array(turns, kind), pa.array(loss, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["conv_id", "turns", "loss_text", "formatted_chars"])

    return formatted.mapInArrow(run, f"conv_id long, turns {TURNS}, loss_text string, formatted_chars long")
