"""Recipes from decisions about block patterns: profile, examples, decisions, recipe."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .errors import ExtractionError
from .functions.text import literal_glob
from .saving import save_json
from .sink import checked

KINDS = ("heading", "paragraph", "line-start", "line", "skip")
SESSION_BYTES = 8 << 20


def _pattern() -> "F.Column":
    return F.concat_ws(".", F.lower("tag"), F.array_join(F.array_sort(F.array_distinct("classes")), "."))


def profile(blocks: DataFrame) -> DataFrame:
    """(pattern, tag, classes, blocks, documents): how often each tag with exactly these classes occurs."""
    keyed = blocks.withColumn("pattern", _pattern())
    per = keyed.groupBy("pattern", "document_path").agg(F.count("*").alias("n"), F.first(F.lower("tag")).alias("tag"), F.first(F.array_sort(F.array_distinct("classes"))).alias("classes"))
    return per.groupBy("pattern").agg(F.first("tag").alias("tag"), F.first("classes").alias("classes"), F.sum("n").alias("blocks"), F.count("*").alias("documents"))


def examples(blocks: DataFrame, n: int = 3) -> DataFrame:
    """The first and last n blocks of each pattern of a book."""
    w = Window.partitionBy("book_id", "pattern")
    keyed = blocks.withColumn("pattern", _pattern())
    ranked = keyed.withColumns({"_a": F.row_number().over(w.orderBy("seq")), "_z": F.row_number().over(w.orderBy(F.desc("seq")))})
    return ranked.where((F.col("_a") <= n) | (F.col("_z") <= n)).drop("_a", "_z")


def blocks_per_document(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Spine documents with their count of blocks, none included."""
    counts = blocks.groupBy("book_id", "document_path").agg(F.count("*").alias("n"))
    return documents.where("position is not null").select("book_id", "position", "document_path").join(counts, ["book_id", "document_path"], "left").withColumn("blocks", F.coalesce("n", F.lit(0))).drop("n")


def suggest(tag: "F.Column") -> "F.Column":
    """A first decision by tag."""
    t = F.lower(tag)
    return F.when(t.rlike("^h[1-6]$"), "heading").otherwise(F.lit("paragraph"))


def decided(blocks: DataFrame, general: Mapping[str, str], per_document: Mapping[tuple[str, str], str] | None = None) -> DataFrame:
    """Adds kind: the decision for the pattern in its document, else the general one, else the suggestion."""
    for kind in {*general.values(), *(per_document or {}).values()}:
        if kind not in KINDS:
            raise ExtractionError(f"unknown decision {kind!r}")
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.lit(None).cast("map<string,string>")
    special = {f"{d}\0{p}": k for (d, p), k in (per_document or {}).items()}
    key = F.concat_ws("\0", "document_path", "pattern")
    out = blocks.withColumn("pattern", _pattern())
    return out.withColumn("kind", F.coalesce(as_map(special)[key], as_map(dict(general))[F.col("pattern")], suggest(F.col("tag"))))


def skipped(decisions: DataFrame) -> list[str]:
    """Locators of the blocks of one book that are skipped, in order, for build_recipe(); decisions as by decided()."""
    return [r["locator"] for r in decisions.where("kind = 'skip'").orderBy("seq").select("locator").collect()]


def build_recipe(
    sha256: str, identifier: str | None, patterns: list[tuple[str, list[str], str]], groups: Mapping[str, str], per_document: Sequence[tuple[str, str, list[str], str]] = (), skip: Sequence[str] | None = None
) -> dict:
    """A recipe from (tag, classes, kind) decisions and group codes by document path.

    per_document: (document, tag, classes, kind), which come before the general decisions. skip: locators of the blocks
    to leave out, see skipped(). Without it, elements of skipped patterns are left out by rules, which a document
    can't take back, so decisions for documents need it.
    """
    if per_document and skip is None:
        raise ExtractionError("decisions for documents need the locators of the skipped blocks")
    if unknown := sorted({d for d, *_ in per_document} - set(groups)):
        raise ExtractionError(f"a decision for {unknown[0]!r}, which has no group")
    rules, exclude = [], []
    order = lambda p: (-len(p[-2]), *p)
    for document, tag, classes, kind in [*sorted(per_document, key=order), *((None, *p) for p in sorted(patterns, key=order))]:
        match = {"tag": tag, "classes": classes} | ({"locators": [literal_glob(document) + "#*"]} if document else {})
        if kind not in KINDS:
            raise ExtractionError(f"unknown decision {kind!r}")
        if kind != "skip":
            rules.append({"match": match, "type": "line" if kind.startswith("line") else kind, "role": kind if kind.startswith("line") else "block"})
        elif skip is None:
            exclude.append({"match": match, "action": "skip"})
    return {
        "recipe_version": "1",
        "epub": {"sha256": sha256} | ({"identifier": identifier} if identifier else {}),
        "source_blocks": {"include_documents": [literal_glob(d) for d in groups], "element_rules": exclude, "include_non_linear": True},
        "output": {
            "groups": {"source_pattern": r"^s\d+:(.*)#", "source_map": dict(groups)},
            "identifiers": {"block": {"template": "{group}.{number:03d}"}, "line": {"template": "{group}.{block:03d}.{number:02d}"}},
            "default": {"type": "paragraph", "role": "block"},
            "rules": rules,
            "skip_source": list(skip or ()),
        },
    }


def save_session(state: dict) -> str:
    text = json.dumps({"version": 1} | state, ensure_ascii=False, sort_keys=True)
    if len(text.encode()) > SESSION_BYTES:
        raise ExtractionError("the session is too large")
    return text


def write_session(path: str, state: dict, seen: bytes | None = None) -> bytes:
    """Saves a session file whole or not at all; see saving.save_json."""
    return save_json(path, {"version": 1} | state, seen, SESSION_BYTES)


def load_session(text: str, sha256: str) -> dict:
    if len(text.encode()) > SESSION_BYTES:
        raise ExtractionError("the session is too large")
    state = json.loads(text)
    if state.get("version") != 1 or state.get("sha256") != sha256:
        raise ExtractionError("the session belongs to another version or book")
    return state


def preview(records: DataFrame, limit: int = 200) -> DataFrame:
    """The first records, after the check that all can be written."""
    return checked(records).orderBy("book_id", "seq").limit(limit)
