"""Block views of flat tables: web pages, line-structured documents, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block of tag soup: an opening tag of a text block, then text and inline tags.
PAGE_BLOCK = r"<(h[1-6]|p|li|pre)(?:\s[^>]*)?>([^<]*(?:<(?:/?(?:a|b|i|em|strong|span)|br)(?:\s[^>]*)?>[^<]*)*)"


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, seq, tag, raw, text): text blocks of HTML that isn't well-formed, in order, tags removed."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(PAGE_BLOCK), F.lit(0))).alias("pos", "raw"))
    text = F.regexp_replace(F.regexp_replace("raw", r"<br(?:\s[^>]*)?>", "\n"), "<[^>]*>", "")
    return found.select("page_id", "url", (F.col("pos") + 1).cast("long").alias("seq"), F.regexp_extract("raw", "^<(h[1-6]|p|li|pre)", 1).alias("tag"), "raw", text.alias("text"))


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, seq, text): lines of each document, numbered from 0."""
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("doc_id", "source", "lang", F.col("pos").cast("long").alias("seq"), "text")


#: What isn't text between blocks: the contents of some elements, and tags.
BETWEEN = r"<(?:script|style|title)[^>]*>[^<]*|<[^>]*>"


def soup_nodes(html: str | None) -> list[dict]:
    """Nodes of tag soup: a body, its text blocks as children, inline elements inside them.

    Blocks are those of PAGE_BLOCK; text between them is their tails. An inline element that isn't closed ends with its
    block, a closing tag without an opening one is passed over. Character references stay as they are.
    """
    import re

    out: list[dict] = []

    def node(tag: str, parent: int, sib: int, attrs: str = "") -> dict:
        path = [*out[parent]["path"], sib] if parent >= 0 else []
        found = dict(re.findall(r'([\w:-]+)\s*=\s*"([^"]*)"', attrs))
        out.append({
            "pre": len(out), "post": len(out), "parent": parent, "sib": sib, "path": path, "element_path": ".".join(map(str, path)), "tag": tag, "attrs": list(found.items()),
            "classes": found.get("class", "").split(), "epub_types": found.get("epub:type", "").split(), "txt": "", "tail": "" if parent >= 0 else None,
        })
        return out[-1]

    html, at = html or "", 0
    body = node("body", -1, 0)
    last, count = None, 0
    for m in re.finditer(PAGE_BLOCK, html):
        gap = re.sub(BETWEEN, "", html[at : m.start()])
        if last is None:
            body["txt"] += gap
        else:
            last["tail"] += gap
        at, count = m.end(), count + 1
        head = re.match(r"<[^>]*>", m[0])[0]
        last = node(m[1], 0, count, head)
        open_, kids, place = [last], {last["pre"]: 0}, (last, "txt")
        for token in re.split(r"(<[^>]*>)", m[2]):
            name = re.match(r"</?([a-z]+)", token)
            if not name or not token.endswith(">"):
                place[0][place[1]] += token
            elif token[1] != "/":
                up = open_[-1]
                kids[up["pre"]] += 1
                new = node(name[1], up["pre"], kids[up["pre"]], token)
                kids[new["pre"]] = 0
                if name[1] == "br":
                    place = (new, "tail")
                else:
                    open_.append(new)
                    place = (new, "txt")
            elif any(x["tag"] == name[1] for x in open_[1:]):
                while open_[-1]["tag"] != name[1]:
                    open_.pop()
                place = (open_.pop(), "tail")
    gap = re.sub(BETWEEN, "", html[at:])
    if last is None:
        body["txt"] += gap
    else:
        last["tail"] += gap
    for n in reversed(out[1:]):
        up = out[n["parent"]]
        up["post"] = max(up["post"], n["post"])
    return out


#: Nodes that a Python worker holds at once, unless a single page has more.
NODES_A_BATCH = 4096


def page_documents(pages: DataFrame) -> DataFrame:
    """Web pages as documents with node tables, as packaged books are read: each page is a book of one document.

    Nodes leave a worker in batches of NODES_A_BATCH, whatever the number of pages in a batch that it gets.
    """
    from .books import DOCUMENT, _arrow_schema

    def parse(batches):
        import pyarrow as pa

        schema = _arrow_schema()
        base = {"sha256": None, "package_path": None, "identifiers": [], "position": 1, "properties": [], "linear": True, "error": None}
        for b in batches:
            rows, held = [], 0
            for k, h in zip(b["page_id"], b["html"]):
                found = soup_nodes(h.as_py())
                if rows and held + len(found) > NODES_A_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
                rows.append(base | {"book_id": str(k.as_py()), "document_path": f"page/{k.as_py()}", "nodes": found})
                held += len(found)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select("page_id", "html").mapInArrow(parse, DOCUMENT)


def line_documents(docs: DataFrame) -> DataFrame:
    """Documents as node tables with built-in functions only: a heading "Document <doc_id>", then a p for each line."""
    from .books import DOCUMENT

    kind = DOCUMENT[DOCUMENT.index("nodes ") + 6 :]
    lines = F.split("text", "\n")
    none, strings = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")

    def node(pre, post, parent, sib, path, tag, txt, tail):
        return F.struct(
            pre.cast("int").alias("pre"), post.cast("int").alias("post"), F.lit(parent).alias("parent"), sib.cast("int").alias("sib"), path.cast("array<int>").alias("path"), F.array_join(path.cast("array<string>"), ".").alias("element_path"),
            F.lit(tag).alias("tag"), none.alias("attrs"), strings.alias("classes"), strings.alias("epub_types"), txt.cast("string").alias("txt"), F.lit(tail).cast("string").alias("tail"),
        )

    zero, one = F.lit(0), F.lit(1)
    body = node(zero, F.size(lines) + 1, -1, zero, F.array(), "body", F.lit(None), None)
    head = node(one, one, 0, one, F.array(one), "h1", F.concat(F.lit("Document "), F.col("doc_id").cast("string")), "\n")
    rest = F.transform(lines, lambda x, i: node(i + 2, i + 2, 0, i + 2, F.array(i + 2), "p", x, "\n"))
    return docs.where("text is not null").select(
        F.col("doc_id").cast("string").alias("book_id"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("package_path"), strings.alias("identifiers"), one.alias("position"),
        F.lit("d").alias("document_path"), strings.alias("properties"), F.lit(True).alias("linear"), F.lit(None).cast("string").alias("error"), F.concat(F.array(body, head), rest).cast(kind).alias("nodes"),
    )
