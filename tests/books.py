"""Small packaged books for tests."""

import hashlib
import zipfile

CONTAINER = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def page(body: str) -> str:
    return f'<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>t</title></head><body>{body}</body></html>'


def book(path, docs: dict[str, str], non_linear=(), identifiers=("book-1",), extra=(), raw=None) -> str:
    items = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate([*docs, *dict(extra)]))
    refs = "".join(f'<itemref idref="i{i}"{" linear=" + chr(34) + "no" + chr(34) if n in non_linear else ""}/>' for i, n in enumerate(docs))
    ids = "".join(f"<dc:identifier>{x}</dc:identifier>" for x in identifiers)
    opf = f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" version="3.0"><metadata>{ids}</metadata><manifest>{items}</manifest><spine>{refs}</spine></package>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("content.opf", opf)
        for n, b in {**docs, **dict(extra)}.items():
            z.writestr(n, b if raw and n in raw else page(b))
    return hashlib.sha256(open(path, "rb").read()).hexdigest()


def recipe(sha: str, **output) -> dict:
    base = {"identifiers": {"block": {"template": "{number:03d}"}, "line": {"template": "{block:03d}.{number:02d}"}}, "default": {"type": "paragraph", "role": "block"}}
    return {"recipe_version": "1", "epub": {"identifier": "book-1", "sha256": sha}, "omit_epub_types": ["noteref", "pagebreak"], "output": base | output}
