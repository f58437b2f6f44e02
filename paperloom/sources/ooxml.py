"""Reading of zip-packaged office files: parts, relationships, content types, and the structure of a document body."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.flat_map import flat_map

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
OFFICE_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Attributes that point to a relationship, in the order in which an element's references count.
REFERENCES = tuple(f"{{{OFFICE_REL}}}{a}" for a in ("id", "embed", "link", "dm", "lo", "qs", "cs"))


def local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def parse(xml: bytes | None) -> ET.Element | None:
    """The root, or None where the part is absent or no XML."""
    try:
        return ET.fromstring(xml) if xml else None
    except ET.ParseError:
        return None


#: What reading of a damaged, encrypted or unsupported package raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError)


def unreadable(e: Exception) -> str:
    return f"Input is not a readable DOCX zip package: {e}"


def read_zip(data: bytes | None, wanted: str | None = None) -> tuple[dict[str, bytes], str | None]:
    """Parts by name (those whose name the pattern finds), and what was wrong with the package."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            return {n: z.read(n) for n in z.namelist() if not n.endswith("/") and (not wanted or re.search(wanted, n))}, None
    except UNREADABLE as e:
        return {}, unreadable(e)


def resolve(owner_dir: str, target: str) -> str:
    """A target as a part name: fragments drop off, a leading slash is the package root, dots fold."""
    target = target.partition("#")[0]
    path = target.lstrip("/") if target.startswith("/") else posixpath.join(owner_dir, target)
    folded: list[str] = []
    for step in path.split("/"):
        if step == "..":
            folded = folded[:-1]
        elif step not in ("", "."):
            folded.append(step)
    return "/".join(folded)


def rels_part(owner: str) -> str:
    folder, name = posixpath.split(owner)
    return posixpath.join(folder, "_rels", f"{name}.rels")


def relationships(xml: bytes | None, owner: str) -> list[dict]:
    root = parse(xml)
    if root is None:
        return []
    out = []
    for e in root:
        rid, target = e.get("Id"), e.get("Target")
        if local(e.tag) == "Relationship" and rid and target:
            external = e.get("TargetMode") == "External"
            out.append({"rel_id": rid, "rel_type": e.get("Type", ""), "target": target, "external": external, "part": None if external else resolve(posixpath.dirname(owner), target)})
    return out


def references(element: ET.Element) -> list[str]:
    return [element.attrib[a] for a in REFERENCES if element.get(a)]


def content_types(xml: bytes | None) -> tuple[dict[str, str], dict[str, str]]:
    """Types by part, and by lower-case extension."""
    text = (xml or b"").decode("utf-8", "ignore")
    by_part = {p.lstrip("/"): t for p, t in re.findall(r'<Override\s[^>]*?PartName="([^"]+)"[^>]*?ContentType="([^"]+)"', text)}
    by_ext = {x.lower(): t for x, t in re.findall(r'<Default\s[^>]*?Extension="([^"]+)"[^>]*?ContentType="([^"]+)"', text)}
    return by_part, by_ext


def paragraph_text(p: ET.Element) -> str:
    return "".join(t.text or "" for t in p.iter(f"{{{WORD}}}t"))


def body_facts(xml: bytes | None) -> Iterator[dict]:
    """fact rows of a document body: 'order' (first appearance of a relationship), 'anchor' (first paragraph that refers to it),
    'preview' (an image inside a run that holds an embedded object)."""
    root = parse(xml)
    if root is None:
        return
    seen: dict[str, int] = {}
    for e in root.iter():
        for rid in references(e):
            seen.setdefault(rid, len(seen))
    for rid, k in seen.items():
        yield {"fact": "order", "rel_id": rid, "pos": k}
    anchored = set()
    for k, p in enumerate(root.iter(f"{{{WORD}}}p"), 1):
        for rid in (r for e in p.iter() for r in references(e)):
            if rid not in anchored:
                anchored.add(rid)
                yield {"fact": "anchor", "rel_id": rid, "pos": k, "text": paragraph_text(p).strip()}
    for run in root.iter(f"{{{WORD}}}r"):
        inside = list(run.iter())
        if any(local(e.tag) == "OLEObject" for e in inside):
            for e in inside:
                if local(e.tag) in ("blip", "imagedata", "binData"):
                    for rid in references(e):
                        yield {"fact": "preview", "rel_id": rid}


def scan(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """doc_id, content of each package under a folder; lock files (~$...) are skipped. Filters on path reach the file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.filter(~name.startswith("~$") & ~name.startswith("~%24")).select(F.col("path").alias("doc_id"), "content")


def parts(packages: DataFrame, wanted: str | None = None) -> DataFrame:
    """doc_id, part, ord (place in the archive), content; an unreadable package gives one row with a warning only."""

    def decode(row: dict):
        got, error = read_zip(row["content"], wanted)
        if error:
            yield {"doc_id": row["doc_id"], "warning": error}
        for k, (name, data) in enumerate(got.items()):
            yield {"doc_id": row["doc_id"], "part": name, "ord": k, "content": data}

    return flat_map(packages.select("doc_id", "content"), decode, "doc_id string, part string, ord int, content binary, warning string", flush=64)
