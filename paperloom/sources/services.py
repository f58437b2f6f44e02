"""Conversion services as parsers: a request a document, from the partition that holds it; any failure is a warning, never an error.

`services()` builds the parsers named in the environment: <NAME>_AUTHORIZATION turns one on, <NAME>_ENDPOINT says where it is and
<NAME>_REQUEST_TIMEOUT (seconds) how long to wait. The transport can be replaced, as tests do.
"""

from __future__ import annotations

import io
import json
import os
import posixpath
import re
import uuid
import zipfile
from collections.abc import Callable
from urllib import error, request

from pyspark.sql import DataFrame

from ..functions.flat_map import flat_map

Transport = Callable[[str, dict, bytes, float], tuple[bytes, str]]
_DOCUMENTS = "doc_id string, parser string, content string, warnings array<string>, images array<struct<path: string, content: binary>>"
FIELDS = {
    "mineru": {"lang_list": "ch", "parse_method": "auto", "formula_enable": "true", "table_enable": "true", "return_md": "true", "return_middle_json": "false", "return_content_list": "false", "return_images": "true", "response_format_zip": "true", "return_original_file": "false"},
    "docling": {"to_formats": ["md", "json"], "do_ocr": "true", "include_images": "true", "include_page_images": "true", "table_mode": "accurate", "image_export_mode": "referenced", "target_type": "zip"},
}
BACKENDS = {"mineru": "pipeline", "mineru-pipeline": "pipeline", "mineru-vlm-engine": "vlm-engine", "mineru-hybrid-engine": "hybrid-engine"}


def multipart(name: str, data: bytes, fields: dict) -> tuple[bytes, str]:
    """A form with these fields and one file; the body and its content type."""
    mark = f"loom{uuid.uuid4().hex}"
    parts = [(f'name="{k}"', "", x.encode()) for k, v in fields.items() for x in ([v] if isinstance(v, str) else v)]
    parts.append((f'name="files"; filename="{name}"', "Content-Type: application/octet-stream\r\n", data))
    body = b"".join(f"--{mark}\r\nContent-Disposition: form-data; {head}\r\n{kind}\r\n".encode() + x + b"\r\n" for head, kind, x in parts)
    return body + f"--{mark}--\r\n".encode(), f"multipart/form-data; boundary={mark}"


def post(url: str, headers: dict, body: bytes, timeout: float) -> tuple[bytes, str]:
    with request.urlopen(request.Request(url, body, headers, method="POST"), timeout=timeout) as r:
        return r.read(), r.headers.get("Content-Type") or ""


def safe_members(data: bytes) -> dict[str, bytes]:
    """Files of an archive by normalized path; ValueError where a path leaves the archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = {}
        for n in z.namelist():
            path = posixpath.normpath(n)
            if path.startswith(("/", "../")) or path == ".." or re.match("[A-Za-z]:", path):
                raise ValueError(f"unsafe zip member path: {n}")
            if not n.endswith("/"):
                out[path] = z.read(n)
        return out


def best_markdown(paths: list[str], stem: str) -> str | None:
    """The Markdown file named like the document, else the one least deep, else the first."""
    return min((p for p in paths if p.endswith(".md")), key=lambda p: (posixpath.splitext(posixpath.basename(p))[0] != stem, p.count("/"), p), default=None)


def _markdown(data: dict, stem: str) -> str:
    """The text of a JSON response; ValueError says why there is none."""
    results = data.get("results")
    if data.get("status") not in (None, "completed", "success"):
        raise ValueError(f"service returned {data['status']}: {json.dumps(data.get('errors', []), ensure_ascii=False)}")
    if isinstance(results, dict) and results:
        found = results.get(stem) if isinstance(results.get(stem), dict) else next(iter(results.values()))
    else:
        found = data.get("document")
    text = found.get("md_content") if isinstance(found, dict) else None
    if not isinstance(text, str) or not text.strip():
        raise ValueError("response did not include Markdown content")
    return text


def decode(raw: bytes, kind: str, stem: str) -> tuple[str, dict[str, bytes]]:
    """(Markdown, images by path relative to it) of a response, an archive or JSON."""
    if raw.startswith(b"PK\x03\x04") or "zip" in kind.lower():
        try:
            files = safe_members(raw)
        except (zipfile.BadZipFile, OSError) as e:
            raise ValueError(f"zip response could not be unpacked: {e}") from e
        best = best_markdown(list(files), stem)
        if best is None:
            raise ValueError("zip response did not include Markdown content")
        at = posixpath.dirname(best)
        own = {posixpath.relpath(p, at or "."): x for p, x in files.items() if not p.endswith((".md", ".json"))}
        return files[best].decode("utf-8", "replace").rstrip() + "\n", own
    try:
        data = json.loads(raw.decode("utf-8"))
    except ValueError as e:
        raise ValueError(f"service returned non-JSON response: {e}") from e
    return _markdown(data if isinstance(data, dict) else {}, stem).rstrip() + "\n", {}


def materialized(markdown: str, images: dict[str, bytes], parser: str) -> tuple[str, dict[str, bytes]]:
    """Relative links to files that came along point into the package; the files by their path there."""
    kept: dict[str, bytes] = {}

    def move(link: str) -> str:
        path = posixpath.normpath(link)
        if re.match(r"(?i)(https?://|data:|mailto:|#|/|[a-z]:[\\/]|\\\\)", link) or path not in images:
            return link
        kept[f"assets/images/{parser}/{path}"] = images[path]
        return f"assets/images/{parser}/{path}"

    markdown = re.sub(r"(!\[[^\]]*\]\()([^)]+)(\))", lambda m: m[1] + move(m[2]) + m[3], markdown)
    return re.sub(r'(<img\b[^>]*\bsrc=")([^"]+)(")', lambda m: m[1] + move(m[2]) + m[3], markdown), kept


def parser(name: str, url: str, authorization: str, fields: dict, timeout: float = 600, transport: Transport = post) -> Callable[[DataFrame], DataFrame]:
    def parse(packages: DataFrame) -> DataFrame:
        def convert(row: dict):
            file = posixpath.basename(row["doc_id"] or "document.docx")
            body, kind = multipart(file, row["content"] or b"", fields)
            out = {"doc_id": row["doc_id"], "parser": name, "content": "", "warnings": [], "images": []}
            try:
                raw, got = transport(url, {"Authorization": authorization, "Accept": "application/zip, application/json", "Content-Type": kind}, body, timeout)
                text, images = decode(raw, got, posixpath.splitext(file)[0])
                text, images = materialized(text, images, name)
                out |= {"content": text, "images": [{"path": p, "content": x} for p, x in images.items()]}
            except error.HTTPError as e:
                out["warnings"] = [f"{name} service returned HTTP {e.code}: {e.read().decode('utf-8', 'replace')[:1000]}"]
            except ValueError as e:
                out["warnings"] = [f"{name} {e}"]
            except OSError as e:
                out["warnings"] = [f"{name} service request failed: {e}"]
            yield out

        return flat_map(packages.select("doc_id", "content"), convert, _DOCUMENTS, flush=1)

    return parse


def services(env: dict[str, str] | None = None, transport: Transport = post) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Parsers by name of the services that the environment configures."""
    env = dict(os.environ) if env is None else env
    out = {}
    for name in (*BACKENDS, "docling"):
        base = name.partition("-")[0].upper()
        if env.get(f"{base}_AUTHORIZATION") and env.get(f"{base}_ENDPOINT"):
            fields = FIELDS[base.lower()] | ({"backend": env.get("MINERU_BACKEND") or BACKENDS[name]} if name in BACKENDS else {})
            out[name] = parser(name, env[f"{base}_ENDPOINT"], env[f"{base}_AUTHORIZATION"], fields, float(env.get(f"{base}_REQUEST_TIMEOUT") or (600 if name in BACKENDS else 240)), transport)
    return out
