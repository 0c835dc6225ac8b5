"""JSON and text output."""

from __future__ import annotations

import json

from lodestone.engine import IndexResponse, Request, Response, Result
from lodestone.functions.text import summarize
from lodestone.sources.store import Stats

SCHEMA_VERSION = "1"
_HTML = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", chr(0x2028): "\\u2028", chr(0x2029): "\\u2029"}


def _string(s: str) -> str:
    out = json.dumps(s, ensure_ascii=False)
    for c, e in _HTML.items():
        out = out.replace(c, e)
    return out


def number(x: float) -> str:
    """The shortest decimal that reads back as x; whole numbers have no point, and exponents no padding."""
    if x == 0:
        return "-0" if str(x)[0] == "-" else "0"
    if 1e-6 <= abs(x) < 1e21:
        s = f"{x:f}" if float(f"{x:f}") == x else _plain(repr(x))
        return s.rstrip("0").rstrip(".") if "." in s else s
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        mantissa, _, exponent = f"{x:e}".partition("e")
    mantissa = mantissa.rstrip("0").rstrip(".") if "." in mantissa else mantissa
    return f"{mantissa}e{exponent[0] if exponent[0] in '+-' else '+'}{exponent.lstrip('+-').lstrip('0') or '0'}"


def _plain(s: str) -> str:
    from decimal import Decimal

    return format(Decimal(s), "f")


def dumps(value, indent: int = 0) -> str:
    """Indented JSON: dicts in their own order, markup characters escaped."""
    pad = "  " * (indent + 1)
    if isinstance(value, dict):
        if not value:
            return "{}"
        return "{\n" + ",\n".join(f"{pad}{_string(k)}: {dumps(v, indent + 1)}" for k, v in value.items()) + "\n" + "  " * indent + "}"
    if isinstance(value, list):
        if not value:
            return "[]"
        return "[\n" + ",\n".join(pad + dumps(v, indent + 1) for v in value) + "\n" + "  " * indent + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, float):
        return number(value)
    return _string(value) if isinstance(value, str) else str(value)


def _sorted(payload: dict) -> dict:
    return {k: payload[k] for k in sorted(payload)}


def stats_dict(s: Stats) -> dict:
    return {"schemaVersion": s.schema_version, "runs": s.runs, "documents": s.documents, "chunks": s.chunks, "embeddings": s.embeddings}


def index_json(r: IndexResponse) -> str:
    return dumps(_sorted({
        "schemaVersion": SCHEMA_VERSION, "command": "index", "status": r.status, "incremental": r.incremental, "rebuild": r.rebuild, "dbPath": r.db_path,
        "embedding": {"provider": r.embedding_name, "source": r.embedding_source, "written": r.embedding_writes},
        "inputFolder": r.input_folder, "metadataPath": r.metadata_path, "pageCount": r.page_count, "checkedFiles": r.checked_files,
        "documents": {"deleted": r.deleted, "inserted": r.inserted, "skipped": r.skipped, "updated": r.updated},
        "chunkWrites": r.chunk_writes, "runId": r.run_id, "dbStats": stats_dict(r.db_stats),
    }))


def index_text(r: IndexResponse) -> str:
    s = r.db_stats
    return "\n".join([
        f"index preflight passed: {r.page_count} pages, {r.checked_files} markdown files validated", f"db path: {r.db_path}", f"run id: {r.run_id}",
        f"schema version: {s.schema_version}", f"runs recorded: {s.runs}", f"documents inserted: {r.inserted}", f"documents updated: {r.updated}",
        f"documents skipped: {r.skipped}", f"documents deleted: {r.deleted}", f"chunks written: {r.chunk_writes}",
        f"embeddings written: {r.embedding_writes} ({r.embedding_name}; source={r.embedding_source})",
        "mode: full rebuild" if r.rebuild else "mode: incremental (default)",
    ])


def request_dict(r: Request) -> dict:
    """The request as it was given, before defaults."""
    f = r.filters
    return {
        "Text": r.text, "Mode": r.mode, "Fusion": r.fusion, "Alpha": float(r.alpha), "RRFK": r.rrf_k, "TopK": r.top_k, "Offset": r.offset, "Limit": r.limit, "CandidateK": r.candidate_k, "Expand": r.expand,
        "Filters": {"SpaceKey": f.space_key, "PageID": f.page_id, "FromDate": f.from_date, "ToDate": f.to_date, "Candidate": f.candidate},
    }


def result_dict(r: Result) -> dict:
    """Context fields that are empty or 0 are left out, so a window from chunk 0 has no start."""
    out = {
        "rank": r.rank, "chunkId": r.chunk_id, "documentId": r.document_id, "pageId": r.page_id, "title": r.title, "localPath": r.local_path, "spaceKey": r.space_key, "sourceUrl": r.source_url,
        "chunkText": r.chunk_text, "baseChunkText": r.base_chunk_text, "chunkIndex": r.chunk_index, "contextStartIndex": r.context_start, "contextEndIndex": r.context_end, "contextChunkCount": r.context_count,
        "lexicalScore": float(r.lexical), "vectorScore": float(r.vector), "fusedScore": float(r.fused), "fusion": r.fusion,
    }
    return {k: v for k, v in out.items() if v or not k.startswith(("context", "base"))}


def explain(results: list[Result], request: Request) -> list[str]:
    name = request.mode if request.mode in ("lexical", "vector") else request.fusion
    out = [f"mode={request.mode}", f"fusion={name}", f"alpha={request.alpha:.2f}", f"rrf-k={request.rrf_k}", f"expand={request.expand}", f"returned={len(results)}"]
    if results:
        best = results[0]
        out.append(f"top chunk={best.chunk_id} fused={best.fused:.4f} lexical={best.lexical:.4f} vector={best.vector:.4f}")
        if name == "weighted":
            out.append(f"top weighted-components lex={request.alpha * best.lexical:.4f} vec={(1 - request.alpha) * best.vector:.4f}")
        if best.context_count > 0:
            out.append(f"top context-range={best.context_start}..{best.context_end} ({best.context_count} chunks)")
        if len(results) > 1:
            order = sorted((r.fused for r in results), reverse=True)
            out.append(f"top gap={order[0] - order[1]:.4f}")
    return out


def query_json(path: str, request: Request, response: Response, with_explain: bool = False) -> str:
    payload = {
        "schemaVersion": SCHEMA_VERSION, "command": "query", "dbPath": path, "request": request_dict(request), "count": len(response.results), "total": response.total,
        "results": [result_dict(r) for r in response.results] or None, "pagination": {"limit": request.limit, "offset": request.offset},
    }
    if with_explain:
        payload["explain"] = explain(response.results, request)
    return dumps(_sorted(payload))


def query_text(request: Request, response: Response, with_explain: bool = False) -> str:
    if not response.results:
        return "no results"
    out = []
    for r in response.results:
        out += [f"{r.rank}. [{r.page_id}] {r.title} (chunk {r.chunk_index})", f"   score={r.fused:.4f} lexical={r.lexical:.4f} vector={r.vector:.4f} fusion={r.fusion}"]
        if r.context_count > 0:
            out.append(f"   context-range={r.context_start}..{r.context_end} ({r.context_count} chunks)")
        out += [f"   path={r.local_path}", f"   text={summarize(r.chunk_text, 240)}"]
    if with_explain:
        out += ["", "explain:", *(f"- {line}" for line in explain(response.results, request))]
    return "\n".join(out)


def stats_json(path: str, s: Stats) -> str:
    return dumps(_sorted({"schemaVersion": SCHEMA_VERSION, "command": "stats", "dbPath": path, "stats": stats_dict(s)}))


def stats_text(path: str, s: Stats) -> str:
    return f"db path: {path}\nschema version: {s.schema_version}\nruns: {s.runs}\ndocuments: {s.documents}\nchunks: {s.chunks}\nembeddings: {s.embeddings}"


