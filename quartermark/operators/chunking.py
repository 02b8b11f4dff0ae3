"""Documents to tagged, overlapping chunks: an Arrow table function over whole documents."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from .. import schemas
from ..config import DEFAULT
from ..functions.text import SECTIONS

# The line forms and role words that structure a document.
TABLE_LINE = re.compile(r"^\s*\|.*\|\s*$")
TABLE_RULE = re.compile(r"^\s*\|[\s:\-|]+\|\s*$")
HEADING = re.compile(r"^\s{0,3}#{1,6}\s+(.+?)\s*$")
SPEAKER = re.compile(r"^([A-Z][a-zA-Z \t\-]{2,40})[ \t]*[:\-–][ \t]*(.*)$", re.M)
NOT_SPEAKERS = re.compile(r"^(operator|moderator|presentation|conference|unidentified|unknown)", re.I)
ROLES = re.compile(
    r"\b(CEO|Chief Executive|CFO|Chief Financial|COO|Chief Operating|CTO|Chief Technology|Chairman|President|EVP|SVP|"
    r"Executive Vice President|Senior Vice President)\b", re.I)  # fmt: skip
SECTION_RULES = tuple((re.compile(p, re.I), name) for p, name in SECTIONS)
#: For lower-cased texts: a section's rule, and words of which one is in any text that it matches.
SECTION_WORDS = (("prepared remark", "opening remark", "management discussion"), ("question", "q&a"), ("financial result", "financial highlight", "revenue", "earnings per share", "net income"),
                 ("guidance", "outlook", "forecast", "expect"), ("risk",), ("strateg", "long", "roadmap", "priorities"), ("market", "industry", "macro", "economic environment", "sector"))
LOWER_RULES = tuple((re.compile(p), name, words) for (p, name), words in zip(SECTIONS, SECTION_WORDS, strict=True))
#: Characters beyond A-Z that match a letter a to z when case is ignored.
ODD_CASE = re.compile("[\u0130\u0131\u017f\u212a]")
ROLE_REACH = 200
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def section_of(text: str) -> str:
    if not text.isascii() and ODD_CASE.search(text):
        return next((name for rule, name in SECTION_RULES if rule.search(text)), "unknown")
    low = text.lower()
    return next((name for rule, name, words in LOWER_RULES if any(w in low for w in words) and rule.search(low)), "unknown")


def blocks(text: str):
    """(is_table, body, heading) runs of lines; a heading starts a new block."""
    runs: list[tuple[bool, str, list[str]]] = []
    heading = ""
    for line in text.splitlines():
        table = bool(TABLE_LINE.match(line) or TABLE_RULE.match(line))
        title = None if table else HEADING.match(line)
        if title:
            heading = title.group(1).strip()
        if title or not runs or runs[-1][0] != table:
            runs.append((table, heading, []))
        runs[-1][2].append(line)
    for table, under, lines in runs:
        if body := "\n".join(lines).strip():
            yield table, body, under


def table_parts(table: str, limit: int) -> list[str]:
    """Row groups of an oversized table, each under the table's header rows."""
    rows = [r for r in table.splitlines() if r.strip()]
    rule = next((i for i, r in enumerate(rows[:3]) if TABLE_RULE.match(r)), 0)
    header, body = rows[: rule + 1], rows[rule + 1:]
    if not body:
        return ["\n".join(rows)] if rows else []
    base, groups, size = sum(map(len, header)), [[]], 0
    for row in body:
        if groups[-1] and base + size + len(row) > limit:
            groups.append([])
            size = 0
        groups[-1].append(row)
        size += len(row)
    return ["\n".join(header + g) for g in groups]


def speakers(text: str):
    """(speaker, words, is_management); text before the first speaker has an empty one."""
    found = list(SPEAKER.finditer(text))
    starts = [m.start() for m in found] + [len(text)]
    if text[: starts[0]].strip():
        yield "", text[: starts[0]].strip() if found else text, False
    for m, end in zip(found, starts[1:], strict=True):
        name = m.group(1).strip()
        near = text[max(0, m.start() - ROLE_REACH): m.start() + ROLE_REACH]
        yield name, text[m.start(): end].strip(), not NOT_SPEAKERS.match(name) and bool(ROLES.search(near))


def pack_sentences(text: str, size: int, overlap: int, least: int) -> list[str]:
    """Greedy packing of sentences; a chunk begins with the sentences before it that fit the overlap."""
    out: list[str] = []
    held: list[str] = []
    whole = 0
    for sentence in SENTENCE_END.split(text.strip()):
        if held and whole + len(sentence) > size:
            out.append(" ".join(held))
            keep, total = len(held), 0
            while keep and total + len(held[keep - 1]) < overlap:
                keep -= 1
                total += len(held[keep])
            held, whole = held[keep:], total
        held.append(sentence)
        whole += len(sentence)
    if held:
        out.append(" ".join(held))
    return [c for c in out if len(c.strip()) > least]


def chunks_of(doc_id: str, title: str, text: str, config=DEFAULT):
    """Chunk rows of one document: (id, section, speaker, is_management, text, char_start, title)."""
    at = 0
    for table, body, heading in blocks(text[: config.doc_max_chars]):
        tagged = f"{heading}\n" if heading else ""
        pieces = []
        if table:
            section = section_of(f"{heading}\n{body}")
            parts = [body] if len(body) <= config.max_table_chars else table_parts(body, config.max_table_chars)
            name = f"{title} — {heading}"[:200] if heading else title
            pieces = [(p.strip(), section, "", True, name) for p in parts if len(p.strip()) > config.min_chunk_chars]
        else:
            for speaker, words, management in speakers(body):
                section = section_of(tagged + words)
                pieces += [(c, section, speaker, management, title) for c in pack_sentences(words, config.chunk_size, config.chunk_overlap, config.min_chunk_chars)]
        for piece, section, speaker, management, name in pieces:
            key = hashlib.md5(f"{doc_id}::{at}::{piece[:40]}".encode()).hexdigest()[:16]
            yield key, section, speaker, management, piece, at, name
            at += len(piece)


def chunk_documents(docs: DataFrame, config=DEFAULT) -> DataFrame:
    """The chunks of documents under the declared chunk schema."""
    carried = ["doc_id", "ticker", "company", "doc_type", "quarter", "fiscal_year", "event_date", "source_url"]

    def run(batches):
        import pyarrow as pa

        order = [f.split()[0] for f in schemas.CHUNK.split(", ")]
        made = ("chunk_id", "section", "speaker", "is_management", "text", "char_start", "title")
        kinds = {"char_start": pa.int32(), "is_management": pa.bool_()}
        carried_kinds = {"fiscal_year": pa.int32(), "event_date": pa.timestamp("us")}
        for batch in batches:
            rows, of = [], []
            for i, (doc_id, title, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "title", "raw_text")], strict=True)):
                rows += chunks_of(doc_id, title or "", text or "", config)
                of += [i] * (len(rows) - len(of))
            if rows:
                columns = {c: pa.array(v, kinds.get(c, pa.string())) for c, v in zip(made, zip(*rows, strict=True), strict=True)}
                columns |= {c: batch.column(c).take(pa.array(of, pa.int32())).cast(carried_kinds.get(c, pa.string())) for c in carried}
                yield pa.RecordBatch.from_arrays([columns[c] for c in order], names=order)

    return docs.select(*carried, "title", "raw_text").mapInArrow(run, schemas.CHUNK)
