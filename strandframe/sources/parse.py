"""Parsing of sequence files, line by line."""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

FORMATS = ("fasta", "fastq")
#: First bytes of a gzip member.
GZIP_MAGIC = b"\x1f\x8b"


def guess_format(text: str) -> str:
    """fasta or fastq by which of > and @ comes first, unknown without either."""
    fa, fq = text.find(">"), text.find("@")
    if fa < 0 and fq < 0:
        return "unknown"
    return "fasta" if fq < 0 or 0 <= fa < fq else "fastq"


def open_text(raw: bytes | BinaryIO) -> io.TextIOBase:
    """Lines of a file's bytes, or of a file that is read as lines are asked for; gzip is known by its first bytes, whatever the name."""
    stream = io.BufferedReader(io.BytesIO(raw) if isinstance(raw, bytes) else raw)
    data = gzip.GzipFile(fileobj=stream) if stream.peek(2)[:2] == GZIP_MAGIC else stream
    return io.TextIOWrapper(data, encoding="utf-8", errors="replace", newline="\n")


def _lines(lines: Iterable[str]) -> Iterator[str]:
    """Without line ends, and without blank lines."""
    for line in lines:
        line = line.removesuffix("\n").removesuffix("\r")
        if line:
            yield line


def split_header(line: str) -> tuple[str, str]:
    """Name and comment of a header line without its mark: the name ends at the first space."""
    name, _, comment = line.replace("\r", "").replace("\t", "").partition(" ")
    return name, comment


Want = Callable[[str, str], bool]


def read_fasta(lines: Iterable[str], want: Want | None = None) -> Iterator[tuple[str, str, str]]:
    """Name, comment, sequence. What comes before the first > is left out; a record may have an empty sequence. want is asked
    once for each header, in order; the lines of a record that it refuses are passed over."""
    header: tuple[str, str] | None = None
    parts: list[str] = []
    for line in _lines(lines):
        if line[0] == ">":
            if header is not None:
                yield *header, "".join(parts)
            header, parts = split_header(line[1:]), []
            if want is not None and not want(*header):
                header = None
        elif header is not None:
            parts.append(line)
    if header is not None:
        yield *header, "".join(parts)


def read_fastq(lines: Iterable[str], want: Want | None = None) -> Iterator[tuple[str, str, str, str]]:
    """Name, comment, sequence, quality. The quality has as many characters as the sequence, so its lines may start with @.
    want is asked as by read_fasta(); of a record that it refuses only lengths are looked at."""
    header: tuple[str, str] | None = None
    seq: list[str] = []
    qual: list[str] = []
    state, need = "header", 0
    for line in _lines(lines):
        if state == "quality" and need > 0:
            need -= len(line)
            if header is not None:
                qual.append(line)
            continue
        if state == "sequence":
            if line[0] == "+":
                state = "quality"
                continue
            need += len(line)
            if header is not None:
                seq.append(line)
            continue
        if line[0] == "@":
            if header is not None:
                yield *header, "".join(seq), "".join(qual)
            header, seq, qual, state, need = split_header(line[1:]), [], [], "sequence", 0
            if want is not None and not want(*header):
                header = None
    if header is not None:
        yield *header, "".join(seq), "".join(qual)


def records(raw: bytes | BinaryIO, form: str = "auto", want: Want | None = None, forms: Callable[[str], bool] | None = None) -> Iterator[tuple[str, str, str, str, str | None]]:
    """Format, name, comment, sequence, quality of each record. A form that the file isn't of is an error, as is a file
    without a mark if it isn't empty. want chooses records by name and comment, forms files by what they are."""
    text = open_text(raw)
    lines: Iterable[str] = text
    head: list[str] = []
    found = "unknown"
    for line in lines:
        head.append(line)
        if (found := guess_format(line)) != "unknown":
            break
    if found == "unknown":
        if any(h.strip() for h in head):
            raise ValueError("neither > nor @ in the file: not a sequence file")
        return
    if form not in ("auto", found):
        raise ValueError(f"the file is {found}, not {form}")
    if forms is not None and not forms(found):
        return
    rest = (x for part in (head, lines) for x in part)
    if found == "fasta":
        yield from (("fasta", *r, None) for r in read_fasta(rest, want))
    else:
        yield from (("fastq", *r) for r in read_fastq(rest, want))
