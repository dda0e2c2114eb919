"""Tells text from binary content by its first bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

SNIFFED = 512
# Byte signatures of the public MIME sniffing standard.
TEXT_TAGS = (b"<!DOCTYPE HTML", b"<HTML", b"<HEAD", b"<SCRIPT", b"<IFRAME", b"<H1", b"<DIV", b"<FONT", b"<TABLE", b"<A", b"<STYLE", b"<TITLE", b"<B", b"<BODY", b"<BR", b"<P", b"<!--")
BINARY_SIGNATURES = (b"%PDF-", b"%!PS-Adobe-", b"\x00\x00\x01\x00", b"\x00\x00\x02\x00", b"BM", b"GIF87a", b"GIF89a", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"OggS\x00", b"MThd\x00\x00\x00\x06", b"ID3", b"\x1aE\xdf\xa3", b"\x00\x01\x00\x00", b"OTTO", b"ttcf", b"wOFF", b"wOF2", b"\x1f\x8b\x08", b"PK\x03\x04", b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00", b"\x00asm")
CONTAINERS = ((b"RIFF", b"WAVE"), (b"RIFF", b"AVI "), (b"FORM", b"AIFF"))
TEXT_MARKS = (b"\xfe\xff", b"\xff\xfe", b"\xef\xbb\xbf")
SPACE = b"\t\n\x0c\r "
BINARY_BYTES = bytes([*range(0x00, 0x09), 0x0B, *range(0x0E, 0x1B), *range(0x1C, 0x20)])


def _is_mp4(head: bytes) -> bool:
    """Whether the first box is of type ftyp, of a size that it can have, and names an mp4 brand."""
    size = int.from_bytes(head[:4], "big")
    if len(head) < 12 or len(head) < size or size % 4 or head[4:8] != b"ftyp":
        return False
    return any(head[at : at + 3] == b"mp4" for at in range(8, size, 4) if at != 12)  # 12: a version number


def is_binary(head: bytes) -> bool:
    """Whether content that starts like this is binary; the empty one is text."""
    head = head[:SNIFFED]
    body = head.lstrip(SPACE)
    for tag in TEXT_TAGS:
        if body[: len(tag)].upper() == tag and body[len(tag) : len(tag) + 1] in (b" ", b">"):
            return False
    if body.startswith(b"<?xml") or head.startswith(TEXT_MARKS):
        return False
    if head.startswith(BINARY_SIGNATURES) or (head[:4], head[8:12]) in CONTAINERS or (head[:4] == b"RIFF" and head[8:14] == b"WEBPVP") or _is_mp4(head):
        return True
    return any(b in BINARY_BYTES for b in head)


@F.pandas_udf(BooleanType())
def _is_binary(head: pd.Series) -> pd.Series:
    return head.map(lambda h: is_binary(bytes(h or b"")))


def binary(content):
    """A column: whether a binary column's content is binary; only its head reaches Python."""
    return _is_binary(F.substring(content, 1, SNIFFED))
