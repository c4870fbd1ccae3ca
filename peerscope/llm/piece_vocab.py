"""Byte-pair models in the sentencepiece library's file format: the parts of the message that encoding needs."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

# Fixed values of the file format: field numbers, model kinds and piece kinds.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
MODEL_KIND, SUFFIX_SPACE, BYTE_FALLBACK = 3, 24, 35
CHARSMAP, DUMMY_PREFIX, TRIM, ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        part = data[at]
        at += 1
        value |= (part & 127) << shift
        shift += 7
        if part < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message: integers, or the bytes of everything else."""
    at = 0
    while at < len(data):
        tag, at = number(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = number(data, at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                size, at = number(data, at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


@dataclass(frozen=True)
class Pieces:
    texts: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool


def load(path: str) -> Pieces:
    """The pieces of a BPE model with byte fallback that leaves texts as they are but for the space mark.

    Other kinds of model (unigram, normalising, with user-defined or unused pieces) raise ValueError.
    """
    texts, scores, kinds = [], [], []
    trainer: dict = {}
    normal: dict = {}
    with open(path, "rb") as f:
        for field, value in fields(f.read()):
            if field == PIECES:
                part = dict(fields(value))
                texts.append(part[PIECE].decode())
                scores.append(struct.unpack("<f", part[SCORE])[0] if SCORE in part else 0.0)
                kinds.append(part.get(KIND, NORMAL))
            elif field == TRAINER:
                trainer = dict(fields(value))
            elif field == NORMALIZER:
                normal = dict(fields(value))
    plain = not normal.get(CHARSMAP) and not normal.get(TRIM, 1) and normal.get(ESCAPE, 1) and not trainer.get(SUFFIX_SPACE, 0)
    if trainer.get(MODEL_KIND) != BPE or not trainer.get(BYTE_FALLBACK) or not plain or {*kinds} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE models with byte fallback and without normalisation or user-defined pieces")
    return Pieces(texts, scores, kinds, bool(normal.get(DUMMY_PREFIX, 1)))
