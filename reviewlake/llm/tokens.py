"""Byte-level BPE ids of whole texts, by units cut where no match of the split pattern can span."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: The split pattern never joins a character that is not white space to a space behind it, so a text
#: may be cut before such a space and the parts encoded alone.
SAFE_SPACE = re.compile(r"(?<=\S) ")
UNSAFE_SPACE = r"\x00|(^|[\s\x1c-\x1f\x{85}\p{Z}]) "
#: A word of settled letters and the other marks behind it are separate matches of the pattern.
#: Letters of these ranges are letters in every Unicode version.
WORD_AND_MARKS = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<marks>[.,;:!?%&$#*|]+)$"
REMEMBERED_CHARS = 48
REMEMBERED = 220_000
#: Texts that are encoded joined at a time.
JOINED = 5_000
#: Marks of a text's first unit, of another unit that begins with a NUL, and of a word's marks.
FIRST, LATER, MARKS = "\0F", "\0L", "\0M"


def _marked(text: str) -> list[str]:
    first, *others = SAFE_SPACE.split(text)
    return [FIRST + first, *(LATER + u if u.startswith("\0") else u for u in others)]


class Memory:
    """A dictionary of bounded size: when ``limit`` entries are new, the ones before them go."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        found = list(map(self.new.get, keys))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            ids = self.old.get(keys[i])
            if ids is not None:
                found[i] = self.new[keys[i]] = ids
        return found

    def add(self, key: str, ids: bytes) -> None:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = ids


class UnitEncoder:
    """Ids of many texts at once, through their distinct units.

    ``encode_all`` is the library's encoder: ids of each of a list of strings, as bytes. Ids of short units
    are remembered, at most twice ``limit`` of them; the result does not depend on that.
    """

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], limit: int):
        self.encode_all = encode_all
        self.memory = Memory(limit)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (unsigned 32-bit) and the bounds of each text in them. Null: no ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # every unit stands for itself behind a space; a first unit has none and gets a mark
        parts = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), texts, pa.scalar("", pa.large_string())), " ")
        unsafe = pc.match_substring_regex(texts, UNSAFE_SPACE)
        if pc.any(unsafe).as_py():
            listed = [_marked(t) if bad else p for t, bad, p in zip(texts.to_pylist(), unsafe.to_pylist(), parts.to_pylist(), strict=True)]
            parts = pa.array(listed, pa.large_list(pa.large_string()))
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        # a unit is a word and the marks behind it, or one piece and no marks
        split = pc.extract_regex(coded.dictionary, WORD_AND_MARKS)
        heads = pc.coalesce(pc.struct_field(split, "word"), coded.dictionary).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(split, "marks"), "")
        tails = pc.binary_join_element_wise(pa.scalar(MARKS, pa.large_string()), marks, pa.scalar("", pa.large_string())).dictionary_encode()
        pieces = self._ids(heads.dictionary.to_pylist() + tails.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(pieces), dtype="<u4")
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        index = coded.indices.to_numpy()
        piece = np.empty(2 * len(index), dtype=np.int64)
        piece[0::2] = heads.indices.to_numpy()[index]
        piece[1::2] = tails.indices.to_numpy()[index] + len(heads.dictionary)
        counts = sizes[piece]
        ends = np.concatenate([[0], np.cumsum(counts)])
        take = np.repeat((np.cumsum(sizes) - sizes)[piece] - ends[:-1], counts) + np.arange(ends[-1])
        return ids[take], ends[2 * bounds]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        found = self.memory.find(pieces)
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self.encode_all([_text(pieces[i]) for i in missing]), strict=True):
            found[i] = ids
            if len(pieces[i]) <= REMEMBERED_CHARS and not pieces[i].startswith((FIRST, LATER)):
                self.memory.add(pieces[i], ids)
        return found


def _text(piece: str) -> str:
    """What a piece stands for in its text."""
    if piece[:1] != "\0":
        return " " + piece
    return " " + piece[2:] if piece.startswith(LATER) else piece[2:]


@lru_cache(maxsize=2)
def library_encoder(path: str, remembered: int = REMEMBERED) -> UnitEncoder:
    """Encoder over the tokenizers library; one per Python worker. Special strings are plain text. At most twice
    ``remembered`` units keep their ids, some 250 bytes each."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    spaced = np.zeros(tokenizer.get_vocab_size(), dtype=bool)  # ids whose bytes begin with a space
    spaced[[i for token, i in tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True

    def ids_of(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_all(texts: list[str]) -> list[bytes]:
        """Texts that hold one space, in front, are encoded joined, which costs half as much."""
        joint = [i for i, t in enumerate(texts) if t[:1] == " " and " " not in t[1:] and len(t) > 1 and not (t[1].isspace() or t[-1].isspace())]
        out: list[bytes | None] = [None] * len(texts)
        for k in range(0, len(joint), JOINED):
            some = joint[k : k + JOINED]
            (ids,) = ids_of(["".join(texts[i] for i in some)])
            starts = (4 * np.flatnonzero(spaced[np.frombuffer(ids, "<u4")])).tolist()
            if len(starts) != len(some):
                raise RuntimeError("a joined text was not cut at its spaces")
            for i, a, b in zip(some, starts, [*starts[1:], len(ids)], strict=True):
                out[i] = ids[a:b]
        alone = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(alone, ids_of([texts[i] for i in alone]), strict=True):
            out[i] = ids
        return out

    return UnitEncoder(encode_all, remembered)


def highest_id(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values(), default=0)


@lru_cache(maxsize=2)
def rank_encoding(path: str):
    """The tiktoken encoding of a local rank file; one per Python worker."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
