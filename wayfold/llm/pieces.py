"""SentencePiece models split into pieces of text that encode independently.

``PieceModel.parts`` cuts a text before every run of spaces and before every
line feed.  The cut is exact if no vocabulary string has a space mark after
another character and none of several characters has a line feed: then no merge
crosses a cut, so the parts' tokens in a row are the text's tokens.  Both facts
are proved when the model is loaded; a model without them (or with a
normalisation map, user-defined symbols or other white-space rules) is served
by the library on whole texts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

SPACE = "▁"
NORMAL, USER_DEFINED = 1, 4
_PARTS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")


class Remembered(dict):
    """Values of parts, made in one call for all that a text lacks.

    Back to the first entries once it has ``most``: a worker's memory is bounded.
    """

    def __init__(self, make: Callable[[list[str]], list], first: dict | None = None, most: int = 300_000):
        super().__init__(first or {})
        self.make, self.first, self.most = make, dict(first or {}), most

    def of(self, parts: list[str]) -> list:
        found = list(map(self.get, parts))
        if None not in found:
            return found
        lacking = list({p for p, f in zip(parts, found, strict=True) if f is None})
        if len(self) + len(lacking) > self.most:
            self.clear()
            self.update(self.first)
            lacking = [p for p in set(parts) if p not in self]
        self.update(zip(lacking, self.make(lacking), strict=True))
        return list(map(self.__getitem__, parts))


class PieceModel:
    """A SentencePiece model with what its file says about normalisation."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:  # a file of the tokenizer package on this machine, not an input
            proto.ParseFromString(f.read())
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.spec = proto.normalizer_spec
        self.strings = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        lone = self.processor.piece_to_id(SPACE)
        self.splits = (
            not self.spec.precompiled_charsmap
            and self.spec.add_dummy_prefix
            and self.spec.escape_whitespaces
            and not self.spec.remove_extra_whitespaces
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and USER_DEFINED not in self.types
            and self.strings[lone] == SPACE
            and not any(SPACE in s.lstrip(SPACE) or "\n" in s and len(s) > 1 for s, t in zip(self.strings, self.types, strict=True) if t == NORMAL)
        )
        self.lone = lone
        self.opens = [s[:1] == SPACE or s in ("\n", "<0x0A>") for s in self.strings]

    def whole_tokens(self) -> dict[str, int]:
        """Parts (without their first space mark) that are a vocabulary string and encode as just it."""
        words = [(i, s[1:]) for i, (s, t) in enumerate(zip(self.strings, self.types, strict=True)) if t == NORMAL and s[:1] == SPACE and len(s) > 1]
        found = self.processor.encode([w for _, w in words], num_threads=1)
        return {w: i for (i, w), ids in zip(words, found, strict=True) if ids == [i]} | {"": self.lone}

    def parts(self, text: str) -> list[str]:
        """The parts of ``text``, each without its first space mark; line parts keep their line feed."""
        if not text:
            return []
        if SPACE in text or "  " in text or " \n" in text or text[0] == " " or text[-1] == " ":
            marked = SPACE + text.replace(" ", SPACE)
            return [p[1:] if p[0] == SPACE else p for p in _PARTS.findall(marked)]
        return text.replace("\n", " \n").split(" ")

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part; the library adds the first space mark itself.

        Parts go through the library together: exactly the first piece of each
        begins with the space mark or is the line feed's byte.
        """
        plain = [p for p in parts if p and p[0] != "\n" and SPACE not in p]
        lines = [p for p in parts if p[:1] == "\n"]
        ids = self.processor.encode(" ".join(["a", *plain]) + "".join(lines))
        starts = [at for at, i in enumerate(ids) if self.opens[i]]
        found = {p: ids[a:b] for p, a, b in zip(plain + lines, starts[1:], [*starts[2:], len(ids)], strict=False)}
        if len(starts) != len(plain) + len(lines) + 1:
            raise ValueError("parts don't encode independently")
        for p in parts:
            if p not in found:
                found[p] = self.processor.encode(p) if p else [self.lone]
        return [found[p] for p in parts]


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)
