"""Encoding a text piece by piece with a bounded memory of the pieces' ids, for tokenizers with a pre-token pattern."""

from __future__ import annotations

from collections.abc import Callable

#: Pieces remembered per Python worker (some 250 bytes each), and the longest that is remembered. Only speed depends on them.
REMEMBERED = 1_500_000
REMEMBERED_LENGTH = 48
#: ASCII characters that are neither white space nor letters nor numbers.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Memory(dict):
    """Results by piece. When half of the room is used it becomes the older half; what is used of that stays."""

    def __init__(self, make: Callable[[str], bytes], room: int):
        super().__init__()
        self.make, self.half, self.older = make, room / 2, {}

    def __missing__(self, piece: str) -> bytes:
        made = self.older.get(piece)
        if made is None:
            made = self.make(piece)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[piece] = made
        return made


class _Inseparable(Exception):
    pass


class PieceEncoder:
    """Joined results of `encode_piece` for each match of `pattern` in a text.

    `splits_at_space` says three things of the pattern, wherever the text is cut. It never matches across the place before a space that
    a non-white-space character follows. A space and the letters after it, up to a mark or the end, are one match; so are MARKS
    between a letter and the end. A line feed between two other characters that are no white space is one match, and what follows it is
    matched like the beginning of a text. Then texts are cut at spaces first, which is fast, and cuts that are a word, with marks or
    without, are encoded without the pattern, which most new ones are; it is matched once for each different other cut.
    """

    def __init__(
        self, pattern: str, encode_piece: Callable[[str], bytes], remembered: int = REMEMBERED, splits_at_space: bool = False
    ):
        import regex

        self.find = regex.compile(pattern).findall
        self.space = regex.compile(r"\s").match
        self.encode_piece = encode_piece
        self.pieces = _Memory(encode_piece, remembered // 8)
        self.cuts = _Memory(self._cut, remembered * 7 // 8)
        self.splits_at_space = splits_at_space

    def _cut(self, cut: str) -> bytes:
        """What a space and `cut` give."""
        if cut.isalpha():
            return self.encode_piece(" " + cut)
        word = cut.rstrip(MARKS)
        if word.isalpha():
            return self.cuts[word] + self.pieces[cut[len(word) :]]
        if not cut or cut[0].isspace() or self.space(cut):
            raise _Inseparable
        line, feed, rest = cut.partition("\n")
        if rest and not (line[-1].isspace() or self.space(line[-1]) or rest[0].isspace() or self.space(rest[0])):
            return self.cuts[line] + self.pieces[feed] + (self.pieces[rest] if rest.isalpha() else self._whole(rest))
        return self._whole(" " + cut)

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        if self.splits_at_space:
            cuts = text.split(" ")
            first = self._whole(cuts[0])
            try:
                return first + b"".join(map(self.cuts.__getitem__, cuts[1:]))
            except _Inseparable:  # several white-space characters in a row somewhere
                pass
        return self._whole(text)
