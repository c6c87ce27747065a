"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The vocabulary alone comes from the library. A text becomes units that no
vocabulary entry spans: a run of blanks with the letters after it, or a line
feed. The distinct units that a worker has not met yet are encoded together:
their symbols lie in one flat array, each round finds the least pair rank of
every unit, applies that merge at its places from the left in all units at once,
and compacts the arrays, until no pair is left.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from gridloom.llm.common import id_and_text, mapped
from gridloom.llm.merges import Memory, MergeRounds

BLANK = "▁"
#: Units whose ids a worker remembers at most, and the longest of them.
CACHED_UNITS, CACHED_CHARS = 500_000, 64
_UNITS = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+")
_WHOLE = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class PieceCoder:
    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if byte[i]}
        plain = {p: i for i, p in enumerate(pieces) if not special[i] and not byte[i]}
        if any(BLANK in p.lstrip(BLANK) for p in plain):
            raise ValueError("a vocabulary entry spans a blank")
        self.split_lines = not any("\n" in p and len(p) > 1 for p in plain)
        # Symbols: the entries, and single characters that only longer ones hold.
        self.symbol = dict(plain)
        for c in sorted({c for p in plain for c in p} - plain.keys()):
            self.symbol[c] = len(pieces) + len(self.symbol)
        scores = sorted({sp.get_score(i) for i in plain.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        rank = {p: order[sp.get_score(i)] for p, i in plain.items()}
        pair: dict[tuple[int, int], tuple[int, int]] = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                left, right = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if left is not None and right is not None:
                    pair[left, right] = (rank[p], i)
        self.rounds = MergeRounds(pair)
        # A character without a symbol is -1 minus its code point, and never merges.
        self.char_symbol = -1 - np.arange(0x110000, dtype=np.int64)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.char_symbol[ord(c)] = i
        self.spelling = [
            b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(BLANK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.known = Memory(CACHED_UNITS)

    # -- encoding

    def _encode_units(self, units: list[str]) -> list[bytes]:
        sizes = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols = self.char_symbol[codes]
        ids, n = self.rounds.merge(symbols, sizes)
        known = (ids >= 0) & (ids < len(self.spelling))
        ends = np.cumsum(n)
        if known.all():
            raw = ids.astype("<u4").tobytes()
            return [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        char_of = {v: k for k, v in self.symbol.items() if v >= len(self.spelling)}
        out = []
        for e, k in zip(ends.tolist(), n.tolist(), strict=True):
            own: list[int] = []
            for s in ids[e - k : e].tolist():
                if 0 <= s < len(self.spelling):
                    own.append(s)
                else:
                    own += [self.byte_id[b] for b in (char_of[s] if s >= 0 else chr(-1 - s)).encode()]
            out.append(np.array(own, dtype="<u4").tobytes())
        return out

    def units(self, text: str) -> list[str]:
        if text[0] == " " or "  " in text or BLANK in text or not self.split_lines:
            found = (_UNITS if self.split_lines else _WHOLE).findall(BLANK + text.replace(" ", BLANK))
            return [part for u in found for part in self._cut(u)]
        return (BLANK + text.replace(" ", " " + BLANK).replace("\n", " \n ")).split(" ")

    @staticmethod
    def _cut(unit: str) -> list[str]:
        """A long run of blanks in parts: its entries are 16 blanks at most."""
        word = unit.lstrip(BLANK)
        blanks = len(unit) - len(word)
        if blanks < 64:
            return [unit]
        blocks = (blanks - 33) // 16
        return [BLANK * 16] * blocks + [BLANK * (blanks - 16 * blocks) + word]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of texts without a blank or begin and end ids, little-endian; they are not remembered."""
        plain = [w for w in words if w and "\n" not in w and BLANK not in w]
        known = dict(zip(plain, self._encode_units([BLANK + w for w in plain]), strict=True)) if plain else {}
        rest = [w for w in words if w not in known]
        known.update(zip(rest, (x[4:-4] for x in self.encode_batch(rest)), strict=True) if rest else ())
        return list(map(known.__getitem__, words))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, begin and end ids included."""
        split = [self.units(t) if t else [] for t in texts]
        units = self.known.missing(set().union(*split) - {""})
        known = self.known.young
        known.update(zip(units, self._encode_units(units), strict=True) if units else ())
        known[""] = b""
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (self.bos, self.eos))
        out = [begin + b"".join(map(known.__getitem__, s)) + end for s in split]
        for u in units:
            if len(u) > CACHED_CHARS:
                del known[u]
        return out

    # -- decoding

    def decode(self, ids: bytes) -> str:
        """The text of little-endian ids; the blank put before a text goes."""
        raw = b"".join(map(self.spelling.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder_of(path: str) -> PieceCoder:
    """One coder for a worker, so that later tasks find its units known."""
    return PieceCoder(path)


def coded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the ids of each text as an array, and their text.

    A null text counts as empty and has the begin and end ids alone. Repeated
    rows come back as often; null ids are kept; other columns are ignored.
    """

    def run(texts: list[str | None]) -> dict[str, list]:
        coder = coder_of(model_path)
        ids = coder.encode_batch(texts)
        as_lists = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids]
        return {"ids": as_lists, "decoded": [coder.decode(x) for x in ids]}

    return mapped(id_and_text(docs, id_col, text_col), run, {"ids": "array<int>", "decoded": "string"})


def coded_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), as for ``coded``."""

    def run(texts: list[str | None]) -> dict[str, list]:
        coder = coder_of(model_path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        ids = coder.encode_batch(texts)
        return {
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [sha(x) for x in ids],
            "decoded_sha256": [sha(coder.decode(x).encode()) for x in ids],
        }

    schema = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return mapped(id_and_text(docs, id_col, text_col), run, schema)
