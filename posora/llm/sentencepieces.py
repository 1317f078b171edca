"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from the model: the normaliser (white space mark
for spaces, a dummy prefix), the lexicon of pieces and byte fallback. The
lexicon is a deterministic automaton over characters; each of its states has
the arcs of the pieces that end there, longest first, and fallback is the arc
of a state without any. Composing it with an input is one step a character,
and the encoding is the shortest path in the tropical semiring: at each
position the least sum of the weights of the arcs that lead there.

For a unigram model a piece weighs its negative score. A merge (BPE) model
isn't decided by sums of scores; there the composition also passes an acceptor
over neighbouring pieces, which weighs nothing where merging the characters of
two pieces gives just them, and else infinitely much. Of such paths one is left
at each position (a prefix of an encoding is an encoding), so the first finite
arc is the least.

White space marks only begin pieces, so an input is cut before each run of them
and the path of each part is remembered, up to a bound in characters.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo

SPACE = "▁"
#: What a byte of fallback weighs: more than any path over pieces.
FALLBACK = 1e6


class Lexicon:
    """The automaton of a set of pieces. State 0 is the start; ``arcs[s]`` has (length, id) of each piece that ends there."""

    def __init__(self, ids: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.arcs: list[tuple[tuple[int, int], ...]] = [()]
        self.fail = [0]
        self.alphabet = set().union(*ids)
        for piece, k in ids.items():
            s = 0
            for c in piece:
                t = self.next[s].get(c)
                if t is None:
                    t = self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.arcs.append(())
                    self.fail.append(0)
                s = t
            self.arcs[s] = ((len(piece), k),)
        wave = list(self.next[0].values())
        while wave:  # by depth: a state's shorter endings are those of the longest other state that its text ends in
            deeper = []
            for s in wave:
                self.arcs[s] += self.arcs[self.fail[s]]
                for c, t in self.next[s].items():
                    at = self.fail[s]
                    while at and c not in self.next[at]:
                        at = self.fail[at]
                    self.fail[t] = self.next[at].get(c, 0)
                    deeper.append(t)
            wave = deeper

    def step(self, s: int, c: str) -> int:
        """The state after ``c``, kept so that the next time it is one look-up (unknown characters aren't kept)."""
        at = s
        while at and c not in self.next[at]:
            at = self.fail[at]
        t = self.next[at].get(c, 0)
        if c in self.alphabet:
            self.next[s][c] = t
        return t


class PieceTransducer:
    #: Bits of an id in the key of a pair.
    SHIFT = 24

    def __init__(self, path: str, limit: int = 3_000_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dummy, self.plain = norm.add_dummy_prefix, norm.name == "identity" and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        self.merges = model.trainer_spec.model_type == pb.TrainerSpec.BPE
        kinds = pb.ModelProto.SentencePiece
        self.unknown = model.trainer_spec.unk_id
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.score = [p.score for p in model.pieces]
        self.spelled = [p.piece for p in model.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.raw = [p.piece.encode("utf-8") for p in model.pieces]
        self.raw[self.unknown] = " ⁇ ".encode()
        for i, b in self.byte_of.items():
            self.raw[i] = bytes([b])
        self.weight = [1.0 if self.merges else -x for x in self.score]
        self.lexicon = Lexicon(self.ids)
        cut = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.parts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if cut else "(?s).+")
        self.grown: dict[int, tuple] = {}
        self.pairs = Memo(self._stand, 1_000_000)
        self.packed = [array("I", [i]).tobytes() for i in range(len(self.spelled))]
        self.length = [len(p) for p in self.spelled]
        self.paths = Memo(self._path, limit, size=len)

    def normalised(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        out = text.replace(" ", SPACE)
        return SPACE + out if self.dummy and out else out

    def _growth(self, k: int) -> tuple[list[float], list[str], list[str]] | None:
        """How the piece comes about by merging: what the next merge costs (its negative score), the
        leftmost and the rightmost symbol, before each merge and at the end. None if merging doesn't give it."""
        if k in self.grown:
            return self.grown[k]
        ids, score = self.ids, self.score
        symbols, costs, left, right = [*self.spelled[k]], [], [], []
        while len(symbols) > 1:
            best = min(((-score[m], i) for i in range(len(symbols) - 1) if (m := ids.get(symbols[i] + symbols[i + 1])) is not None), default=None)
            if best is None:
                break
            costs.append(best[0])
            left.append(symbols[0])
            right.append(symbols[-1])
            symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
        whole = len(symbols) == 1
        self.grown[k] = (([*costs, math.inf], [*left, symbols[0]], [*right, symbols[0]])) if whole else None
        return self.grown[k]

    def _stand(self, pair: int) -> bool:
        """Whether merging the characters of two pieces gives the two again.

        The two sides merge apart from each other, the cheaper merge first and of equals the left one, as
        long as no merge over the boundary is cheaper.
        """
        a, b = self._growth(pair >> self.SHIFT), self._growth(pair & (1 << self.SHIFT) - 1)
        if a is None or b is None:
            return False
        (costs, _, ends), (other, starts, _) = a, b
        ids, score, i, j = self.ids, self.score, 0, 0
        while True:
            over = ids.get(ends[i] + starts[j])
            if over is not None and -score[over] < costs[i] and -score[over] <= other[j]:
                return False
            if costs[i] <= other[j]:
                i += 1
            else:
                j += 1
            if i == len(costs) or j == len(other):
                return True

    def _fallback(self, c: str) -> bytes:
        """The ids of a character that no path over pieces reaches."""
        return array("I", (self.bytes[b] for b in c.encode("utf-8", "surrogatepass")) if self.bytes else (self.unknown,)).tobytes()

    def _path(self, part: str) -> bytes:
        """Ids on the shortest path of one part."""
        forward, arcs, step = self.lexicon.next, self.lexicon.arcs, self.lexicon.step
        pairs, weight, merges, shift = self.pairs, self.weight, self.merges, self.SHIFT
        # of each position: the least weight and the last piece (-1 after fallback and at the start)
        least, last = [0.0], [-1]
        s = i = 0
        for c in part:
            i += 1
            t = forward[s].get(c)
            s = step(s, c) if t is None else t
            cost, best = math.inf, -1
            for length, k in arcs[s]:
                if merges:  # the first finite one
                    if (before := last[i - length]) < 0 or pairs[before << shift | k]:
                        cost, best = least[i - length] + 1.0, k
                        break
                elif (other := least[i - length] + weight[k]) < cost:
                    cost, best = other, k
            least.append(cost if best >= 0 else least[-1] + FALLBACK * len(c.encode("utf-8", "surrogatepass")))
            last.append(best)
        packed, length, found = self.packed, self.length, []
        while i:
            k = last[i]
            if k >= 0:
                found.append(packed[k])
                i -= length[k]
            else:
                i -= 1
                found.append(self._fallback(part[i]))
        found.reverse()
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit values; none for null or empty text."""
        return b"".join(map(self.paths.__getitem__, self.parts.findall(self.normalised(text)))) if text else b""

    def decode(self, ids: bytes) -> str:
        """The text of ids: the machines run backward."""
        text = b"".join(map(self.raw.__getitem__, array("I", ids))).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy and text[:1] == " " else text


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_ids, n_fallback, ids_crc32, round_trip[, ids]) of each row.

    ``round_trip`` says that decoding gives the text back; it can't where the text itself
    holds the white space mark or invalid characters. Null text has no ids and trips
    to the empty text.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = transducer(model)
        low, high = (min(m.byte_of), max(m.byte_of)) if m.byte_of else (1, 0)
        for pdf in batches:
            ids = [m.encode(t) for t in pdf["_text"]]
            out = pd.DataFrame({
                "_id": pdf["_id"], "n_ids": [len(x) // 4 for x in ids], "n_fallback": [sum(low <= k <= high for k in array("I", x)) if _odd(t) else 0 for x, t in zip(ids, pdf["_text"], strict=True)],
                "ids_crc32": [zlib.crc32(x) for x in ids], "round_trip": [m.decode(x) == (t or "") for x, t in zip(ids, pdf["_text"], strict=True)],
            })
            if with_ids:
                out["ids"] = pd.Series(ids, out.index, object)
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {kind}, n_ids long, n_fallback long, ids_crc32 long, round_trip boolean" + ", ids binary" * with_ids
    return rows.mapInPandas(encode, schema).withColumnRenamed("_id", id_col)


def _odd(text: str | None) -> bool:
    """Whether bytes may be needed: any character that isn't printable ASCII."""
    return bool(text) and not (text.isascii() and text.isprintable())
