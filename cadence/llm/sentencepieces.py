"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda.

The agenda takes the adjacent pair whose joined piece scores best, leftmost among equals, until no
pair joins to a piece. Pieces of such vocabularies never cross certain boundaries (proved from the
vocabulary when the model is loaded), so a text is cut there and each distinct unit is merged once.
Every merged unit, and one whole text of every slice, is compared with the sentencepiece library; a
difference raises.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._bpe import PairAgenda
from cadence.llm._common import slices, texts_of, tokenizer_path

SPACE = "▁"
#: Distinct units that a worker remembers.
REMEMBERED = 400_000


class Mismatch(RuntimeError):
    """The agenda and the sentencepiece library differ."""


class Pieces:
    """A merge-type sentencepiece model: encodes and decodes whole texts."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback, a dummy prefix and no other normalisation are supported")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
        self.texts = [p.piece for p in model.pieces]
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.byte_of[i] = int(p.piece[3:5], 16)
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(SPACE, " ").encode() for i, t in enumerate(self.texts)]
        self.shown = [None if i in self.byte_of else t.replace(SPACE, " ") for i, t in enumerate(self.texts)]
        self.names = [str(i) for i in range(len(self.texts))]
        # symbols: ids of pieces, then characters of pieces that are none themselves, then any other character
        self.symbol = {p: i for p, (i, _) in normal.items()}
        for p in normal:
            for c in p:
                self.symbol.setdefault(c, len(self.texts) + len(self.symbol))
        self.other = max(self.symbol.values()) + 1
        rank = {s: k for k, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        pairs = [(self.symbol[p[:k]], self.symbol[p[k:]], rank[s], i) for p, (i, s) in normal.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        self.agenda = PairAgenda(*map(np.array, zip(*pairs)))
        inside = {c for p in normal if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece has a space inside")
        # no piece has a space after another character, or a character that is in no longer piece: cut there
        apart = "".join(c for c in map(chr, range(1, 128)) if c not in inside and c != " ")
        apart = re.escape(apart)
        self.units = re.compile(rf"[{apart}]|{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" if apart else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.points = np.full(0x110000, self.other, np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.points[ord(c)] = i
        #: Of known units: their ids joined by commas, and what these decode to.
        self.ids_of: dict[str, str] = {}
        self.back_of: dict[str, str] = {}

    def merge(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        flat, left = self.agenda.merge(self.points[points], sizes)
        out, at, plain = [], 0, flat < len(self.texts)
        ids = flat.tolist()
        ends = np.cumsum(left).tolist()
        odd = {i for i in np.repeat(np.arange(len(units)), left)[~plain].tolist()}
        for i, (unit, end) in enumerate(zip(units, ends)):
            own = ids[at:end]
            out.append(self._with_bytes(unit, own) if i in odd else own)
            at = end
        return out

    def _with_bytes(self, unit: str, symbols: list[int]) -> list[int]:
        """Characters outside the vocabulary as the ids of their bytes."""
        out, at = [], 0
        for s in symbols:
            n = len(self.texts[s]) if s < len(self.texts) else 1
            out += [s] if s < len(self.texts) else [self.byte_ids[b] for b in unit[at : at + n].encode("utf-8")]
            at += n
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts first."""
        text = self._join(ids)
        return text[1:] if text.startswith(" ") else text

    def _join(self, ids: list[int]) -> str:
        parts = [self.shown[i] for i in ids]
        if None not in parts:
            return "".join(parts)
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")

    def learn(self, units: set[str], check: bool) -> None:
        if len(self.ids_of) > REMEMBERED:
            self.ids_of, self.back_of = {}, {}
        new = sorted(units - self.ids_of.keys(), key=len)  # of like length, as they are merged
        if not new:
            return
        ids = self.merge(new)
        if check:
            self._verify(new, ids)
        names = self.names
        self.ids_of.update(zip(new, [",".join([names[i] for i in own]) for own in ids]))
        self.back_of.update(zip(new, map(self._join, ids)))

    def _verify(self, units: list[str], ids: list[list[int]]) -> None:
        """Compare with the library. A unit without a leading space can't be given to it alone: "\n" before it cuts as the text does."""
        spaced = [i for i, u in enumerate(units) if u[0] == SPACE and u != SPACE]
        others = [i for i, u in enumerate(units) if u[0] != SPACE]
        own = [ids[i] for i in spaced]
        theirs = self.library.encode([units[i][1:].replace(SPACE, " ") for i in spaced], num_threads=1)
        if others:
            skip = len(self.head)
            own += [ids[i] for i in others]
            theirs += [x[skip:] for x in self.library.encode(["\n" + units[i] for i in others], num_threads=1)]
        if own != theirs:
            i, a, b = next((i, a, b) for i, a, b in zip(spaced + others, own, theirs) if a != b)
            raise Mismatch(f"{units[i]!r}: {a} and {b}")

    @property
    def head(self) -> list[int]:
        return self.library.encode("\n")

    def texts_to_units(self, texts: list[str]) -> list[list[str]]:
        find = self.units.findall
        return [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]

    def run(self, texts: list[str], check: bool = True) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        cut = self.texts_to_units(texts)
        units: set[str] = set()
        for u in cut:
            units.update(u)
        self.learn(units, check)
        ids_of, back_of = self.ids_of.__getitem__, self.back_of.__getitem__
        whole = False
        for text, own in zip(texts, cut):
            ids, back = ",".join(map(ids_of, own)), "".join(map(back_of, own))
            n = ids.count(",") + 1 if ids else 0
            back = back[1:] if back.startswith(" ") else back
            if check and not whole and text:
                theirs = self.library.encode(text)
                if ids != ",".join(map(str, theirs)) or back != self.library.decode(theirs):
                    raise Mismatch(f"{text[:80]!r}")
                whole = True
            yield n, ids, back


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode_decode(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", check: bool = True, full: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; with full also ids and decoded.

    No begin or end ids, no sampling. A null or empty text has no ids and decodes to the empty text.
    Repeated rows, ties and null ids keep one row each; an empty table gives none; other columns are
    not read. One narrow pass, no shuffle; memory is bounded by a slice of texts and the unit cache.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(tokenizer_path(model))
        for batch in slices(batches):
            n, ids, back = zip(*pieces.run(texts_of(batch), check))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in back])]
            if full:
                columns += [pa.array([list(map(int, x.split(","))) if x else [] for x in ids], pa.list_(pa.int32())), pa.array(back)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full)
    return out.withColumnRenamed("id", id_col)
