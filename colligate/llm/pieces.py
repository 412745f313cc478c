"""SentencePiece encoding and decoding as shortest paths of a weighted transducer.

A model is compiled to three transducers over the tropical semiring (weights add up along a path, the least
sum wins). The *normaliser* has a state for the start of a text, one inside it, and one for blanks that may
have to go; its arcs read a character and write the normalised ones (a blank as the meta symbol, one more in front where
the model asks for it). The *pieces* have one state per piece: an arc reads the characters of a piece and
leads to that piece's state. Its weight depends on the model's kind. Of a byte-pair model it is one, or infinite where
the merges would have joined something across the border of the two pieces before they are complete;
of a unigram model it is the piece's negative score. The *byte fallback* reads a character without a piece
and writes its UTF-8 bytes' pieces, or the unknown piece.

Each input is composed with the three, and the least weight and the arc that gives it are kept for each
place. Merges leave one state with a finite weight at each place, and a unigram's weights don't depend on the state, so one
arc per place is the whole result.

Where no piece goes across the border of two words, or of a word and other characters,
an input splits into independent parts; paths of the last parts seen are kept.

Defined results: a null text counts as empty and has no piece; texts of any length are
encoded whole; of paths with equal weights that with the longer last piece wins; ids that decode to bytes that aren't UTF-8 give U+FFFD; ids outside the
model raise; other columns are ignored. Models with a table of character mappings, and unigram models with
pieces defined by the user, are refused.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.llm.common import slices, table, text_column

BLANK = "▁"
INFINITE = float("inf")
#: Words whose paths, and arcs whose weights, a task keeps at once.
KEPT_WORDS, KEPT_ARCS = 600_000, 600_000
_FIGURES = "²³¹¼½¾"
#: Where an input splits, finest first: words and runs of other characters, each with the
#: blanks (@) in front; or what lies between blanks; or nowhere.
_SPLITS = [
    rf"[@]*[^\W\d_{_FIGURES}]+|[@]*(?:[\d_{_FIGURES}]|[^\w@])+|[@]+",
    "[@]*[^@]+|[@]+",
    "(?s:.+)",
]
START, TEXT, GAP = range(3)


class Normaliser:
    """The normaliser's arcs: (state, whether a blank is read) -> (what is written, whether the character
    itself follows, the next state)."""

    def __init__(self, prefix: bool, squeeze: bool) -> None:
        front = BLANK if prefix else ""
        self.arcs = {(START, False): (front, True, TEXT), (TEXT, False): ("", True, TEXT)}
        if squeeze:  # blanks in front and at the end go, others become one
            self.arcs |= {(START, True): ("", False, START), (TEXT, True): ("", False, GAP), (GAP, True): ("", False, GAP), (GAP, False): (BLANK, True, TEXT)}
        else:
            self.arcs |= {(START, True): (front + BLANK, False, TEXT), (TEXT, True): (BLANK, False, TEXT)}

    def compose(self, text: str, state: int) -> str:
        """What the arcs write for an input that begins in ``state``."""
        out, arcs = "", self.arcs
        for ch in text:
            written, itself, state = arcs[state, ch == " " or ch == BLANK]
            out += written + ch if itself else written
        return out


class Transducer:
    """A byte-pair or unigram model, compiled from a model file or its bytes."""

    def __init__(self, model: str | bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        proto.ParseFromString(model)
        kind, rules = proto.SentencePiece.Type, proto.normalizer_spec
        self.merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        if not self.merges and (proto.trainer_spec.model_type != proto.trainer_spec.UNIGRAM or any(p.type == kind.USER_DEFINED for p in proto.pieces)):
            raise ValueError("only byte-pair models, and unigram ones without pieces of the user, are compiled")
        if rules.precompiled_charsmap or not rules.escape_whitespaces:
            raise ValueError("only models without a table of character mappings are compiled")
        self.prefix = rules.add_dummy_prefix
        self.normaliser = Normaliser(rules.add_dummy_prefix, rules.remove_extra_whitespaces)
        self.text = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.hidden = {i for i, p in enumerate(proto.pieces) if p.type in (kind.CONTROL, kind.UNUSED)}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN)
        # what each id shows; None is a byte of a longer character
        self.shown: list[str | None] = [p.replace(BLANK, " ") for p in self.text]
        for b, i in self.byte.items():
            self.shown[i] = chr(b) if b < 0x80 else None
        for i in self.hidden:
            self.shown[i] = ""
        self.shown[self.unknown] = " ⁇ "
        # the finest split that no piece goes across; in a text, a blank is either character
        whole = lambda split: all(re.fullmatch(split, p) and len(re.findall(split, p)) == 1 for p in self.id)
        self.split = re.compile(next(x for x in _SPLITS if whole(x.replace("@", BLANK))).replace("@", f" {BLANK}"))
        self.words: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.known: dict[str, dict[str, float]] = {}  # weights of arcs by state
        self.n_known = 0
        # what a character without a piece weighs, in a unigram model
        self.lost = 10 - min(self.score.values(), default=0.0)
        # pieces in the order in which merges prefer them, and the two parts of each
        order = sorted((p for p in self.score if len(p) > 1), key=lambda p: (-self.score[p], self.id[p]))
        self.rank = {p: i for i, p in enumerate(order)}
        self.parts = {p: last for p in order if (last := self.last_merge(p))} if self.merges else dict.fromkeys(order)
        #: What an arc of the transducer may read (pieces that the merges make, and any character) is
        #: true here, what only ends such a piece is false.
        own = {*self.parts, *(p for p in self.id if len(p) == 1)}
        self.arcs = {p[i:]: False for p in own for i in range(len(p))} | dict.fromkeys(own, True)

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the merges join last to make a piece of its own
        characters, best rank first and the leftmost of equal ones; None if they don't."""
        symbols, last = list(piece), None
        while len(symbols) > 1:
            ranks = [self.rank.get(a + b, len(self.rank)) for a, b in zip(symbols, symbols[1:], strict=False)]
            best = min(ranks)
            if best == len(self.rank):
                return None
            at = ranks.index(best)
            last = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = [last[0] + last[1]]
        return last

    def finite(self, left: str, right: str) -> bool:
        """Whether the arc from one piece to the next has a finite weight: whether no
        merge across their border comes before those that complete them. The later of
        the two last merges is undone, as long as there is one; what then meets at the
        border must not have had a better merge. Of equal merges the left one comes first."""
        rank, parts, limit = self.rank, self.parts, len(self.rank)
        while True:
            across = rank.get(left + right, limit)
            if across < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a > b:
                left, limit = parts[left][1], a
            elif b >= 0:
                right, limit = parts[right][0], b + 1
            else:
                return True

    def weight(self, left: str, piece: str) -> float:
        """The weight of the arc that reads ``piece`` in the state of ``left``, which is empty at the start."""
        if not self.merges:
            return -self.score[piece] if piece in self.score else self.lost
        if left and not self.finite(left, piece):
            return INFINITE
        return 1.0 if piece in self.id else float(len(piece.encode("utf-8", "replace")))

    def extend(self, last: list[str], least: list[float], word: str) -> None:
        """``least`` has the least weight of a path to each of the word's first places, ``last`` the piece
        that such a path reads last; the others are added."""
        arcs, known = self.arcs, self.known
        for end in range(len(last), len(word) + 1):
            best, chosen = INFINITE, ""
            for start in range(end - 1, -1, -1):
                piece = word[start:end]
                readable = arcs.get(piece)
                if readable or start == end - 1:
                    state = last[start]
                    try:
                        weight = known[state][piece] + least[start]
                    except KeyError:
                        weight = known.setdefault(state, {})[piece] = self.weight(state, piece)
                        self.n_known += 1
                        weight += least[start]
                    if weight < best or weight == best < INFINITE:  # the longer piece
                        best, chosen = weight, piece
                if readable is None:
                    break  # nothing longer ends like this
            last.append(chosen)
            least.append(best)

    def ids_of(self, last: list[str]) -> bytes:
        """The ids along the shortest path to the last place."""
        pieces, end = [], len(last) - 1
        while end:
            pieces.append(last[end])
            end -= len(last[end])
        ids: list[int] = []
        for piece in reversed(pieces):
            own = self.id.get(piece)
            if own is not None:
                ids.append(own)
            elif self.byte:
                ids += [self.byte[b] for b in piece.encode("utf-8", "replace")]
            else:
                ids.append(self.unknown)
        return array("I", ids).tobytes()

    def learn(self, words: set[str], known: dict[str, bytes], state: int) -> None:
        """Composes the words, which begin in a state of the normaliser; in order, so that one starts where
        it parts from the one before."""
        if len(known) > KEPT_WORDS:
            known.clear()
        if self.n_known > KEPT_ARCS:
            self.known.clear()
            self.n_known = 0
        new = sorted((self.normaliser.compose(w, state), w) for w in words.difference(known))
        before, last, least = "", [""], [0.0]
        for word, raw in new:
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], least[shared + 1 :]
            self.extend(last, least, word)
            known[raw] = self.ids_of(last)
            before = word

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.split.findall(t) for t in texts]
        self.learn({own[0] for own in split if own}, self.first, START)
        self.learn({w for own in split for w in own[1:]}, self.words, TEXT)
        of_first, of_rest, out = self.first.__getitem__, self.words.__getitem__, []
        for own in split:
            found = np.frombuffer(b"".join([of_first(own[0]), *map(of_rest, own[1:])]) if own else b"", "<u4")
            if not self.byte and len(found):  # runs of unknown characters are one piece
                unknown = found == self.unknown
                found = found[~(unknown & np.append(False, unknown[:-1]))]
            out.append(found)
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: the transducer read from its output side."""
        ids = [int(i) for i in ids] if isinstance(ids, list) else ids.tolist()
        shown = [self.shown[i] for i in ids]
        if None in shown:  # bytes of characters beyond ASCII, runs of which are read together
            at = 0
            while at < len(shown):
                end = at
                while end < len(shown) and shown[end] is None:
                    end += 1
                if end > at:
                    raw = bytes(self.of_byte[i] for i in ids[at:end])
                    shown[at:end] = [_bytes_to_text(raw), *[""] * (end - at - 1)]
                at = end + 1
        text = "".join(shown)
        first = next((i for i in ids if i not in self.hidden), None)
        return text[1:] if self.prefix and first is not None and self.text[first].startswith(BLANK) else text


def _bytes_to_text(raw: bytes) -> str:
    """UTF-8, with one U+FFFD for each byte that isn't part of a character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.cache
def transducer(model_file: str | None = None) -> Transducer:
    import public_tokenizers

    return Transducer(model_file or public_tokenizers.path("piece_bpe_32k.model"))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, with_ids: bool = True) -> DataFrame:
    """(id, n_pieces, ids_crc32, round_trip, ids) of every row: whether decoding gives the text again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for part in slices(batches, "_text", 2 << 20):
            texts = part.column("_text").to_pylist()
            found = machine.encode_all(texts)
            columns = [
                part.column("_id"),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([zlib.crc32(f.tobytes()) for f in found], pa.int64()),
                pa.array([machine.decode(f) == t for f, t in zip(found, texts, strict=True)], pa.bool_()),
            ]
            names = ["_id", "n_pieces", "ids_crc32", "round_trip"]
            if with_ids:
                columns.append(pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(F.col(id_col).alias("_id"), text_column(text_col).alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<long>" * with_ids
    return rows.mapInArrow(work, schema).withColumnRenamed("_id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_file: str | None = None) -> DataFrame:
    """(id, text) of every row (id, ids)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], names=["_id", "text"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<long>").alias("_ids"))
    return rows.mapInArrow(work, f"_id {rows.schema['_id'].dataType.simpleString()}, text string").withColumnRenamed("_id", id_col)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
