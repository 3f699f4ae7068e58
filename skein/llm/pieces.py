"""Exact encoding and decoding with merge-type SentencePiece models.

The library merges the best-scored adjacent pair, leftmost first, until no pair is left. Here no merge is
carried out over a text. A sequence of pieces is what merging yields just if each adjacent pair is what
merging yields for the two alone: the merges on the two sides of a border do not depend on what lies
further off, so the first merge across a border would happen for the two pieces alone as well. A prefix of
a text therefore has one encoding, and a backtracking search finds it: take the longest piece at a
position, go to shorter ones while the piece does not go with the one before it, and mark a position as
failed once nothing that starts there goes with its one encoding.

All matches come from one pass of an Aho-Corasick automaton over the chunk. Whether two pieces go together
is decided by re-merging them: the order of merges inside each piece is fixed, so the two orders are
interleaved by score, and a merge across the border that comes up first parts them.

Texts are cut where no piece can reach across: before white space, and around characters that no piece
has, which become byte pieces. Short chunks are remembered, a bounded number of them.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.llm.common import quoted, small_batches

SPACE = "▁"
#: Entries of the memories of a task: encoded chunks of up to CHUNK characters, and pairs of pieces.
CHUNKS, CHUNK, PAIRS = 1 << 17, 40, 1 << 18
_NONE = float("-inf")


class Trace:
    """The merges inside a piece: their scores in order, and the outer symbols before and after each."""

    def __init__(self, piece: str, score: dict[str, float]):
        parts, self.scores = list(piece), []
        self.left, self.right = [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = max((score.get(a + b, _NONE), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == _NONE:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            self.scores.append(best)
            self.left.append(parts[0])
            self.right.append(parts[-1])
        self.whole = len(parts) == 1


class Surfaces:
    """What decoding needs of a model: the text of each id, and the byte of a byte piece."""

    def __init__(self, model: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.spec = spec = proto.ModelProto()
        with open(model, "rb") as f:
            spec.ParseFromString(f.read())
        kind = proto.ModelProto.SentencePiece.Type
        self.types = types = [kind.Name(p.type) for p in spec.pieces]
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback")
        if "USER_DEFINED" in types or "UNUSED" in types or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined and unused pieces and white space at the end are not supported")
        self.bos, self.eos = spec.trainer_spec.bos_id, spec.trainer_spec.eos_id
        self.byte = {i: int(p.piece[1:-1], 16) for i, p in enumerate(spec.pieces) if types[i] == "BYTE"}  # <0x0A>
        self.bytes = {b: i for i, b in self.byte.items()}
        shown = {"NORMAL": lambda p: p.replace(SPACE, " "), "UNKNOWN": lambda p: spec.trainer_spec.unk_surface}
        self.surface = [shown[t](p.piece) if t in shown else "" for p, t in zip(spec.pieces, types)]
        rules = spec.normalizer_spec
        self.strips, self.strips_all = rules.add_dummy_prefix or rules.remove_extra_whitespaces, rules.remove_extra_whitespaces

    def decode(self, ids: array) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD one by one."""
        surface, byte, types = self.surface, self.byte, self.types
        out: list[str] = []
        raw = bytearray()
        begin, dropped = True, False  # before any text; the space before the text is gone
        for i in ids:
            if i in byte:
                raw.append(byte[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            shown = surface[i]
            if begin:
                begin = not (dropped or out)
                if begin and self.strips and types[i] == "NORMAL" and shown.startswith(" "):
                    shown, dropped = shown[1:], not self.strips_all
            if shown:
                out.append(shown)
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out)


class Pieces(Surfaces):
    """A model's pieces with what the search needs: matches, shorter pieces, and merges by score."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        super().__init__(model)
        self.normalize = sentencepiece.SentencePieceProcessor(model_file=model).normalize
        normal = [(i, p) for i, p in enumerate(self.spec.pieces) if self.types[i] == "NORMAL"]
        self.ids, self.score = {p.piece: i for i, p in normal}, {p.piece: p.score for _, p in normal}
        # Characters that only occur inside pieces take part in merges too, and end as bytes.
        alphabet = {c for p in self.ids for c in p}
        self.names = list(self.ids) + sorted(alphabet - self.ids.keys())
        self.numbers = {p: i for i, p in enumerate(self.names)}
        self.lengths = [len(p) for p in self.names]
        self.shorter = [next((self.numbers[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.numbers), -1) for p in self.names]
        self.spelled = [(self.ids[p],) if p in self.ids else tuple(self.bytes[b] for b in p.encode()) for p in self.names]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.numbers.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        group = "".join(c for c in (SPACE, "\n", "\t", "\r") if not any(c in p.lstrip(c) for p in self.ids))
        self.cut = re.compile(f"[{group}]+[^{group}]*|[^{group}]+" if group else r"(?s).+").findall
        known = "".join(map(re.escape, sorted(alphabet)))
        self.runs = re.compile(f"([{known}]+)|(?s:.)").finditer
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.traces: dict[int, Trace] = {}
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def trace(self, n: int) -> Trace:
        t = self.traces.get(n)
        if t is None:
            t = self.traces[n] = Trace(self.names[n], self.score)
        return t

    def _remerge(self, a: int, b: int) -> bool:
        first, second, score = self.trace(a), self.trace(b), self.score
        if not (first.whole and second.whole):
            return False
        i = j = 0
        while True:
            across = score.get(first.right[i] + second.left[j], _NONE)
            one = first.scores[i] if i < len(first.scores) else _NONE
            two = second.scores[j] if j < len(second.scores) else _NONE
            if across > one and across >= two:  # of equal scores the leftmost is merged first
                return False
            if one == two == _NONE:
                return True
            if one >= two:
                i += 1
            else:
                j += 1

    def together(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' text yields just these two."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[a * len(self.names) + b] = self._remerge(a, b)
        return known

    def search(self, run: str) -> list[int]:
        """The pieces of a run of known characters, by number."""
        size, longest = len(run), [-1] * len(run)
        lengths, shorter, together, known, span = self.lengths, self.shorter, self.together, self.pairs, len(self.names)
        for end, n in self.automaton.iter(run):
            longest[end + 1 - lengths[n]] = n  # matches come by their end, so the last one is the longest
        failed = bytearray(size // 8 + 1)
        out: list[int] = []
        at, n = 0, longest[0]
        while at < size:
            while n >= 0:
                end = at + lengths[n]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not out:
                        if self.trace(n).whole:
                            break
                    else:
                        fits = known.get(out[-1] * span + n)
                        if together(out[-1], n) if fits is None else fits:
                            break
                n = shorter[n]
            if n >= 0:
                out.append(n)
                at = end
                n = longest[at] if at < size else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                n = out.pop()
                at -= lengths[n]
        return out

    def _encode(self, chunk: str) -> bytes:
        out = array("I")
        for m in self.runs(chunk):
            if m.lastindex:
                for n in self.search(m.group()):
                    out.extend(self.spelled[n])
            else:
                out.extend(self.bytes[b] for b in m.group().encode())
        return out.tobytes()

    def chunk(self, chunk: str) -> bytes:
        """The ids of a chunk that the younger memory lacks."""
        if len(chunk) > CHUNK:
            return self._encode(chunk)
        ids = self.older.get(chunk)
        if ids is None:
            # A last character that no piece has after the one before it, such as a full stop, stands alone.
            if len(chunk) > 1 and chunk[-2:] not in self.neighbours:
                ids = (self.chunks.get(chunk[:-1]) or self.chunk(chunk[:-1])) + (self.chunks.get(chunk[-1]) or self.chunk(chunk[-1]))
            else:
                ids = self._encode(chunk)
        if len(self.chunks) >= CHUNKS:
            self.older = dict(self.chunks)
            self.chunks.clear()
        self.chunks[chunk] = ids
        return ids

    def encode(self, text: str, begin: bool = True, end: bool = True) -> bytes:
        """Ids as unsigned 32-bit integers of this machine's byte order."""
        known, new = self.chunks.get, self.chunk
        ids = [known(c) or new(c) for c in self.cut(self.normalize(text))] if text else []
        return b"".join([array("I", [self.bos]).tobytes() if begin else b"", *ids, array("I", [self.eos]).tobytes() if end else b""])


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in (4, 3, 2, 1):
            try:
                c = raw[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                out.append(c)
                at += n
                break
        else:
            out.append("�")
            at += 1
    return "".join(out)


def of_worker(kind: type[Surfaces], model: str) -> Surfaces:
    """The pieces of a model with all they remember, kept by a Python worker from task to task.

    They sit in a module of the worker's, since this one comes anew with the functions of each task.
    """
    name = f"_pieces_of_worker_{kind.__name__}"
    kept = sys.modules.setdefault(name, ModuleType(name)).__dict__
    if kept.get("model") != model:
        kept.update(model=model, pieces=kind(model))
    return kept["pieces"]


def _little(raw: bytes) -> bytes:
    if sys.byteorder == "little":
        return raw
    a = array("I", raw)
    a.byteswap()
    return a.tobytes()


def encode(docs: DataFrame, model: str, out: str = "ids", text: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """Add ``out``, the ids of each whole text as binary: little-endian unsigned 32-bit integers.

    ``model`` is the path of the model file on every executor. A null text is taken as empty; an empty
    one has the begin and end ids alone. Repeated rows are encoded alike, an empty table stays empty,
    and other columns pass through (one named ``out`` is replaced).
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = of_worker(Pieces, model)
        for texts in batches:
            yield pa.array([_little(pieces.encode(t or "", begin, end)) for t in texts.to_pylist()], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return small_batches(docs).withColumn(out, F.arrow_udf(run, "binary").asNondeterministic()(quoted(text)))


def decode(docs: DataFrame, model: str, out: str = "decoded", ids: str = "ids") -> DataFrame:
    """Add ``out``, the text of the ids that ``encode`` gives (null ids: null; none: the empty text).

    Begin and end ids show nothing, and the space that encoding puts before a text goes again.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = of_worker(Surfaces, model)
        for rows in batches:
            yield pa.array([None if r is None else pieces.decode(array("I", _little(r))) for r in rows.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return small_batches(docs).withColumn(out, F.arrow_udf(run, "string").asNondeterministic()(quoted(ids)))


def digest(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Number of ids, and hashes of ids and decoded text."""
    return encoded.select(
        "doc_id",
        (F.octet_length(quoted(ids)) / 4).cast("long").alias("n_tokens"),
        F.sha2(quoted(ids), 256).alias("ids_sha256"),
        F.sha2(quoted(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )
