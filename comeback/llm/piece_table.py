"""Exact SentencePiece merge encoding from a table of last tokens, and decoding.

The encoding of every prefix of a text ends in one token, and that token is the only one that
(a) matches at the end of the prefix and (b) stands beside the last token of what comes before
it without merging across. So one pass over the automaton's matches fills a table with the last
token of each prefix, and the ids are read off the table backwards.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

SPACE = "▁"
#: Texts are cut before each run of spaces that follows something else; no piece crosses that.
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Distinct chunks a Python worker remembers before it starts anew.
REMEMBERED = 700_000
INFINITE = float("inf")


class PieceTable:
    """Encoder and decoder for a merge-type (BPE) model with byte fallback."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.normalize = model.normalize
        self.pieces = [model.id_to_piece(i) for i in range(len(model))]
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(len(model)) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = model.unk_id()
        self.silent = {i for i in range(len(model)) if model.is_control(i)}
        special = self.silent | self.byte_of.keys() | {self.unknown}
        normal = [i for i in range(len(model)) if i not in special]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece goes on after a space; texts can't be cut at spaces")
        # Later merges have larger ranks; equal scores have equal ranks.
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in normal}, reverse=True))}
        self.rank = {self.pieces[i]: order[model.get_score(i)] for i in normal}
        self.id_of = {self.pieces[i]: i for i in normal}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.plain: set[str] = set()
        automaton = ahocorasick.Automaton()
        for piece in sorted(self.id_of, key=len):
            if self._learn(piece):
                automaton.add_word(piece, self.id_of[piece])
        automaton.make_automaton()
        self.automaton = automaton
        self.sizes = [len(p) for p in self.pieces]
        self.shift = len(self.pieces).bit_length()
        self.characters = {p for p in self.id_of if len(p) == 1}
        if not self.characters.issuperset("".join(self.halves)):
            raise ValueError("a piece has a character that is no piece")
        self.beside: dict[int, bool] = {}
        self.chunks: dict[str, str] = {}

    def merged(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """What merging leaves of the symbols, and the last pair that was merged."""
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        alive = list(symbols)
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(alive) and (whole := alive[i] + alive[j]) in self.rank:
                heapq.heappush(heap, (self.rank[whole], i, whole))

        for i in range(len(symbols) - 1):
            offer(i)
        last = None
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= len(alive) or alive[i] + alive[j] != whole:
                continue
            last = (alive[i], alive[j])
            alive[i], alive[j] = whole, ""
            after[i] = after[j]
            if after[i] < len(alive):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in alive if x], last

    def _learn(self, piece: str) -> bool:
        """Whether merging the piece's own characters ends in the piece; notes its last merge.

        A piece is plain when it and its parts were merged in the order of their ranks.
        """
        if len(piece) == 1:
            self.halves[piece] = None
            self.plain.add(piece)
            return True
        left, last = self.merged(list(piece))
        if left != [piece] or last is None:
            return False
        self.halves[piece] = last
        if all(h in self.plain and (len(h) == 1 or self.rank[h] < self.rank[piece]) for h in last):
            self.plain.add(piece)
        return True

    def _stands(self, a: str, b: str) -> bool:
        """Whether merging the characters of ``a`` and ``b`` together ends in just these two.

        For plain pieces the merges are undone from the latest on. While the neighbours x and y
        at the border both existed, they would have merged if their union ranked before whatever
        took up x, or not after whatever took up y (of equal ranks the left one goes first).
        """
        if a not in self.plain or b not in self.plain:
            return self.merged([*a, *b])[0] == [a, b]
        rank, halves = self.rank, self.halves
        x, y, taken_x, taken_y = a, b, INFINITE, INFINITE
        while True:
            cross = rank.get(x + y)
            if cross is not None and cross < taken_x and cross <= taken_y:
                return False
            parts_x, parts_y = halves[x], halves[y]
            if parts_x and (not parts_y or rank[x] > rank[y]):
                taken_x, x = rank[x], parts_x[1]
            elif parts_y:
                taken_y, y = rank[y], parts_y[0]
            else:
                return True

    def _known(self, chunk: str) -> list[int]:
        """Ids of a stretch of characters that are all in the vocabulary."""
        beside, sizes, shift = self.beside, self.sizes, self.shift
        last = [-1] * (len(chunk) + 1)
        for end, token in self.automaton.iter(chunk):
            end += 1
            if last[end] >= 0:
                continue
            start = end - sizes[token]
            if start:
                pair = (last[start] << shift) | token
                good = beside.get(pair)
                if good is None:
                    good = self._stands(self.pieces[last[start]], self.pieces[token])
                    if len(beside) < REMEMBERED:
                        beside[pair] = good
                if not good:
                    continue
            last[end] = token
        out, at = [], len(chunk)
        while at:
            out.append(last[at])
            at -= sizes[last[at]]
        return out[::-1]

    def _ids(self, chunk: str) -> list[int]:
        """Ids of a chunk; nothing merges with a character outside the vocabulary."""
        if self.characters.issuperset(chunk):
            return self._known(chunk)
        ids: list[int] = []
        for known, part in itertools.groupby(chunk, self.characters.__contains__):
            text = "".join(part)
            if known:
                ids += self._known(text)
            elif self.bytes:
                ids += [self.bytes[b] for b in text.encode()]
            else:
                ids += [self.unknown] * len(text)
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin and end marks."""
        return [i for chunk in CHUNK.findall(self.normalize(text)) for i in self._ids(chunk)]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD.

        The space before the text is dropped if a piece begins with it; a byte's space stays.
        """
        ids = [i for i in ids if i not in self.silent]
        text = self._text(ids)
        led = bool(ids) and ids[0] not in self.byte_of and ids[0] != self.unknown and text.startswith(" ")
        return text[1:] if led else text

    def _text(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_from_bytes(raw))
                raw = bytearray()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(_from_bytes(raw))
        return "".join(out)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text.

        Chunks repeat, so the ids of a chunk are remembered if they decode to the chunk itself.
        """
        known = self.chunks
        found = CHUNK.findall(self.normalize(text or ""))
        parts = [known.get(chunk) for chunk in found]
        decoded = None
        if None in parts:
            for at, chunk in enumerate(found):
                if parts[at] is not None:
                    continue
                part = known.get(chunk)
                if part is None:
                    ids = self._ids(chunk)
                    part = ",".join(map(str, ids))
                    plain = chunk.replace(SPACE, " ")
                    back = self._text(ids)
                    if back != plain:
                        decoded = decoded or [c.replace(SPACE, " ") for c in found]
                        decoded[at] = back
                    elif len(chunk) < 100:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[chunk] = part
                parts[at] = part
        joined = ",".join(parts)
        whole = "".join(decoded if decoded else found).replace(SPACE, " ")
        return (
            joined.count(",") + 1 if joined else 0,
            hashlib.sha256(joined.encode()).hexdigest(),
            hashlib.sha256(whole.removeprefix(" ").encode()).hexdigest(),
        )


def _from_bytes(raw: bytes) -> str:
    """Bytes as text; each byte outside a valid sequence becomes one U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[at : at + n]).decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_TABLES: dict[str, PieceTable] = {}


def table_of(model_file: str) -> PieceTable:
    """The table of a model, made once in each Python process."""
    if model_file not in _TABLES:
        _TABLES[model_file] = PieceTable(model_file)
    return _TABLES[model_file]


def encode_documents(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, its token ids and the text they decode to.

    A null or empty text has no ids and decodes to the empty text; null and repeated ids stay as
    they are; other columns are not looked at. ``model_file`` must exist on every executor.
    """
    source = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model_file)
        for batch in batches:
            ids = [table.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([table.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def token_digests(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As ``encode_documents``, with hashes in place of ids and text, and the number of ids."""
    source = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model_file)
        for batch in batches:
            rows = [table.digest(t) for t in batch.column(1).to_pylist()]
            count, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
