"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

The merge list alone decides how far to the right of a byte position the text can still
change whether a merge happens there. A merge (a, b) of rank r can be prevented only by an
earlier merge (x, y) whose left part x is b itself or a token on the right edge of b's merge
tree, which again can be prevented only by an earlier one, and so on with falling ranks.
`sufficient_lookahead` takes the longest such chain in bytes. Once that many bytes stand
behind a token, no later byte can change it: the token is emitted and its bytes are dropped,
so a pretoken of any length takes constant memory.

Decoding is an incremental machine from bytes to text: it holds at most the three bytes of
an unfinished UTF-8 sequence and writes U+FFFD for each ill-formed part.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BoundedCache, short_batches

# The published pre-tokenization pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHUNK = 1 << 16
WORDS = 300_000
LONG = 512
ROWS = 512
SHORT = 64


def byte_letters() -> dict[str, int]:
    """The vocabulary's printable letter for each byte: Latin-1 printables stand for themselves,
    the others take the letters from U+0100 on, in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes of right context that settle every token of this merge list.

    reach[r] counts the bytes right of the seam of merge r that can decide whether it happens:
    those of its right part, or beyond them those of an earlier merge which begins with a token
    on the right edge of that part.
    """
    made_of: dict[bytes, tuple[bytes, bytes]] = {}
    furthest: dict[bytes, int] = {}
    most = 0
    for left, right in merges:
        beyond, edge = 0, right
        while True:
            beyond = max(beyond, furthest.get(edge, 0))
            if edge not in made_of:
                break
            edge = made_of[edge][1]
        reach = len(right) + beyond
        made_of.setdefault(left + right, (left, right))
        furthest[left] = max(furthest.get(left, 0), reach)
        most = max(most, len(left) + reach)
    return most


class Vocabulary:
    """Merges, ids and added tokens of a tokenizers-library BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        letters, model = byte_letters(), raw["model"]
        as_bytes = lambda word: bytes(letters[c] for c in word)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.ids = {as_bytes(w): i for w, i in model["vocab"].items()}
        self.id_bytes = {w: i.to_bytes(4, "little") for w, i in self.ids.items()}
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges)
        self.added = {t["content"]: t["id"] for t in raw.get("added_tokens", [])}
        self.text_of = {i: w for w, i in self.ids.items()} | {i: w.encode() for w, i in self.added.items()}
        self.split_added = regex.compile("|".join(regex.escape(w) for w in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.words = BoundedCache(self._word, WORDS, 1 << 23)

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of a byte string: the lowest-ranked pair first, leftmost on ties."""
        parts = [data[i : i + 1] for i in range(len(data))]
        return self._merged_short(parts) if len(parts) <= SHORT else self._merged_long(parts)

    def _merged_short(self, parts: list[bytes]) -> list[bytes]:
        """One merge at a time; only the ranks beside it are looked up again."""
        never = len(self.rank)
        rank = self.rank.get
        ranks = [rank(pair, never) for pair in pairwise(parts)]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), never)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), never)
        return parts

    def _merged_long(self, parts: list[bytes]) -> list[bytes]:
        """All occurrences of the best pair in one pass, for windows of long pretokens."""
        rank = self.rank
        while len(parts) > 1:
            best = min(pairwise(parts), key=lambda pair: rank.get(pair, len(rank)))
            if best not in rank:
                break
            a, b = best
            out, i, n = [], 0, len(parts)
            while i < n:
                if i + 1 < n and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def packed(self, tokens: Iterable[bytes]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.id_bytes.__getitem__, tokens))

    def _word(self, word: str) -> bytes:
        return self.packed(self.merged(word.encode("utf-8", "surrogatepass")))


class Transducer:
    """Bytes of one pretoken in, tokens out as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, b""

    def feed(self, data: bytes) -> Iterator[bytes]:
        step = 4 * self.vocabulary.lookahead
        for i in range(0, len(data), step):
            self.held += data[i : i + step]
            if len(self.held) > 2 * self.vocabulary.lookahead:
                stable = len(self.held) - self.vocabulary.lookahead
                end = 0
                for token in self.vocabulary.merged(self.held):
                    if end + len(token) > stable:
                        break
                    end += len(token)
                    yield token
                self.held = self.held[end:]

    def finish(self) -> Iterator[bytes]:
        yield from self.vocabulary.merged(self.held)
        self.held = b""


class Encoder:
    """Text in pieces of any size in, packed ids out; keeps a bounded tail between pieces.

    A pretoken is settled once a character that cannot belong to it, and two more for the
    contractions, have been seen. A run of one character class that outgrows a piece is passed
    on to a Transducer as it arrives; of white space the last character is held back, since it
    belongs to what follows.
    """

    #: How a run of each class starts and how it goes on.
    RUNS = tuple((regex.compile(f"{lead}{kind}+"), regex.compile(f"{kind}*")) for lead, kind in ((" ?", r"\p{L}"), (" ?", r"\p{N}"), ("", r"\s"), (" ?", r"[^\s\p{L}\p{N}]")))

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.tail = vocabulary, ""
        self.stream, self.more = Transducer(vocabulary), None

    def feed(self, piece: str) -> Iterator[bytes]:
        text, start = self.tail + piece, 0
        if self.more is not None:
            end = self.more.match(text).end()
            held = self.more is self.RUNS[2][1]
            if end < len(text):
                yield self._part(text[: max(0, end - held)])
                yield self.vocabulary.packed(self.stream.finish())
                start, self.more = max(0, end - held), None
            else:
                yield self._part(text[: end - held])
                self.tail = text[end - held :]
                return
        words, safe = [], len(text) - 3
        for m in _pattern().finditer(text, start):
            if m.end() > safe:
                break
            words.append(m.group())
            start = m.end()
        yield self._ids(words)
        self.tail = text[start:]
        if len(self.tail) > LONG:
            for first, more in self.RUNS:
                m = first.match(self.tail)
                if m and m.end() == len(self.tail):
                    held = more is self.RUNS[2][1]
                    yield self._part(self.tail[: m.end() - held])
                    self.tail, self.more = self.tail[m.end() - held :], more

    def _part(self, run: str) -> bytes:
        return self.vocabulary.packed(self.stream.feed(run.encode("utf-8", "surrogatepass")))

    def _ids(self, words: list[str]) -> bytes:
        look = self.vocabulary.words
        return b"".join([look[w] if len(w) <= LONG else self._part(w) + self.vocabulary.packed(self.stream.finish()) for w in words])

    def finish(self) -> Iterator[bytes]:
        if self.more is not None:
            end = self.more.match(self.tail).end()
            yield self._part(self.tail[:end])
            yield self.vocabulary.packed(self.stream.finish())
            self.tail, self.more = self.tail[end:], None
        yield self._ids(_pattern().findall(self.tail))
        self.tail = ""


@lru_cache(maxsize=1)
def _pattern():
    return regex.compile(PRETOKEN)


def encode(vocabulary: Vocabulary, text: str) -> Iterator[bytes]:
    """Packed ids of a text, piece by piece; added tokens are cut out first, as the library does."""
    start = 0
    for m in vocabulary.split_added.finditer(text) if vocabulary.split_added else ():
        yield from _plain(vocabulary, text[start : m.start()])
        yield vocabulary.added[m.group()].to_bytes(4, "little")
        start = m.end()
    yield from _plain(vocabulary, text[start:] if start else text)


def _plain(vocabulary: Vocabulary, text: str) -> Iterator[bytes]:
    if len(text) <= CHUNK:
        words = _pattern().findall(text)
        look = vocabulary.words
        if len(text) <= LONG or max(map(len, words), default=0) <= LONG:
            yield b"".join(map(look.__getitem__, words))
            return
    encoder = Encoder(vocabulary)
    for i in range(0, len(text), CHUNK):
        yield from encoder.feed(text[i : i + CHUNK])
    yield from encoder.finish()


def decode(vocabulary: Vocabulary, pieces: Iterable[bytes]) -> Iterator[str]:
    """Text of packed ids, piece by piece; ill-formed bytes become U+FFFD."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    text_of = vocabulary.text_of
    for piece in pieces:
        yield machine.decode(b"".join(map(text_of.__getitem__, memoryview(piece).cast("I"))))
    yield machine.decode(b"", final=True)


def _one(vocabulary: Vocabulary, text: str, keep_ids: bool) -> tuple[int, str, str, bytes]:
    """Number of tokens, both digests and, if kept, the packed ids; pieces pass through and are dropped."""
    n, digest, back, kept = 0, hashlib.sha256(), hashlib.sha256(), []

    def counted():
        nonlocal n
        for piece in encode(vocabulary, text):
            n += len(piece) // 4
            digest.update(piece)
            if keep_ids:
                kept.append(piece)
            yield piece

    for part in decode(vocabulary, counted()):
        back.update(part.encode("utf-8"))
    return n, digest.hexdigest(), back.hexdigest(), b"".join(kept)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text; one row per input row, no shuffle.

    Returns the id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the ids as
    ``token_ids`` (array of int). A null text counts as empty: no tokens, the digests of nothing.
    A very long text is encoded whole as it streams through; repeated rows have the same tokens; an empty table gives no rows.
    ``path`` names the vocabulary file, which must exist on every executor.
    """
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if keep_ids else "")

    def run(batches):
        vocabulary = vocabulary_of(path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                done = [_one(vocabulary, t.as_py() or "", keep_ids) for t in part.column(1)]
                columns = [part.column(0), *(pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string())))]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    ends = np.cumsum([0] + [d[0] for d in done])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(d[3] for d in done), "<i4"))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    short_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"{id_col} {narrow.schema[0].dataType.simpleString()}, {fields}")
