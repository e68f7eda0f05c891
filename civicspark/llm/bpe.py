"""Operator 11: byte-level BPE. Merge ranks in a priority queue over a doubly linked list of symbols.

A word's symbols are linked to their neighbours. Every neighbouring pair that has a merge rank is queued by
(rank, place); the queue's least entry is merged if the pair at its place still has that rank, and skipped as
stale otherwise. A merge changes two links and queues at most two new pairs, so a word of n bytes takes
O(n log n) whatever its length. Decoding concatenates the vocabulary's strings.

The vocabulary file is read once on the driver and sent with the tasks (50,000 entries, some 2 MB: its size
does not grow with the table). Ids of words, and of stretches between blanks, of up to ``KEPT_CHARS`` characters
are kept for the next time in tables of at most ``KEPT`` strings in each Python worker; they change the
time, not the result.

Edge cases: null and empty texts have no ids and decode to an empty text; equal texts have equal ids and
repeated rows stay repeated, null ids of documents too; ties between equal ranks go to the left; extra
columns of the input are dropped, whatever their names; an empty table gives an empty table. A long text is
encoded ``WORDS_AT_ONCE`` words at a time, so memory follows its ids. Strings of added tokens inside a text
are those tokens, as in the library. Bytes that are no UTF-8 count as replacement characters.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import slices, table, utf8

KEPT = 1 << 19
KEPT_CHARS = 40
WORDS_AT_ONCE = 1 << 16
#: Fixed value: how byte-level vocabularies of this kind split text into words.
SPLIT = r" ?\p{L}++| ?\p{N}++|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: A blank after a character that is none: a word always begins here, so what lies between two is split by itself.
BLANK = re.compile(r"(?<=\S) ")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary's strings: itself if it shows, else the next free one from 256 on."""
    shows = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shows else chr(next(free)) for b in range(256)]


def merged(symbols: list[int], ranks: list[dict[int, int]], results: list[int]) -> list[int]:
    """Symbols after all merges, the least rank first, of equal ranks the leftmost.

    ``ranks`` has for each left symbol the ranks by right symbol, and an empty table last, which stands for
    a dead place (-1) or the end of the word; ``results`` has the symbol that each rank makes.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    shift = n.bit_length()
    places, before, after = (1 << shift) - 1, list(range(-1, n)), list(range(1, n + 2))
    queue = [rank << shift | at for at, (a, b) in enumerate(zip(symbols, symbols[1:])) if (rank := ranks[a].get(b)) is not None]
    symbols = [*symbols, -1]
    heapify(queue)
    while queue:
        entry = heappop(queue)
        at, rank = entry & places, entry >> shift
        right = after[at]
        if ranks[symbols[at]].get(symbols[right]) != rank:
            continue  # stale: one of the two was merged since
        made = symbols[at] = results[rank]
        symbols[right] = -1
        beyond = after[at] = after[right]
        before[beyond] = at
        if (rank := ranks[made].get(symbols[beyond])) is not None:
            heappush(queue, rank << shift | at)
        left = before[at]
        if (rank := ranks[symbols[left]].get(made)) is not None:
            heappush(queue, rank << shift | left)
    return [s for s in symbols if s >= 0]


class Lately(dict):
    """What a function made of the strings it was given lately.

    When the table is full it becomes the older one, and strings that are asked for again move to the new one.
    """

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= KEPT // 2:
                self.older = dict(self)
                self.clear()
            self[key] = made
        return made


class Bpe:
    """A vocabulary with its merges. Ids are packed as 32-bit integers until a text is whole."""

    def __init__(self, definition: bytes):
        told = json.loads(definition)
        model, split = told["model"], told["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True) or told["normalizer"]:
            raise ValueError("only byte-level BPE without normaliser, prefix space and word ends")
        added = told["added_tokens"]
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only added tokens that match as they stand")
        vocab, letters = model["vocab"], byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.of_byte = [vocab[c] for c in letters]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.strings = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in added)]))
        nothing: dict[int, int] = {}
        self.ranks = [nothing] * (len(self.strings) + 1)
        self.results = [vocab[a + b] for a, b in pairs]
        for rank, (a, b) in enumerate(pairs):
            if self.ranks[vocab[a]] is nothing:
                self.ranks[vocab[a]] = {}
            self.ranks[vocab[a]][vocab[b]] = rank
        for token, number in vocab.items():
            self.strings[number] = bytes(of_letter[c] for c in token)
        for t in added:
            self.strings[t["id"]] = t["content"].encode()
        self.added = {t["content"]: array("i", [t["id"]]).tobytes() for t in added}
        longest_first = sorted(self.added, key=lambda t: (-len(t), t))
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.split = regex.compile(SPLIT)
        self.word, self.after_blank = Lately(self._word), Lately(lambda text: self._stretch(" " + text))

    def _word(self, word: str) -> bytes:
        return array("i", merged([*map(self.of_byte.__getitem__, word.encode())], self.ranks, self.results)).tobytes()

    def _stretch(self, text: str) -> bytes:
        if len(text) < WORDS_AT_ONCE:
            return b"".join(map(self.word.__getitem__, self.split.findall(text)))
        found, parts = (m.group() for m in self.split.finditer(text)), []
        while words := list(islice(found, WORDS_AT_ONCE)):
            parts.append(b"".join(map(self.word.__getitem__, words)))
        return b"".join(parts)

    def _packed(self, text: str) -> Iterator[bytes]:
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                yield self.added[part]
                continue
            first, *others = BLANK.split(part)
            yield self._stretch(first)
            for start in range(0, len(others), WORDS_AT_ONCE):
                yield b"".join(map(self.after_blank.__getitem__, others[start : start + WORDS_AT_ONCE]))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self._packed(text)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.strings.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(definition: bytes) -> Bpe:
    """Once in each Python worker."""
    return Bpe(definition)


def encoded(docs: DataFrame, definition: bytes, id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text, by a vocabulary file's content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(definition)
        for batch in batches:
            texts = batch.column("text")
            for start, end in slices(texts):
                ids = [bpe.encode(t.as_py().decode("utf-8", "replace")) for t in texts.slice(start, end - start)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                back = pa.array([bpe.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), lists, back], [id_col, "ids", "decoded"])

    given = docs.select(id_col, utf8().alias("text"))
    return given.mapInArrow(run, f"{id_col} {given.dtypes[0][1]}, ids array<int>, decoded string")


def vocabulary(path: str | None = None) -> bytes:
    """A vocabulary file's content; without a path the public byte-level one of the installed collection."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as file:
        return file.read()


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests of the ids and of the decoded text of every document."""
    found = encoded(table(spark, sf_dir, "documents"), vocabulary())
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
