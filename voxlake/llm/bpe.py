"""BPE encoding and decoding over a table of distinct words.

Words are the runs between white space; the vocabulary file's normalizer,
splitter and special tokens never look across it. Three steps, in which no row
grows with the corpus:

* *Split.* The texts of a partition form blocks of ``BLOCK_ROWS`` texts or
  ``BLOCK_BYTES`` bytes. A block numbers its distinct words, the most frequent
  first, and sends each once, as ``(word, block, number)``. This is the
  aggregation before the shuffle: the most frequent word of all is one row for
  each block.
* *Distinct words.* The rows are dealt and sorted by word; each distinct word is
  encoded once and its ids go back to every ``(block, number)`` that has it.
* *Join by position.* A block's texts, as numbers in order, meet the block's
  ids. Decoding looks every id up in the id-to-piece table, which is as large as
  the vocabulary and is sent to all workers.

A block is known by a 128-bit digest of its numbered words, so that numbers
never meet the ids of other words: should a partition be read again in another
order, its block finds no ids and the task raises. Texts themselves have no key:
null and repeated doc_ids need no care.

Defined results: a null or empty text has no tokens and decodes to the empty
string; equal texts have equal results; each row has a row of its own, whatever
its doc_id; an empty table gives no rows; extra columns are ignored; a file with
another splitter than ``WORDS`` is refused.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, returning, ship

ship(__name__)

BLOCK_ROWS = 8192
BLOCK_BYTES = 32 << 20
#: Words of the texts that one packed row holds (one text at least), rows of words that are answered together, parts of words that a task remembers.
ROW_WORDS = 1 << 18
ANSWER_ROWS = 1 << 19
MEMO_PARTS = 1 << 16
#: The splitter of the vocabulary file.
_SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NOT_SPACE = "\x1c\x1d\x1e\x1f"  # white space for str.split, but not for the splitter
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Vocabulary:
    """Pieces, merge ranks and special tokens of one vocabulary file (a JSON text)."""

    def __init__(self, source: str):
        data = json.loads(source)
        model = data["model"]
        if WORDS not in (s["pattern"].get("Regex") for s in data["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"):
            raise ValueError("the vocabulary file splits words in another way")
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pieces = {i: p for p, i in self.ids.items()} | {i: p for p, i in self.special.items()}
        # merges over ids: a pair in one integer, its rank, and the id that a rank makes
        self.wide = 1 << max(self.pieces).bit_length()
        self.pair_ranks = {self.ids[a] * self.wide + self.ids[b]: k for (a, b), k in self.ranks.items()}
        self.made = [self.ids[a + b] for a, b in self.ranks]
        self.split = regex.compile(WORDS)
        self.marks = {t[0] for t in self.special}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.first = [self.ids[c] for c in self.letters]
        self.final = [self.ids[c + self.end] for c in self.letters]

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special token is a word of its own."""
        if text.isalpha() and max(text) < "\u0100":  # letters that NFC keeps: one word
            return [text.lower()]
        parts = self.specials.split(text) if any(m in text for m in self.marks) else [text]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part:
                out += self.split.findall(lowered(part))
        return out

    def runs(self, text: str) -> list[str]:
        """The runs between white space; words and special tokens never cross it."""
        if any(c in text for c in _NOT_SPACE):
            return [r for r in _SPACES.split(text) if r]
        return text.split()

    def encode_word(self, word: str) -> list[int]:
        """Merge the pair of least rank, leftmost first, until no pair has a rank."""
        if word in self.special:
            return [self.special[word]]
        data = word.encode("utf-8", "replace")
        if not data:
            return []
        if len(data) > 64:
            parts = [self.letters[b] for b in data]
            parts[-1] += self.end
            return [self.ids[p] for p in merge_long(parts, self.ranks)]
        ids = [self.first[b] for b in data]
        ids[-1] = self.final[data[-1]]
        rank, none, wide, made = self.pair_ranks.get, len(self.made), self.wide, self.made
        order = [rank(a * wide + b, none) for a, b in zip(ids, ids[1:])]
        while order and (low := min(order)) < none:
            i = order.index(low)
            new = ids[i] = made[low]
            del ids[i + 1], order[i]
            if i:
                order[i - 1] = rank(ids[i - 1] * wide + new, none)
            if i < len(order):
                order[i] = rank(new * wide + ids[i + 1], none)
        return ids

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.pieces[i] for i in ids)


def merge_long(parts: list[str], ranks: dict) -> list[str]:
    """The same merges over a linked list and a heap: n log n for words of any length."""
    import heapq

    n = len(parts)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    live, heap = list(parts), []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (r := ranks.get((live[i], live[j]))) is not None:
            heapq.heappush(heap, (r, i, live[i], live[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if live[i] == a else -1
        if j < 0 or live[j] != b:
            continue
        live[i], live[j] = a + b, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        after[j] = -1
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in live if p]


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it is visible, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def lowered(text: str) -> str:
    """NFC, then each character lowered on its own (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            return "".join(c.lower() for c in text)
    return text.lower()


def kept(shared, name: str, make):
    """What ``make`` derives from a broadcast dictionary; kept with it, so a worker makes it once."""
    held = shared.value
    if name not in held:
        held[name] = make(held)
    return held[name]


def _vocabulary(shared) -> Vocabulary:
    return kept(shared, "vocabulary", lambda held: Vocabulary(held["json"]))


def _piece_list(v: Vocabulary) -> pa.Array:
    """The id-to-piece table."""
    return pa.array([v.pieces.get(i, "") for i in range(max(v.pieces) + 1)], pa.string())


def _runs(v: Vocabulary, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of all texts end to end, and how many each text has; an empty run may stand where a text begins or ends."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset)
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    if ((data >= 28) & (data <= 31)).any():  # white space for the vector split, but not for the splitter
        runs = [v.runs(t or "") for t in texts.to_pylist()]
        return pa.array([w for r in runs for w in r], pa.string()), np.array([len(r) for r in runs], np.int64)
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(v: Vocabulary, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of a few texts: the distinct runs, all words as places in them, words of each text."""
    runs, sizes = _runs(v, texts)
    coded = runs.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int32)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        kept_ = codes != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept_], minlength=len(sizes))
        codes = codes[kept_]
    return coded.dictionary, codes, sizes


def _numbered(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[bytes, pa.Array, np.ndarray, np.ndarray]:
    """Of a block's coded texts: digest and array of the distinct words, most frequent first; all words as numbers; words of each text."""
    coded = pa.concat_arrays([words for words, _, _ in parts]).dictionary_encode()
    places, at = coded.indices.to_numpy().astype(np.int32), 0
    codes = np.empty(sum(len(c) for _, c, _ in parts), np.int32)
    often, end = np.zeros(len(coded.dictionary), np.int64), 0
    for words, c, _ in parts:
        mine = codes[end : end + len(c)]
        mine[:] = places[at : at + len(words)][c]
        often += np.bincount(mine, minlength=len(often))
        at, end = at + len(words), end + len(c)
    order = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
    rank = np.empty(len(often), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    for a in range(0, len(codes), 1 << 18):
        codes[a : a + (1 << 18)] = rank[codes[a : a + (1 << 18)]]
    words = coded.dictionary.take(pa.array(order, pa.int64()))
    digest = xxhash.xxh3_128()
    for buffer in words.buffers()[1:]:
        digest.update(buffer or b"")
    return digest.digest(), words, codes, np.concatenate([sizes for _, _, sizes in parts])


def _blocks(v: Vocabulary, batches):
    """The rows of a partition by blocks of ``BLOCK_ROWS`` texts or ``BLOCK_BYTES`` bytes, as ``_numbered`` gives them, and their doc_ids.

    A block holds its words as numbers from the first; its texts are let go."""
    held, ids, size = [], [], 0
    for piece in (p for batch in batches for p in pieces(batch, 256)):
        held.append(_coded(v, piece.column("text")))
        ids += piece.column("doc_id").to_pylist()
        size += piece.nbytes
        if len(ids) >= BLOCK_ROWS or size >= BLOCK_BYTES:
            yield *_numbered(held), ids
            held, ids, size = [], [], 0
    if held:
        yield *_numbered(held), ids


def _words(source):
    """Of (doc_id, text): ``(block, number, word)`` of each block's distinct words."""
    schema = pa.schema([("block", pa.binary()), ("number", pa.int32()), ("word", pa.string())])

    def run(batches):
        v = _vocabulary(source)
        for block, words, _, _, _ in _blocks(v, batches):
            for at in range(0, len(words), 1 << 14):
                part = words.slice(at, 1 << 14)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(block, pa.binary()), len(part)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), part], schema=schema)

    return run


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2^32, like bytes together, compressed."""
    planes = b"".join(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    return b"".join(len(a).to_bytes(4, "little") for a in arrays) + zstandard.ZstdCompressor(level=7).compress(planes)


def unpacked(data: bytes, arrays: int) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<u4", arrays).astype(np.int64)
    planes = zstandard.ZstdDecompressor().decompress(data[4 * arrays :], max_output_size=max(1, int(4 * sizes.sum())))
    ends = 4 * np.cumsum(sizes)
    each = (np.frombuffer(planes, np.uint8, int(4 * n), int(e - 4 * n)).reshape(4, -1) for n, e in zip(sizes, ends))
    return [np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in each]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, end to end."""
    total = int(sizes.sum())
    return values[np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]


_MET = pa.schema([("block", pa.binary()), ("kind", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())])
_MET_SCHEMA = "block binary, kind int, doc_ids array<long>, data binary"


def _answers(source):
    """Of rows (block, number, word) sorted by word: the ids of the words, one row for each block of every ``ANSWER_ROWS``."""

    def run(batches):
        v = _vocabulary(source)
        parts: dict[str, list[int]] = {}  # many words share a part: case and punctuation aside they are equal
        last: tuple[str | None, list[int]] = (None, [])
        held, rows = [], 0

        def encoded(word: str) -> list[int]:
            ids: list[int] = []
            for part in v.words(word):
                found = parts.get(part)
                if found is None:
                    if len(parts) >= MEMO_PARTS:
                        parts.clear()
                    found = parts[part] = v.encode_word(part)
                ids += found
            return ids

        def answered():
            names: dict[bytes, int] = {}
            block = np.concatenate([np.array([names.setdefault(x, len(names)) for x in h[4]], np.int32)[h[0]] for h in held])
            told = list(names)
            number, size = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            ids = np.concatenate([h[3] for h in held])
            starts = np.cumsum(size, dtype=np.int64) - size
            order = np.lexsort((number, block))
            cuts = np.append(np.flatnonzero(np.diff(block[order], prepend=-1)), len(order))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                at = order[a:b]
                data = packed(np.diff(number[at], prepend=0), size[at], gathered(ids, starts[at], size[at]))
                yield pa.RecordBatch.from_arrays([pa.array([told[block[at[0]]]], pa.binary()), pa.array([0], pa.int32()), pa.array([None], pa.list_(pa.int64())), pa.array([data], pa.binary())], schema=_MET)

        for batch in batches:
            word = batch.column(2).dictionary_encode()
            lists = [last[1] if w == last[0] else encoded(w) for w in word.dictionary.to_pylist()]
            codes = word.indices.to_numpy().astype(np.int64)
            if not len(codes):
                continue
            last = (word.dictionary[int(codes[-1])].as_py(), lists[int(codes[-1])])
            each = np.array([len(x) for x in lists], np.int64)
            flat = np.array([i for x in lists for i in x], np.int64)
            size = each[codes]
            # copies of their own, so that the batch can go
            block = batch.column(0).dictionary_encode()
            held.append((block.indices.to_numpy().astype(np.int32), batch.column(1).to_numpy().astype(np.int32), size.astype(np.int32), gathered(flat, (np.cumsum(each) - each)[codes], size).astype(np.int32), block.dictionary.to_pylist()))
            rows += len(codes)
            if rows >= ANSWER_ROWS:
                yield from answered()
                held, rows = [], 0
        if held:
            yield from answered()

    return run


def _packed_texts(source):
    """Of (doc_id, text): rows with the doc_ids of some texts of a block and their words as numbers."""

    def run(batches):
        v = _vocabulary(source)
        for block, words, numbers, sizes, ids in _blocks(v, batches):
            ends = np.cumsum(sizes)
            at = 0
            while at < len(ids):
                began = int(ends[at] - sizes[at])
                upto = max(at + 1, min(at + 256, int(np.searchsorted(ends, began + ROW_WORDS, "right"))))
                data = packed(np.array([len(words)]), sizes[at:upto], numbers[began : int(ends[upto - 1])])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), pa.array([1], pa.int32()), pa.array([ids[at:upto]], pa.list_(pa.int64())), pa.array([data], pa.binary())], schema=_MET)
                at = upto

    return run


def _finished(source):
    """Of rows sorted by block, a block's ids before its texts: the ids and the decoded text of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def joined(answers: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, sizes and ids by number; blocks with the same words bring the same answers again."""
        whole = [unpacked(x, 3) for x in answers]
        number = np.concatenate([np.cumsum(x[0]) for x in whole] or [np.zeros(0, np.int64)])
        size = np.concatenate([x[1] for x in whole] or [np.zeros(0, np.int64)])
        ids = np.concatenate([x[2] for x in whole] or [np.zeros(0, np.int64)])
        starts = np.cumsum(size) - size
        n = int(number.max(initial=-1)) + 1
        at, of = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at[number], of[number] = starts, size
        return at, of, ids

    def run(batches):
        spelled = kept(source, "pieces", lambda held: _piece_list(_vocabulary(source)))
        block, answers, table = None, [], None
        for batch in (b for whole in batches for b in pieces(whole, 16)):
            for name, kind, doc_ids, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if name != block:
                    block, answers, table = name, [], None
                if kind == 0:
                    answers.append(data)
                    continue
                if table is None:
                    table, answers = joined(answers), []
                starts, of, ids = table
                words, sizes, numbers = unpacked(data, 3)
                if len(starts) != words[0] or starts.min(initial=0) < 0:
                    raise RuntimeError("a partition of the texts was read twice with different rows; write the table first")
                flat = gathered(ids, starts[numbers], of[numbers])
                ends = np.append(0, np.cumsum(of[numbers]))[np.append(0, np.cumsum(sizes))]
                tokens = np.diff(ends)
                if ends[-1] >= 1 << 29:
                    raise ValueError("a text of over 2^29 tokens")
                raw = pa.py_buffer(flat.astype("<u4").tobytes())
                ids_out = pa.Array.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), raw])
                lists = pa.LargeListArray.from_arrays(pa.array(ends), spelled.take(pa.array(flat)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(tokens), ids_out, pc.binary_join(lists, " ").cast(pa.string())], schema=schema)

    return run


def encode_and_decode(docs: DataFrame, vocabulary_json: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``: ids as little-endian unsigned 32-bit integers."""
    source = docs.sparkSession.sparkContext.broadcast({"json": vocabulary_json})
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # both readings see the same columns, so that they see the same partitions
    words = keyed.mapInArrow(returning(_words(source)), "block binary, number int, word string").repartition("word").sortWithinPartitions("word")
    met = words.mapInArrow(returning(_answers(source)), _MET_SCHEMA).unionByName(keyed.mapInArrow(returning(_packed_texts(source)), _MET_SCHEMA))
    return met.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(returning(_finished(source)), "doc_id long, n_tokens long, ids binary, decoded string")


def op8_bpe(docs: DataFrame, vocabulary_json: str) -> DataFrame:
    out = encode_and_decode(docs, vocabulary_json)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
