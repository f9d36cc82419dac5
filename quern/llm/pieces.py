"""SentencePiece encoding and decoding by vectorised merge rounds.

A text becomes words that no piece of the vocabulary can cross: a run of blanks with what follows it, or a line end. Every
distinct word of a slice is encoded once, all of them together: one flat numpy array of symbols, the rank of each neighbouring
pair beside it. A round takes the least rank in each word, merges its leftmost non-overlapping places at once, looks up only the
pairs that changed, and drops the words in which no pair is left. Symbols without an id fall back to their bytes.

Merging all places of a pair at once equals merging them one by one unless the merged piece can join a neighbour at a rank as
good as its own; words whose best piece is of that kind merge their leftmost place alone in that round.

Defined cases: a null or empty text has no ids and decodes to an empty text; a text of any length is encoded whole; an empty
table gives an empty table; repeated rows give repeated rows; other columns are not carried unless asked for by keep.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

BLANK = "▁"
#: Words that a Python worker remembers before it starts anew: memory alone depends on it.
REMEMBERED = 150_000
#: Symbols that the merge rounds hold at a time.
ROUND_SYMBOLS = 1 << 17
#: Bytes of text whose words are held as objects at a time.
WORD_BYTES = 1 << 20
NONE = np.int64(1) << 60
WORD = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")


def model_pieces(path: str) -> list[tuple[bytes, float, int]]:
    """(piece, score, kind) by id, from the model file's protobuf fields 1, 2 and 3 of each entry of field 1."""
    data = open(path, "rb").read()  # noqa: SIM115

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    def fields(at: int, end: int):
        while at < end:
            tag, at = number(at)
            if tag & 7 == 2:
                n, at = number(at)
                yield tag >> 3, (at, at + n)
                at += n
            elif tag & 7 == 5:
                yield tag >> 3, data[at : at + 4]
                at += 4
            elif tag & 7 == 1:
                at += 8
            else:
                value, at = number(at)
                yield tag >> 3, value

    found = []
    for field, where in fields(0, len(data)):
        if field == 1:
            own = dict(fields(*where))
            piece = data[slice(*own[1])] if 1 in own else b""
            found.append((piece, float(np.frombuffer(own[2], np.float32)[0]) if 2 in own else 0.0, own.get(3, 1)))
    return found


class Vocabulary:
    """The pair table of a BPE model with byte fallback, and the bytes of each id."""

    def __init__(self, path: str):
        pieces = model_pieces(path)
        self.size = len(pieces)
        texts = {p.decode(): i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4, 5)}
        self.byte_id = np.zeros(256, np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_id[int(p[3:5], 16)] = i
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else b" \xe2\x81\x87 " if kind == 2 else p.replace(BLANK.encode(), b" ") for p, _, kind in pieces]
        scores = {t: pieces[i][1] for t, i in texts.items()}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbols = dict(texts)
        for t in texts:  # characters that are parts of pieces, but no pieces
            for c in t:
                symbols.setdefault(c, len(pieces) + len(symbols))
        self.chars = {c: i for c, i in symbols.items() if len(c) == 1}
        width = self.width = max(symbols.values()) + 1
        keys, results, careful = [], [], set()
        for t, i in texts.items():
            for cut in range(1, len(t)):
                a, b = symbols.get(t[:cut]), symbols.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a * width + b)
                    results.append(i)
                    careful |= {symbols[x] for x in (t[:cut], t[cut:]) if len(x) > 1 and scores[t] >= scores.get(x, -np.inf)}
        order = np.argsort(keys)
        self.keys, self.results = np.array(keys, np.int64)[order], np.array(results, np.int64)[order]
        self.rank = np.full(width, NONE, np.int64)
        for t, i in texts.items():
            self.rank[i] = ranks[scores[t]]
        self.careful = np.zeros(width, bool)
        self.careful[list(careful)] = True

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, or -1."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.results[at], -1)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = []
        start = held = 0
        for i, w in enumerate(words):
            if held and held + len(w) > ROUND_SYMBOLS:
                out += self._rounds(words[start:i])
                start, held = i, 0
            held += len(w)
        return out + self._rounds(words[start:]) if words else out

    def _rounds(self, words: list[str]) -> list[np.ndarray]:
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, where = np.unique(codes, return_inverse=True)
        symbol = np.array([self.chars.get(chr(c), -1) for c in distinct], np.int64)[where]
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), sizes)
        first = np.arange(len(text))  # the code point at which each symbol begins
        done_symbol, done_first = [], []
        last = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
        pair = np.where(last, -1, self.merged(symbol, np.append(symbol[1:], -1)))
        while len(symbol):
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(heads, len(word)))
            least = np.minimum.reduceat(rank, heads)
            live = np.repeat(least < NONE, counts)
            if not live.all():
                done_symbol.append(symbol[~live])
                done_first.append(first[~live])
                symbol, first, word, pair, rank = symbol[live], first[live], word[live], pair[live], rank[live]
                alive = least < NONE
                least, counts = least[alive], counts[alive]
                if not len(symbol):
                    break
            group = np.repeat(np.arange(len(counts)), counts)
            at = np.flatnonzero(rank == least[group])
            owner = group[at]
            new = np.append(True, owner[1:] != owner[:-1])
            hard = self.careful[pair[at]]
            if hard.any():
                single = np.zeros(len(counts), bool)
                single[owner[hard]] = True
                keep = new | ~single[owner]
                at, owner, new = at[keep], owner[keep], new[keep]
            # of places that follow each other directly, every second one from the left
            run = new | np.append(True, np.diff(at) > 1)
            begins = np.flatnonzero(run)
            nth = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
            at = at[nth % 2 == 0]
            symbol[at] = pair[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbol, first, word, pair = symbol[keep], first[keep], word[keep], pair[keep]
            at = moved[at]
            touched = np.concatenate((at, at[at > 0] - 1))
            right = np.minimum(touched + 1, len(symbol) - 1)
            same = (right > touched) & (word[right] == word[touched])
            pair[touched] = np.where(same, self.merged(symbol[touched], symbol[right]), -1)
        if not done_symbol:
            return [np.zeros(0, np.int64) for _ in words]
        symbol, first = np.concatenate(done_symbol), np.concatenate(done_first)
        order = np.argsort(first, kind="stable")
        symbol, first = symbol[order], first[order]
        plain = (symbol >= 0) & (symbol < self.size)
        if not plain.all():  # bytes in place of symbols without an id
            ends = np.append(first[1:], len(text))
            parts = [self.byte_id[np.frombuffer(text[a:b].encode("utf-8", "replace"), np.uint8)] for a, b in zip(first[~plain], ends[~plain])]
            lengths = np.ones(len(symbol), np.int64)
            lengths[~plain] = [len(p) for p in parts]
            ids = np.repeat(symbol, lengths)
            ids[np.repeat(~plain, lengths)] = np.concatenate(parts)
            first = np.repeat(first, lengths)
            symbol = ids
        bounds = np.searchsorted(first, np.append(0, np.cumsum(sizes))).tolist()
        return [symbol[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, runs of bytes read as UTF-8, one leading blank dropped."""
        return self.joined(b"".join([self.bytes[i] for i in ids]))

    @staticmethod
    def joined(raw: bytes) -> str:
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Words(dict):
    """word -> (ids joined by commas, decoded bytes) of words seen by this worker."""


_seen: dict[str, _Words] = {}


def split_words(text: str) -> list[str]:
    return WORD.findall(BLANK + text.replace(" ", BLANK)) if text else []


def learn_words(path: str, words: list[str]) -> _Words:
    """The remembered words, with all of these among them."""
    seen = _seen.setdefault(path, _Words())
    if len(seen) > REMEMBERED:
        seen.clear()
    new = list(set(words).difference(seen))
    v = vocabulary(path)
    pieces = v.bytes
    for w, ids in zip(new, v.encode(new)):
        own = ids.tolist()
        seen[w] = (",".join(map(str, own)), b"".join([pieces[i] for i in own]))
    return seen


def piece_digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False, with_text: bool | None = None) -> DataFrame:
    """keep columns and n_tokens, ids_sha256, decoded_sha256 of each whole text.

    with_ids: ids array<int> as well; with_text: decoded as well, as with_ids unless said.
    """
    with_text = with_ids if with_text is None else with_text
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", WORD_BYTES):
            split = [split_words(t) for t in batch.column("_text").to_pylist()]
            seen = learn_words(path, [w for words in split for w in words])
            counts, hashes, decoded, all_ids, texts = [], [], [], [], []
            for words in split:
                own = [seen[w] for w in words]
                ids = ",".join([x for x, _ in own])
                text = Vocabulary.joined(b"".join([y for _, y in own]))
                counts.append(ids.count(",") + bool(own))
                hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.fromstring(ids, np.int32, sep=",") if own else np.zeros(0, np.int32))
                if with_text:
                    texts.append(text)
            out = {c: batch.column(c) for c in keep} | {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if with_ids:
                starts = np.cumsum([0, *map(len, all_ids)]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(all_ids)))
            if with_text:
                out["decoded"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(encode, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), model_path())


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
SQL: dict[str, str] = {}
