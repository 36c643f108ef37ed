"""Packing by concatenate and cut.

Every text becomes token ids (a public tokenizer's vocabulary file) and one end
id; all documents are laid end to end and cut into windows of ``WINDOW`` ids.

1. Each partition of the documents is tokenised once, in a stream, and written to
   the shared folder: ids, where the document begins in its partition, and the
   partition's number.
2. The token totals of the partitions, one row each, are summed up in order;
   a document's global offset is its partition's sum plus its own. Windows are
   then arithmetic: a boundary record for each piece of a document in a window.

Only the last window can be short: padding is below ``WINDOW`` ids in all.

Words recur: a worker keeps the ids of the words it has met, ``CACHE`` at most, in
flat arrays by a 64-bit hash. White space never joins with its neighbours in this
tokenizer: a text's ids are those of its white-space-separated words one after the
other. New words are cut into the tokenizer's own pieces (letters, single
digits, other signs), and the pieces go to the tokenizer many at a time, one to a
line; each piece ends with the one token that has the vocabulary's end-of-word mark.
Texts with characters for which that isn't plain (special-token strings, a capital
sigma, white space outside ASCII) go to the tokenizer whole.

Defined results: null and empty texts are the end id alone; very long texts span
as many windows as they fill; repeated rows are packed each; ties don't arise, as order is
that of files and rows; a null doc_id stays null; an empty table gives no pieces; extra columns
are not read.
"""

from __future__ import annotations

import re
import unicodedata
import numpy as np
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import map_texts, materialise
from gristmill.llm.wordhash import Ids, Table, different, hashes, split

WINDOW = 2048
END = 1
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CACHE = 1 << 19
BYTES = 4_000_000

#: What isn't split at ASCII white space alone: special tokens, sigma (its lower case can depend on neighbours), other separators.
_WHOLE = re.compile("<\\||Σ|[^\\S \\t\\n\\x0b\\f\\r]|[᠎​﻿]")
#: The tokenizer's fixed pattern for pieces, on lower-cased text.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_workers: dict[str, tuple] = {}


class WordIds:
    """Texts to little-endian unsigned 32-bit ids, by word."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.table, self.ids = Table(), Ids()
        self.pieces, self.piece_ids = Table(), Ids()

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, in their order."""
        cut, many = [], {}
        for w in words:
            x = w if w.isascii() else unicodedata.normalize("NFC", w).lower()
            if x.isalpha():
                cut.append((x,))
            elif x[-1] in ".,|!?;:%#$&*" and x[:-1].isalpha():
                cut.append((x[:-1], x[-1]))
            else:
                cut.append(_PIECE.findall(x))
        for xs in cut:
            for x in xs:
                many.setdefault(x, len(many))
        keys = np.fromiter((xxhash.xxh64_intdigest(x) for x in many), np.uint64, len(many))
        slots = self.pieces.find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = self.pieces.add(keys[new])
            every = list(many)
            self.piece_ids.add(*self._encode([every[k] for k in new.tolist()]))
        flat, n = self.piece_ids.take(slots[np.fromiter((many[x] for xs in cut for x in xs), np.int64)])
        pieces = np.fromiter(map(len, cut), np.int64, len(cut))
        upto = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(pieces)))]
        self.ids.add(flat, np.diff(upto))

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces end to end, and how many each has."""
        flat, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for k in range(0, len(pieces), 10_000):
            some = pieces[k : k + 10_000]
            a = np.array(self.tokenizer.encode("\n".join(some), add_special_tokens=False).ids, "<u4")
            stop = np.flatnonzero(self.ends[a]) + 1
            if len(stop) == len(some):
                flat.append(a)
                lengths.append(np.diff(stop, prepend=0))
            else:
                got = [e.ids for e in self.tokenizer.encode_batch(some, add_special_tokens=False)]
                flat.append(np.array([i for g in got for i in g], "<u4"))
                lengths.append(np.fromiter(map(len, got), np.int64, len(got)))
        return np.concatenate(flat), np.concatenate(lengths)

    def _plain(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        buffer, start, stop, per_text = split(texts)
        codes, values, first = different(hashes(buffer, start, stop))
        if self.table.size + len(values) > CACHE:
            self._reset()
        slots = self.table.find(values)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = self.table.add(values[new])
            self._learn([buffer[i:j].decode("utf-8", "surrogatepass") for i, j in zip(start[first[new]].tolist(), stop[first[new]].tolist(), strict=True)])
        flat, n = self.ids.take(slots[codes])
        sums = np.concatenate(([0], np.cumsum(n)))
        ends = sums[np.cumsum(per_text)] if len(per_text) else np.zeros(0, np.int64)
        return np.insert(flat, ends, end), np.diff(ends, prepend=0) + 1

    def batch(self, texts: list[str | None], end: int) -> list[bytes]:
        plain = lambda t: "<|" not in t and (t.isascii() and not _SEPARATORS.search(t) or not _WHOLE.search(t))
        texts = [t or "" for t in texts]
        out: list[bytes] = [b""] * len(texts)
        group: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            if not plain(t):
                out[k] = np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes()
            else:
                group.append(k)
                size += len(t)
            if group and (size > BYTES or k == len(texts) - 1):
                flat, n = self._plain([texts[i].encode("utf-8", "surrogatepass").lower() for i in group], end)
                raw, stops = flat.tobytes(), (4 * np.cumsum(n)).tolist()
                for i, a, b in zip(group, [0, *stops[:-1]], stops, strict=True):
                    out[i] = raw[a:b]
                group, size = [], 0
        return out


def token_table(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """(doc_id, part, start, n, ids): ids as bytes; ``start`` counts the partition's ids before the document. Written once."""

    def start():
        from pyspark import TaskContext

        part, upto = TaskContext.get().partitionId(), 0
        ids = _workers.setdefault(vocabulary, WordIds(vocabulary))

        def of(texts: list[str | None], _):
            nonlocal upto
            got = ids.batch(texts, end)
            n = np.array([len(x) // 4 for x in got], np.int64)
            before = upto + np.cumsum(n) - n
            upto += int(n.sum())
            return {"part": [part] * len(got), "start": before, "n": n, "ids": got}

        def done():
            ids._reset()  # the tokenizer stays, the words go with the task
            return ()

        return of, done

    return materialise(map_texts(docs.select("doc_id", "text"), "part int, start long, n long, ids binary", start))


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece; ids as little-endian bytes."""
    table = token_table(docs, vocabulary, end)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = table.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    at = F.col("base") + F.col("first")
    # one row per partition of the input: its size is known before it is broadcast
    base = F.broadcast(base) if table.select("part").distinct().count() <= 1_000_000 else base
    docs_at = table.withColumnRenamed("start", "first").join(base, "part").select("doc_id", "ids", F.col("n").alias("doc_tokens"), at.alias("at"))
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("doc_tokens") - 1) / window)
    pieces = docs_at.select("*", F.explode(F.sequence(first, last)).alias("sequence_id"))
    begin = F.greatest(F.col("at"), F.col("sequence_id") * window)
    stop = F.least(F.col("at") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * window)
    pieces = pieces.select("*", begin.alias("begin"), stop.alias("stop"))
    start, length = F.col("begin") - F.col("at"), F.col("stop") - F.col("begin")
    return pieces.select(
        "doc_id",
        start.alias("start"),
        length.alias("length"),
        F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"),
        "doc_tokens",
        "sequence_id",
        (F.col("begin") % window).alias("offset"),
    )


def op7_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
