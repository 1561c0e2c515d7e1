"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import PART, released

#: Mean words of a chunk, words of the rolling window, bounds of a chunk.
MEAN, WINDOW, LEAST, MOST = 64, 4, 16, 256
#: Entries of each generation of a worker's memory: pieces, chunks, joins.
PIECES, CHUNKS, JOINS = 120_000, 12_000, 60_000
#: Bytes of texts that are encoded, and returned to Spark, together; a longer text stands alone.
GROUP = 1 << 18


class Recent(dict):
    """A dict of the most recently used entries: `size` to twice as many. What it forgets is made again when met."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self[key] = value
        return value

    def room(self):
        """Called between texts: starts a new generation when this one is full."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


def cuts(words: list[bytes]) -> list[int]:
    """Ends of the chunks: where a rolling hash of the last words says so, so that equal passages get equal chunks
    wherever they stand. Chunks have LEAST to MOST words but for the last."""
    n = len(words)
    if n <= LEAST:
        return [n]
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled[k:] += h[: n - k] * np.uint64(0x9E3779B97F4A7C15 ** (k + 1) % (1 << 64))
    out, start = [], 0
    for end in (np.nonzero((rolled >> np.uint64(40)) % np.uint64(MEAN) == 0)[0] + 1).tolist():
        while end - start > MOST:
            start += MOST
            out.append(start)
        if end - start >= LEAST:
            out.append(end)
            start = end
    while n - start > MOST:
        start += MOST
        out.append(start)
    if start < n:
        out.append(n)
    return out


def breaks_at_space(config: dict) -> bool:
    """Whether text on both sides of ASCII white space is encoded as if the other were not there.

    So if white space is turned into spaces, only such normalizers act as look no farther than a combining sequence, and the
    pre-tokenizer drops what its pattern of non-space runs leaves out. No added token may hold a space.
    """
    normal, pre = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    steps, cutters = normal.get("normalizers", [normal]), pre.get("pretokenizers", [pre])
    local = {"NFC", "Lowercase"}
    spaces = [s for s in steps if s.get("type") == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " "]
    first = cutters[0] if cutters else {}
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and not re.search(r"\\S|\.|\[\^(?!\\s)| ", first["pattern"].get("Regex", "."))
    plain = all(re.search(r"\s", t["content"]) is None and not t.get("single_word") for t in config.get("added_tokens", []))
    rest = all(c.get("type") == "ByteLevel" and not c.get("add_prefix_space") and not c.get("use_regex") for c in cutters[1:])
    return bool(spaces and drops and rest and plain and all(s in spaces or s.get("type") in local for s in steps))


class Coder:
    """Encodes and decodes whole texts; one for each worker and tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.by_piece = breaks_at_space(config)
        self.spaced = config.get("decoder") is None  # then decoding puts a space between the tokens' strings
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())] if self.spaced else []
        self.forget()

    def forget(self) -> None:
        """At the end of a task: a worker that waits for its next one holds nothing."""
        self.pieces, self.chunks, self.joins, self.seen = Recent(PIECES), Recent(CHUNKS), Recent(JOINS), Recent(PIECES)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _entry(self, ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), " ".join([self.names[i] for i in ids]) if self.spaced else ""

    def learn(self, texts: list[bytes]) -> list[list[bytes]]:
        """Encodes the pieces of `texts` that aren't known yet, together; the texts' words."""
        self.pieces.room()
        split = [t.split() for t in texts]
        new = [w for w in set().union(*split) if self.pieces[w] is None]
        for w, ids in zip(new, self._library([w.decode("utf-8", "replace") for w in new])):
            self.pieces[w] = self._entry(ids)
        return split

    def _piece(self, word: bytes) -> tuple[bytes, str]:
        if (found := self.pieces[word]) is None:
            found = self.pieces[word] = self._entry(self._library([word.decode("utf-8", "replace")])[0])
        return found

    def _chunk(self, words: list[bytes]) -> tuple[bytes, str]:
        """A chunk's ids and text; kept from the second time that it is met."""
        name = b" ".join(words)
        if (found := self.chunks[name]) is not None:
            return found
        parts = list(map(self.pieces.__getitem__, words))
        if None in parts:
            parts = list(map(self._piece, words))
        ids, texts = zip(*parts)
        found = b"".join(ids), " ".join(filter(None, texts) if b"" in ids else texts)
        mark = hash(name)
        if self.seen[mark]:
            self.chunks[name] = found
        else:
            self.seen[mark] = True
        return found

    def join(self, texts: list[list[bytes]], ends: list[list[int]]) -> None:
        """Re-encodes the words on both sides of every join that isn't known yet, together: does it give what they give apart?"""
        new = {(words[e - 1], words[e]) for words, cut in zip(texts, ends) for e in cut[:-1]}
        new = [k for k in new if self.joins[k] is None]
        for (a, b), both in zip(new, self._library([(a + b" " + b).decode("utf-8", "replace") for a, b in new])):
            self.joins[a, b] = 1 + (array("I", both).tobytes() == self._piece(a)[0] + self._piece(b)[0])

    def encode(self, text: bytes, words: list[bytes] | None = None, ends: list[int] | None = None) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text)."""
        if not self.by_piece:
            return self._by_joins(text.decode("utf-8", "replace"))
        if words is None or ends is None:
            words = text.split()
            ends = cuts(words)
            self.join([words], [ends])
        out, held, start = [], [], 0
        for end in ends:
            chunk = words[start:end]
            if not chunk:
                continue
            made = self._chunk(chunk)
            if held and self.joins[held[-1], chunk[0]] != 2:
                # encode both sides of the join anew as one
                chunk = held + chunk
                out.pop()
                ids = self._library([b" ".join(chunk).decode("utf-8", "replace")])[0]
                made = self._entry(ids)
            out.append(made)
            held, start = chunk, end
        ids = b"".join([o[0] for o in out])
        return ids, " ".join([o[1] for o in out if o[0]]) if self.spaced else self._decoded(ids)

    def _decoded(self, ids: bytes) -> str:
        return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)

    def _by_joins(self, text: str) -> tuple[bytes, str]:
        """For tokenizers to which white space belongs: chunks end before a white space, and each join's window of
        pieces doubles until both sides re-encode to the same as apart, or takes in both chunks."""
        pieces = re.findall(r"\s*\S+|\s+", text)
        made, start = [], 0
        for end in cuts([p.encode() for p in pieces]) if pieces else []:
            name = "".join(pieces[start:end])
            if (ids := self.chunks[name]) is None:
                ids = self.chunks[name] = tuple(self._library([name])[0])
            part, start = (pieces[start:end], list(ids)), end
            if made:
                left, width = made[-1], 1
                while True:
                    a, b = "".join(left[0][-width:]), "".join(part[0][:width])
                    both, one, two = self._library([a + b, a, b])
                    if both == one + two:
                        break
                    if width >= max(len(left[0]), len(part[0])):
                        made.pop()
                        part = (left[0] + part[0], both)
                        break
                    width *= 2
            made.append(part)
        self.chunks.room()
        ids = np.array([i for _, p in made for i in p], "<u4").tobytes()
        return ids, self._decoded(ids)

    def encode_all(self, texts: list[bytes]) -> Iterator[list[tuple[bytes, str]]]:
        """Lists of results, one for each group of texts: new pieces reach the library many at a time, and only one group's results are held."""
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size < GROUP):
                size += len(texts[upto])
                upto += 1
            group = texts[at:upto]
            words = self.learn(group) if self.by_piece else [None] * len(group)
            ends = [cuts(w) for w in words] if self.by_piece else words
            if self.by_piece:
                self.join(words, ends)
            made = []
            for text, w, cut in zip(group, words, ends):
                made.append(self.encode(text, w, cut))
                for memory in (self.chunks, self.seen):
                    memory.room()
            self.joins.room()
            yield made
            at = upto


@cache
def coder(path: str) -> Coder:
    return Coder(path)


def encoded(text: Column, path: str) -> Column:
    """struct(ids binary: little-endian unsigned 32-bit, decoded string) of whole texts; null counts as empty.

    path: the tokenizer's file, found at that path by every executor.
    """

    @released
    def made_of(batches):
        own = coder(path)
        for texts in batches:
            for at in range(0, len(texts), PART):
                for made in own.encode_all([t or b"" for t in texts.iloc[at : at + PART]]):
                    yield pd.DataFrame(made, columns=["ids", "decoded"])
        own.forget()

    @pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from made_of(batches)

    return run(text.cast("binary"))


def decode(ids: Column, path: str) -> Column:
    """Text of little-endian unsigned 32-bit ids, special tokens kept; null stays null."""

    @pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        own = coder(path)
        return rows.map(own._decoded, na_action="ignore")

    return run(ids)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """A row for each row of docs: doc (struct of its columns), ids, decoded.

    Null and empty texts have no ids and decode to nothing; texts of any length are encoded whole; repeated rows are
    encoded each; an empty table gives an empty result; columns of docs named ids or decoded stay apart inside the struct.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), encoded(F.col("text"), path).alias("made"))
    return rows.select("doc", "made.ids", "made.decoded")
