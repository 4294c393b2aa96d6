"""Helpers shared by the operators: landing, words, hashes and token ids."""

from __future__ import annotations

import re
from weakref import WeakKeyDictionary

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.session import shared_folder
from tripflow.sources.sinks import delete_folder

#: Characters that a Python ``\s`` matches and the tokenizers' ``\s`` does not.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: A chunk of Latin-1 letters and ASCII marks: both tokenizers cut it into just these two parts.
PLAIN = re.compile("( ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@[-`{-~]*)")
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
#: Rows that fill a file of ids and numbers, and one of texts.
ID_ROWS, TEXT_ROWS = 100_000, 2_000
#: Where each landed table lies.
FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def land(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    landed = spark.read.schema(df.schema).parquet(path)
    FOLDERS[landed] = path
    return landed


def few_files(df: DataFrame, rows: int | None, each: int = ID_ROWS) -> DataFrame:
    """The table in no more partitions than about ``rows`` rows fill with ``each``, but two per core; fewer stay as they are,
    and so do those of a table of unknown size.

    Written, each partition is a file, and on a folder without native calls each file has the executor fork several
    times. Nothing is shuffled; where adaptive execution merges small partitions, there are fewer already.
    """
    if rows is None:
        return df
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def drop(*tables: DataFrame | None) -> None:
    """Delete landed tables that no frame still to be evaluated reads; anything else is left alone."""
    for table in tables:
        path = FOLDERS.pop(table, None) if table is not None else None
        if path:
            delete_folder(table.sparkSession, path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator needs; a null text is empty."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a fixed bijection)."""
    values = (values ^ (values >> np.uint64(30))) * MIX_A
    values = (values ^ (values >> np.uint64(27))) * MIX_B
    return values ^ (values >> np.uint64(31))


def seeded(count: int, seed: int) -> np.ndarray:
    """``count`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


SHINGLE_WORDS = 5
SHINGLE_MULTIPLIERS = seeded(SHINGLE_WORDS, 11)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """One 64-bit hash per window of ``size`` words, in order; fewer words make one window."""
    count = len(hashes)
    if not count:
        return hashes
    if count < size:
        padded = np.zeros(size, np.uint64)
        padded[:count] = hashes
        return shingle_hashes(padded, size) + np.uint64(count)
    multipliers = SHINGLE_MULTIPLIERS if size == SHINGLE_WORDS else seeded(size, 11)
    out = hashes[: count - size + 1] * multipliers[0]
    for k in range(1, size):
        out = out + hashes[k : count - size + 1 + k] * multipliers[k]
    return mix(out)


def byte_characters() -> dict[int, str]:
    """Byte-level tokenizers write printable Latin-1 bytes as themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(0x100 + place) for place, byte in enumerate(hidden)}


BYTE_CHARACTERS = byte_characters()


class TokenIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Both supported tokenizers split at white space before they merge, so the ids of a text
    are those of its chunks: the word behind a space or line break with that character, or
    the word alone where white space is dropped. Chunks and their parts are remembered up to
    ``keep`` of them. Texts with other white space than single spaces and line breaks are cut
    by a pattern; those with an added token or an odd separator are encoded whole.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.keep = keep
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_space = self._whole(" a") != self._whole("a")
        self.lower = self._whole("A") == self._whole("a")
        probe = "".join(filter(PLAIN.fullmatch, map(chr, range(256)))) + "?!"
        self.plain = True
        self.plain = self._plain_parts(probe) == [part for part, _ in self.cut(self._normal(probe))]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _normal(self, chunk: str) -> str:
        return chunk if self.normalizer is None else self.normalizer.normalize_str(chunk)

    def _plain_parts(self, chunk: str) -> list[str] | None:
        """What the cut gives for a plain chunk, without its pattern search; None for any other chunk."""
        match = PLAIN.fullmatch(chunk) if self.plain else None
        if match is None:
            return None
        word, marks = match.groups()
        if self.lower:
            word = word.lower()
        if word.isascii():
            word = word.replace(" ", BYTE_CHARACTERS[0x20])
        else:
            word = word.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return [word, marks] if marks else [word]

    def _chunk(self, chunk: str) -> bytes:
        parts = self._plain_parts(chunk)
        if parts is None:
            parts = [part for part, _ in self.cut(self._normal(chunk))]
        out = []
        for part in parts:
            ids = self.parts.get(part)
            if ids is None:
                ids = b"".join([token.id.to_bytes(4, "little") for token in self.model.tokenize(part)])
                if len(part) <= 64:
                    self.parts[part] = ids
            out.append(ids)
        return b"".join(out)

    def _odd(self, text: str) -> bytes:
        return b"".join(map(self._chunk, re.findall(r"\s*\S+|\s+", text)))

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self.added) or any(mark in text for mark in ODD_SPACE):
            return self._whole(text)
        first = b""
        if self.keeps_space:
            words = text.replace("\n", " \n").split(" ")
            head = words.pop(0)
            if head and head.split() != [head]:
                return self._odd(text)
            first = self._chunk(head)
        else:
            words = text.split()
        found = list(map(self.known.get, words))
        if None in found:
            if max(len(self.known), len(self.parts)) > self.keep:
                self.known.clear()
                self.parts.clear()
            for at in [at for at, ids in enumerate(found) if ids is None]:
                word = words[at]
                ids = self.known.get(word)
                if ids is None:
                    if self.keeps_space:
                        bare = word.removeprefix("\n")
                        if bare.split() != [bare]:
                            return self._odd(text)
                        ids = self._chunk(word if bare != word else " " + word)
                    else:
                        ids = self._chunk(word)
                    if len(word) <= 64:
                        self.known[word] = ids
                found[at] = ids
        return first + b"".join(found)


_TOKENIZERS: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    """One per worker process, so what it remembers serves all tasks of the process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = TokenIds(path)
    return _TOKENIZERS[path]
