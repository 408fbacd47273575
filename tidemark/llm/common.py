"""Shared pieces: words, positions, cached tokenizers and a sharded lookup stream."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# The space characters of the word rules: space, tab, newline, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The maximal runs of non-space characters, in order; null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " ", -1), "")


def text_digest(text: Column) -> Column:
    """A digest that tells texts apart in the key of a row; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones of any name do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def matching_rows(docs: DataFrame, keys: list[Column], other: DataFrame, how: str) -> DataFrame:
    """`docs` joined ("left_semi" or "left_anti") with `other`, whose columns meet `keys` in order, nulls too.

    Columns go by place, so those of `docs` may have any names.
    """
    names = docs.columns
    keyed = docs.select("*", *keys).toDF(*[f"_c{i}" for i in range(len(names))], *[f"_k{i}" for i in range(len(keys))])
    found = other.toDF(*[f"_o{i}" for i in range(len(keys))])
    same = functools.reduce(Column.__and__, [F.col(f"_k{i}").eqNullSafe(F.col(f"_o{i}")) for i in range(len(keys))])
    return keyed.join(found, same, how).select(*[F.col(f"_c{i}") for i in range(len(names))]).toDF(*names)


def one_of_each(docs: DataFrame, keys: list[Column], repeated: DataFrame) -> DataFrame:
    """`docs` with a single row for each of the `repeated` keys; all other rows stay.

    Only rows of repeated keys are gathered, and one of each per task before the shuffle.
    """
    names = docs.columns
    rest = matching_rows(docs, keys, repeated, "left_anti")
    several = matching_rows(docs, keys, repeated, "left_semi").select("*", *keys)
    several = several.toDF(*[f"_c{i}" for i in range(len(names))], *[f"_k{i}" for i in range(len(keys))])
    one = several.dropDuplicates([f"_k{i}" for i in range(len(keys))])
    return rest.union(one.select(*[F.col(f"_c{i}") for i in range(len(names))]).toDF(*names))


def in_batches(frames: Iterator[pa.RecordBatch], size: int = 1 << 22, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text column of each holds about `size` bytes, one row at least."""
    for b in frames:
        col = b.column(text)
        ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(col).to_numpy(zero_copy_only=False)).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield b.slice(at, to - at)
            at = to


def as_list(values: pa.Array) -> list:
    """Strings or binaries without nulls as a list, made in one go."""
    return values.to_numpy(zero_copy_only=False).tolist()


def joined_values(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a large binary array in one run, and where each value begins and the last ends."""
    _, offsets, data = values.buffers()
    return memoryview(data or b"").cast("B"), np.frombuffer(offsets, "<i8", len(values) + 1, 8 * values.offset)


# Printable ASCII and Latin-1 letters: composed, and lowered letter by letter.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
# The word-end vocabulary's split pattern (fixed value), and the same over words of _PLAIN once lowered, with spaces between.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]| |[^a-zß-öø-ÿ0-9 ]+")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies' letter for each byte: printable bytes stand for themselves,
    the others take the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class WordModel:
    """A vocabulary's merge model on many words at once: one call of the library takes a run of them.

    A run's ids are cut where the lengths of their pieces reach the words' ends.
    Where these do not agree (characters that the vocabulary lacks, pieces that
    look like the mark of a word's end), the run's words go one by one.
    """

    RUN = 10_000

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, vocab = tokenizer.model, tokenizer.get_vocab(with_added_tokens=False)
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix = self.model.end_of_word_suffix or ""
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            self.sizes[i] = len(piece.removesuffix(suffix))

    def ids(self, words: list[str]) -> list[bytes]:
        """The packed ids of each word; words are not empty and without spaces."""
        out: list[bytes] = []
        for at in range(0, len(words), self.RUN):
            run = words[at : at + self.RUN]
            ids = np.array(self.bare.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, "<u4")
            reached, ends = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, run), np.int64, len(run)))
            to = np.searchsorted(reached, ends)
            if len(ids) and reached[-1] == ends[-1] and (reached[to] == ends).all():
                raw, places = ids.tobytes(), [0, *(4 * (to + 1)).tolist()]
                out += [raw[a:b] for a, b in zip(places, places[1:])]
            else:
                out += [array("I", [t.id for t in self.model.tokenize(w)]).tobytes() for w in run]
        return out


class _Recent(dict):
    """A dict that fills itself: `make` gives the values of all missing keys of a call at once.

    When it would hold more than `limit` keys they become the older generation;
    keys met again come back from there, and the rest go when it is replaced in turn.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, max(1, limit), {}

    def values_of(self, keys: list[str]) -> list[bytes]:
        """The values of distinct keys, `limit` at a time."""
        out: list[bytes] = []
        for at in range(0, len(keys), self.limit):
            some = keys[at : at + self.limit]
            new = [k for k in some if k not in self]
            if len(self) + len(new) > self.limit:
                self.older = dict(self)
                self.clear()
                new = some
            older = self.older
            if older:
                self.update({k: older[k] for k in new if k in older})
                new = [k for k in new if k not in self]
            self.update(zip(new, self.make(new)))
            out += map(self.__getitem__, some)
        return out


class CachedTokenizer:
    """A tokenizer whose words are delimited by spaces and newlines, with a bounded word cache.

    It gives what encode() gives for the whole text: the vocabulary must drop
    white space and never join characters across it (as word-end vocabularies
    do). The distinct words of a call are encoded once while they stay in the cache,
    which holds at most two times `limit` words. Plain words of a lower-casing
    vocabulary with the usual split go to the merge model, many in one call, others
    through the library's normaliser and splitter.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache, self.parts = _Recent(self._words, limit), _Recent(self._parts, limit // 2)
        form = json.loads(Path(path).read_text(encoding="utf-8"))
        norm = form["normalizer"] or {}
        split = (form["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.plain = (
            [n["type"] for n in norm.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]
            and split[0].get("pattern") == {"Regex": _SPLIT}
            and not any(_PLAIN.fullmatch(t["content"]) and "<|" not in t["content"] for t in form["added_tokens"])
        )
        self.letters, self.model = byte_letters(), WordModel(self.tokenizer)

    def _parts(self, parts: list[str]) -> list[bytes]:
        return self.model.ids([p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode())) for p in parts])

    def _is_plain(self, word: str) -> bool:
        return self.plain and "<|" not in word and _PLAIN.fullmatch(word) is not None

    def _words(self, words: list[str]) -> list[bytes]:
        plain = [w for w in words if w.isalpha() and w.isascii() or self._is_plain(w)] if self.plain else []
        # The parts of all plain words in one pass, a space before each word.
        parts = pa.array(_PLAIN_SPLIT.findall(" ".join(["", *plain]).lower()), pa.large_string()).dictionary_encode()
        kinds = as_list(parts.dictionary)
        space = kinds.index(" ") if plain else -1
        ids = self.parts.values_of([p for p in kinds if p != " "])
        if plain:
            ids.insert(space, b"")
        raw, places = joined_values(pa.array(ids, pa.large_binary()).take(parts.indices))
        begins = [*places[:-1][parts.indices.to_numpy() == space].tolist(), int(places[-1])]
        known = {w: raw[a:b].tobytes() for w, a, b in zip(plain, begins, begins[1:])}
        return [known[w] if w in known else self._whole(w) for w in words]

    def _whole(self, word: str) -> bytes:
        if not word:
            return b""
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        split = pc.split_pattern(pa.array([(t or "").replace("\n", " ") for t in texts], pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        values = pa.array(self.cache.values_of(as_list(words.dictionary)), pa.large_binary()).take(words.indices)
        raw, places = joined_values(values)
        ends = places[np.cumsum(split.value_lengths().to_numpy(), dtype=np.int64)].tolist()
        return [raw[a:b].tobytes() for a, b in zip([0, *ends], ends)]


@functools.lru_cache(maxsize=2)
def cached_tokenizer(path: str) -> CachedTokenizer:
    """One tokenizer, with its cache, for all tasks of a Python worker."""
    return CachedTokenizer(path)


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def buffered_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups of rows with equal `key`, several per frame, from frames sorted by it."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if f.empty:
            continue
        k = f[key].to_numpy()
        if k[-1] == k[0]:
            if held and held[-1][key].iloc[-1] != k[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(f)
            continue
        cut = int(np.searchsorted(k, k[-1], side="left"))
        yield pd.concat([*held, f.iloc[:cut]], ignore_index=True)
        held = [f.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)
